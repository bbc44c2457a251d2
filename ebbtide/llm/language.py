"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become hashed TF-IDF vectors of their one- to three-byte n-grams, scaled
to length 1.  Each language has several centroids, clustered from a bounded
sample of labelled texts.  A text gets the language of the centroid nearest by
cosine; one that is too far from all centroids is rejected.

Nulls and edge cases: a null text and one without any letter are ``und`` with
score 0 and rejected; languages are tried in alphabetical order, so ties go to
the first; rows without doc_id, or that share one, are learnt from and judged
like all others, and repeated texts of a language are learnt once; texts of any
length are judged whole; without any labelled text all are ``und``; columns of
other names pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ebbtide.llm import textkit
from ebbtide.plans.scratch import materialize

DIMENSIONS = 4096
CENTROIDS = 4
#: Different labelled texts per language that the classifier is fitted on.
SAMPLE_PER_LANGUAGE = 400
#: Counts of at most this many languages, and hashes of at most this many sampled texts, are broadcast.
BROADCAST_LANGUAGES = BROADCAST_SAMPLE = 100_000
#: A text is rejected when its cosine is below this share of its language's
#: low quantile of cosines of texts that the centroids were not clustered from; at
#: this level the few odd texts of a small sample do not set the floor alone.
REJECT_SHARE = 0.5
LOW = 0.03
FOLDS = 4
UNKNOWN = "und"
_ROWS = 128
#: Letters in lower case and bytes of non-ASCII characters stay; all else counts as a blank.
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[b for b in range(128) if not 97 <= _LOWER[b] <= 122]] = 32


def counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of the texts in ``bounds``: (texts, DIMENSIONS)."""
    texts = len(bounds) - 1
    value = _LOWER[raw[int(bounds[0]) : int(bounds[-1])]]
    owner = np.repeat(np.arange(texts, dtype=np.int64) * DIMENSIONS, np.diff(bounds))
    blank = value == 32
    empty = blank.copy()  # n-grams that are blank or hold two blanks in a row
    total = np.zeros(texts * DIMENSIONS)
    code = np.zeros(len(value), np.uint32)
    for n in range(1, 4):
        code = (code[: len(value) - n + 1] if n > 1 else code) | (value[n - 1 :] << np.uint32(8 * (n - 1)))
        if not len(code):
            break
        at = (((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        own = owner[: len(code)]
        if n > 1:
            empty = (blank[:-1] & blank[1:]) if n == 2 else empty[:-1] | empty[1:]
        whole = (own == owner[n - 1 :]) & ~empty  # n-grams that lie inside one text
        total += np.bincount((own + at)[whole], minlength=len(total))
    return total.reshape(texts, DIMENSIONS)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def tfidf(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0) * idf)


def cluster(rows: np.ndarray, number: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from rows far from the centroids so far; no randomness."""
    centers = [unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(centers) < min(number, len(rows)):
        centers.append(rows[np.argmin((rows @ np.array(centers).T).max(axis=1))])
    out = np.array(centers)
    for _ in range(rounds):
        near = (rows @ out.T).argmax(axis=1)
        out = unit(np.array([rows[near == k].mean(axis=0) if (near == k).any() else out[k] for k in range(len(out))]))
    return out


def unseen_cosines(rows: np.ndarray, number: int) -> np.ndarray:
    """Cosine of each row with the nearest centroid of the other folds' rows; none where there is one row only."""
    fold = np.arange(len(rows)) % FOLDS
    parts = [(rows[fold == k] @ cluster(rows[fold != k], number).T).max(axis=1) for k in range(min(FOLDS, len(rows))) if len(rows) > 1]
    return np.concatenate(parts) if parts else np.zeros(0)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centers: np.ndarray
    floor: np.ndarray
    idf: np.ndarray

    def nearest(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of each text."""
        like = tfidf(counts(raw, bounds), self.idf) @ self.centers.T
        best = like.argmax(axis=1)
        return self.owner[best], np.clip(like[np.arange(len(best)), best], 0, 1)


def _vectors(texts: pd.Series) -> np.ndarray:
    raw, bounds = textkit.text_buffers(pa.array(texts, pa.large_string()))
    parts = [counts(raw, bounds[a : b + 1]) for a, b in textkit.slices(bounds, most=_ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS))


def sampled(labelled: DataFrame) -> DataFrame:
    """(lang, text): at most ``SAMPLE_PER_LANGUAGE`` different texts of each language, those of least hash.

    Ids play no part, so rows without one and rows that share one count like all others.
    """
    usable = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("hash"))
    texts = materialize(usable.select("lang", "hash").distinct(), "texts")
    counts = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))  # a row per language
    few = counts.count() <= BROADCAST_LANGUAGES
    # hashes are spread evenly, so about twice the sample of each language lies below this; what the window sorts is bounded
    low = F.col("hash") / float(1 << 64) + 0.5 < 2.0 * SAMPLE_PER_LANGUAGE / F.col("texts")
    drawn = texts.join(F.broadcast(counts) if few else counts, "lang").filter(low).select("lang", "hash")
    least = W.partitionBy("lang").orderBy("hash")
    chosen = drawn.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= SAMPLE_PER_LANGUAGE).drop("n")
    chosen = materialize(chosen, "chosen")
    few = chosen.count() <= BROADCAST_SAMPLE
    found = usable.join(F.broadcast(chosen) if few else chosen, ["lang", "hash"], "left_semi")
    return materialize(found.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text"), "sample")


def fit(labelled: DataFrame) -> Model:
    """Fit on the sample of (text, lang)."""
    sample = sampled(labelled).repartition("lang")

    def frequency(group: pd.DataFrame) -> pd.DataFrame:
        rows = _vectors(group["text"])
        return pd.DataFrame({"n": [len(rows)], "df": [(rows > 0).sum(axis=0).tolist()]})

    seen = sample.groupBy("lang").applyInPandas(frequency, "n long, df array<long>").collect()
    if not seen:
        empty = np.zeros((0, DIMENSIONS))
        return Model([], np.zeros(0, int), empty, np.zeros(0), np.ones(DIMENSIONS))
    idf = np.log((1 + sum(r["n"] for r in seen)) / (1 + sum(np.array(r["df"]) for r in seen))) + 1

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = tfidf(_vectors(group["text"].sort_values()), idf)
        found = cluster(rows, CENTROIDS)
        unseen = unseen_cosines(rows, CENTROIDS)
        # one text says nothing about how far others of its language lie
        floor = REJECT_SHARE * float(np.quantile(unseen, LOW)) if len(unseen) else 0.0
        return pd.DataFrame({"lang": key[0], "center": [c.tolist() for c in found], "floor": floor})

    rows = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, center array<double>, floor double").collect(), key=lambda r: r["lang"])
    languages = sorted({r["lang"] for r in rows})
    floor = {r["lang"]: r["floor"] for r in rows}
    return Model(
        languages,
        np.array([languages.index(r["lang"]) for r in rows]),
        np.array([r["center"] for r in rows]),
        np.array([floor[x] for x in languages]),
        idf,
    )


RESULT = ("lang_pred", "score", "rejected")


def predict(rows: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = RESULT) -> DataFrame:
    """All columns of ``rows`` and language, cosine and rejection; older columns of these names are replaced.

    Whoever runs it should do so within ``textkit.small_batches``.
    """
    new = list(names)
    kept = [c for c in rows.columns if c not in new]
    schema = T.StructType([rows.schema[c] for c in kept]).add(new[0], "string").add(new[1], "double").add(new[2], "boolean")
    held = rows.sparkSession.sparkContext.broadcast(model)
    letter = "__letter"
    ready = rows.select(*kept).withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        names = np.array([*fitted.languages, UNKNOWN], dtype=object)
        for batch in batches:
            known = batch.column(batch.schema.get_field_index(letter)).to_numpy(zero_copy_only=False)
            best, score = np.full(len(known), len(fitted.languages)), np.zeros(len(known))
            if fitted.languages:
                raw, bounds = textkit.text_buffers(batch.column(batch.schema.get_field_index(text)))
                for a, b in textkit.slices(bounds, most=_ROWS):
                    best[a:b], score[a:b] = fitted.nearest(raw, bounds[a : b + 1])
                far = score < np.append(fitted.floor, 0)[best]
            else:
                far = np.ones(len(known), bool)
            best = np.where(known, best, len(fitted.languages))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far | ~known)],
                names=[*kept, *new],
            )

    return ready.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> F.Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, names: tuple[str, str, str] = RESULT) -> DataFrame:
    """Learn from the labelled documents that aren't held out, and judge all documents; all columns stay."""
    return predict(docs, fit(docs.filter(~held_out())), names=names)
