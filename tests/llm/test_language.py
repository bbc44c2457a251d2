"""Language ID: samples drawn without ids, nearest centroids by hand, ties."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import sentence

import corpus_pipeline
from ebbtide.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABETS = {"en": "abcdefgh", "de": "qrstuvwx"}


def labelled(spark, ids, many=300):
    """Texts of two languages that share no letter; ``ids`` maps (language, number) to a doc_id."""
    rng, rows = random.Random(11), []
    for lang, alphabet in ALPHABETS.items():
        rows += [(ids(lang, k), text, lang, "s", len(text)) for k in range(many) for text in [sentence(rng, 20, alphabet)]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


#: 8 and 9 are ids that are not held out
CASES = {
    "without ids": lambda lang, k: None if lang == "en" else 1000 + k,
    "one id for a language": lambda lang, k: 1 if lang == "en" else 1000 + k,
    "five ids": lambda lang, k: [1, 3, 4, 5, 7][k % 5],
}


@pytest.mark.parametrize("case", CASES)
def test_missing_and_shared_ids_lose_no_language(spark, monkeypatch, case):
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 40)
    docs = labelled(spark, CASES[case])
    learnt = docs.filter(~language.held_out())
    assert {r["lang"] for r in learnt.select("lang").distinct().collect()} == {"en", "de"}
    assert {r["lang"]: r["count"] for r in language.sampled(learnt).groupBy("lang").count().collect()} == {"en": 40, "de": 40}
    judged = language.identify(docs)
    assert judged.count() == 600 and judged.filter("lang_pred <> lang or rejected").count() == 0
    assert corpus_pipeline.known_language(spark, docs, "").count() == 600


def test_a_repeated_text_is_learnt_once(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 40)
    rows = [(None, "one text and no other", "en")] * 500 + [(k, sentence(random.Random(k), 9), "en") for k in range(60)]
    found = Counter(r["text"] for r in language.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert len(found) == 40 and set(found.values()) == {1}


def by_hand(text, model):
    """Cosine with every centroid, n-gram by n-gram."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    raw = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in raw)
    seen = Counter()
    for n in (1, 2, 3):
        for k in range(len(raw) - n + 1):
            gram = raw[k : k + n]
            if gram != b" " and b"  " not in gram:
                code = sum(b << (8 * j) for j, b in enumerate(gram)) + (n << 24)
                seen[((code * 2654435761) % (1 << 32)) >> 20] += 1
    vector = np.zeros(language.DIMENSIONS)
    for place, many in seen.items():
        vector[place] = (1 + np.log(many)) * model.idf[place]
    return model.centers @ (vector / (np.linalg.norm(vector) or 1))


def test_prediction_is_the_nearest_centroid(spark, awkward):
    docs = awkward.filter(~language.held_out())
    model = language.fit(docs)
    for row in language.predict(awkward, model).collect():
        if row["lang_pred"] == language.UNKNOWN:
            continue
        cosines = by_hand(row["text"], model)
        best = int(cosines.argmax())
        assert row["score"] == pytest.approx(min(1, max(0, cosines[best])), abs=1e-9)
        assert cosines[model.owner == model.languages.index(row["lang_pred"])].max() == pytest.approx(cosines[best], abs=1e-9)


def test_ties_go_to_the_first_language(spark):
    rows = [(k, sentence(random.Random(k), 15), lang) for k in range(30) for lang in ("bb", "aa", "cc")]
    judged = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score_of", F.lit(1)))
    assert {r["lang_pred"] for r in judged.collect()} == {"aa"}
