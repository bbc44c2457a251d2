"""The pipeline's stages against brute force, each on what its predecessor kept."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import awkward_texts, sentence
from tests.llm.test_operators import brute_lines, brute_near, shingle_set

from ebbtide.llm import packing
from ebbtide.plans.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages and benchmark items, and the benchmark."""
    rng = random.Random(12)
    items = [(k, sentence(rng, 30)) for k in range(6)]
    texts = [(i, t, g) for i, t, g in awkward_texts() if i is not None and i != 11]
    for k in range(40):
        body = "\n".join(sentence(rng, rng.choice((8, 30, 55))) for _ in range(5))
        texts.append((1000 + k, body, "en"))
        if k % 8 == 0:
            texts.append((2000 + k, body, "en"))
        if k % 8 == 1:
            texts.append((3000 + k, body.replace(" ", " x ", 1), "en"))
        if k % 8 == 2:
            texts.append((4000 + k, f"{sentence(rng, 20)} {items[k % 6][1]} {sentence(rng, 20)}", "en"))
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, t, g, "s", len(t) if t is not None else None) for i, t, g in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    found = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], folder), "stage"))
    return found


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_documents_keep_their_columns(stages):
    assert all(frame.columns == COLUMNS for frame in stages[:-1])


def test_only_documents_without_letters_go(stages):
    before, after = texts_of(stages[0]), texts_of(stages[1])
    assert {i for i in before if i not in after} == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
    assert all(after[i] == before[i] for i in after)


def test_later_copies_of_lines_go(stages):
    before, after = texts_of(stages[1]), texts_of(stages[2])
    want = {i: t for (i, old), t in brute_lines(list(before.items())).items() if t or not old}
    assert after == want and any(after[i] != before[i] for i in after)
    assert stages[2].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_one_document_of_each_near_group_stays(stages):
    before, after = texts_of(stages[2]), texts_of(stages[3])
    assert set(after) == {i for i, _, _, kept in brute_near(list(before.items())) if kept}


def test_documents_with_items_go(spark, folder, stages):
    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, after = texts_of(stages[3]), texts_of(stages[4])
    dirty = {i for i, t in before.items() if any(4 * len(s & shingle_set(t)) >= 3 * len(s) for s in items)}
    assert dirty and set(after) == set(before) - dirty


def test_all_tokens_are_packed(stages):
    slow, rows, want = packing._slow(packing.tokenizer_files()[0]), stages[5].collect(), Counter()
    for i, text in texts_of(stages[4]).items():
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for piece, (start, length) in enumerate(packing.cuts(len(ids))):
            want[i, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = defaultdict(int)
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= packing.CAPACITY


def test_run_applies_all_stages(spark, folder, stages):
    assert corpus_pipeline.run(spark, folder).count() == stages[5].count()


def test_rows_without_ids_and_repeated_rows_are_judged(spark, tmp_path):
    rng = random.Random(21)
    a, b, c, item, other = (sentence(rng, n) for n in (80, 80, 80, 30, 30))
    rows = [
        (None, a), (None, a), (5, a),  # the one with an id stays
        (None, b), (None, b), (None, b.replace(" ", " x ", 1)),  # one of them stays
        (11, c), (11, c), (11, sentence(rng, 70)),  # a repeated row goes, another text of the id stays
        (None, f"{sentence(rng, 20)} {item}"), (12, f"{sentence(rng, 20)} {other}"), (13, f"{sentence(rng, 20)} {item}"),
        (None, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(1, item), (None, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    once = corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path))
    got = Counter((r["doc_id"], r["text"]) for r in once.collect())
    assert once.columns == COLUMNS and got[5, a] == 1 and (None, a) not in got
    assert got[None, b] + got[None, b.replace(" ", " x ", 1)] == 1
    assert got[11, c] == 1 and got[rows[8]] == 1 and got[None, None] == 1 and got[None, ""] == 1
    clean = corpus_pipeline.without_benchmark_items(spark, once, str(tmp_path))
    want = Counter({k: n for k, n in got.items() if not any(x in (k[1] or "") for x in (item, other))})
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == want and sum(got.values()) - sum(want.values()) == 3


def test_awkward_rows_without_ids_pass_through_all_stages(spark, tmp_path):
    texts = awkward_texts()
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, sentence(random.Random(1), 9))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    same = {7, 8, 9, 11, None}  # one text in upper case, edited, repeated and without id
    assert len(same & {r["doc_id"] for r in rows.select("doc_id").distinct().collect()}) == 1
