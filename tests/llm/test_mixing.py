"""Mixing: targets by hand, the schedule against its points, words taken against intervals."""

import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import sentence

from ebbtide.llm import mixing


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows):
    """(doc_id, size, source_size, target, taken) by shares settled source by source."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words_of(r[1]) for r in rows if r[2] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(sum(size.values()))
    while free:
        each = left / sum(weight[s] for s in free)
        full = {s for s in free if each * weight[s] > 3 * size[s]}
        for s in full or free:
            target[s] = Fraction(3 * size[s]) if full else each * weight[s]
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    out = []
    for s in names:
        ours = [r for r in rows if r[2] == s]
        key = lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:16], r[0] is not None, r[0] or 0, words_of(r[1]))
        stream = [n for n, r in enumerate(sorted(ours, key=key)) for _ in range(words_of(r[1]))] * 3
        taken = stream[: int(target[s] + Fraction(1, 2))]
        out += [(r[0], words_of(r[1]), size[s], float(target[s]), taken.count(n)) for n, r in enumerate(sorted(ours, key=key))]
    return out


def rows_of(seed, many):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "ß", "zz", None, "tiny", "hot"]
    rows = [(k, sentence(rng, rng.randint(0, 40)), rng.choice(sources[:6] + ["hot"] * 4)) for k in range(many)]
    rows += [(many, "one", "tiny"), (many + 1, None, "empty"), (None, "  a  b ", "a"), (None, "x y z", "a"), (3, "same text", "b"), (3, "same text", "b"), (many + 2, "w " * 5000, "long")]
    return rows


SCHEMA = "doc_id long, text string, source string"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *map(float, r[1:])))


@pytest.mark.parametrize("seed, many, block", [(1, 60, 7), (2, 150, 1024)])
def test_words_taken_match_brute_force(spark, seed, many, block):
    rows = rows_of(seed, many)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("r")).withColumn("size", F.lit("s")).repartition(3)
    mix = mixing.plan_mix(docs, block_words=block)
    got = [tuple(r) for r in mix.taken().select("doc_id", "size", "source_size", "target", "taken").collect()]
    for a, b in zip(ordered(got), ordered(brute(rows)), strict=True):
        assert a[:3] + a[4:] == b[:3] + b[4:] and a[3] == pytest.approx(b[3])
    assert all(r[4] <= 3 * r[1] for r in got)
    again = mixing.plan_mix(docs.repartition(7), block_words=block).taken().select("doc_id", "size", "source_size", "target", "taken").collect()
    assert ordered(again) == ordered(got)


def test_slots_follow_the_points_and_are_filled_once(spark):
    mix = mixing.plan_mix(spark.createDataFrame(rows_of(3, 200), SCHEMA), block_words=16)
    sources = sorted(mix.sources.collect(), key=lambda r: r["source_number"])
    slots = sorted(mix.slots.collect(), key=lambda r: r["slot"])
    total = sum(r["words"] for r in sources)
    number = -(-total // 16)
    bounds, before = [], 0
    for r in sources:
        bounds.append((before * mixing._CIRCLE // total, (before + r["words"]) * mixing._CIRCLE // total, r["source_number"]))
        before += r["words"]
    for r in slots:
        if r["slot"] < number:
            point = (r["slot"] + 1) * mixing.GOLDEN % mixing._CIRCLE
            assert [s for low, high, s in bounds if low <= point < high] == [r["source_number"]]
    # every source with words has a slot, ranks have no gap, and any run of slots is near the targets
    for r in sources:
        ranks = [s["source_rank"] for s in slots if s["source_number"] == r["source_number"]]
        assert ranks == list(range(len(ranks))) and (len(ranks) > 0) == (r["words"] > 0)
        for first in range(0, number - 50, 17):
            held = sum(s["source_number"] == r["source_number"] for s in slots[first : first + 50])
            assert abs(held - 50 * r["words"] / total) <= 3
    pieces = mix.pieces().groupBy("slot").agg(F.sum("length").alias("length")).collect()
    sizes = {p["slot"]: p["length"] for p in pieces}
    for r in sources:
        ours = [sizes.get(s["slot"], 0) for s in slots if s["source_number"] == r["source_number"]]
        assert sum(ours) == r["words"] and (not ours or max(ours) - min(ours) <= 1)


def test_pieces_lie_inside_their_documents(spark):
    mix = mixing.plan_mix(spark.createDataFrame(rows_of(4, 80), SCHEMA), block_words=5)
    joined = mix.pieces().join(mix.documents, "rank").select("length", "size")
    assert joined.filter("length < 1 or length > size").count() == 0


def test_mixes_of_nothing(spark):
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).taken().count() == 0
    silent = mixing.plan_mix(spark.createDataFrame([(1, None, "a"), (2, "", None), (None, " \n", "a")], SCHEMA)).taken()
    assert sorted(r["taken"] for r in silent.collect()) == [0, 0, 0] and {r["target"] for r in silent.collect()} == {0.0}


def test_scarce_sources_are_capped_and_the_rest_is_shared_again(spark):
    rows = [(k, "w " * 100, "a") for k in range(10)] + [(20, "w " * 10, "b"), (21, "w", "c")]
    found = {r["source"]: (r["target"], r["weight"]) for r in mixing.plan_mix(spark.createDataFrame(rows, SCHEMA)).sources.collect()}
    assert found == {"a": (1011 - 33.0, 1), "b": (30.0, 2), "c": (3.0, 3)}
