"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots.  Slot k has the point k times the golden ratio,
modulo 1, as an integer; the sources' cumulative targets cut the unit interval,
and the source whose piece holds the point gets the slot.  Any run of slots so
holds every source nearly in proportion.  A source's slots are ranked; its
documents, shuffled by a hash and repeated where the target asks for it, form one
stream of words, which is cut into as many blocks of equal size (sizes differ by
one word at most) as the source has slots.  The slot of rank r takes block r.

Targets share all words by weight; no source gets more than ``MOST`` times its
own words, and what that leaves over is shared again by weight among the others.

No source, document or slot sequence is gathered: streams and ranks come from
range sorts with offsets per partition, so a hot source is cut like any other
rows, and blocks meet slots on (source, rank).

Nulls and edge cases: a null, empty or blank text has size 0 and is never taken;
the null source is one source, after all others; a source without words has
target 0; one whose target is so small that no point falls on its piece gets one
slot, after the others; a null id is shuffled as an empty text, and rows equal in
id, source and size lie side by side; texts of any length are counted whole and
may fill many blocks; columns other than id, text and source are left out; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.ranking import global_rank, running_total
from ebbtide.plans.scratch import materialize

#: A source gives at most this many times its words.
MOST = 3
#: Words of a block, about.
BLOCK_WORDS = 1024
#: Weights of the sources in the order of their code points, repeating.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
_CIRCLE = 1 << 62
#: The circle over the golden ratio, as an odd integer.
GOLDEN = 2850178704830871299
_CELLS = 4096


def word_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, size, shuffled): sizes in words and a hash to shuffle by."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    hashed = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 16)
    return docs.select(F.col(key), "source", size.alias("size"), hashed.alias("shuffled"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A written row per source: its number in code point order (null last), weight, size, the words before it, and its target.

    Sharing goes on until no source is above its limit; each round is one sum over the sources, in integers.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(running_total(sums, [F.col("source").isNull(), "source"], "source_size", "source_start", "source_number"), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_number") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("long"))
    limit = F.col("source_size") * MOST

    def above(words: int, shares: int):
        return F.col("weight").cast("decimal(18,0)") * F.lit(words).cast("decimal(19,0)") > limit.cast("decimal(19,0)") * F.lit(shares).cast("decimal(18,0)")

    total, shares = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    words, full = total, None
    while shares:
        # a full source stays full, as what the others get only rises
        found = sources.filter(above(words, shares)).agg(F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.count(F.lit(1))).first()
        if found[2] == full:
            break
        all_weights = sources.agg(F.sum("weight")).first()[0]
        words, shares, full = total - found[0], all_weights - found[1], found[2]
    if shares:
        shared = F.lit(words).cast("double") * F.col("weight") / F.lit(shares).cast("double")
        target = F.when(above(words, shares), limit.cast("double")).otherwise(shared)
    else:
        target = limit.cast("double")
    return materialize(sources.withColumn("target", target).withColumn("words", F.floor(F.col("target") + 0.5)), "targets")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Written rows (slot, source_number, source_rank, slots): who gets which slot, by golden-ratio points."""
    spark = sources.sparkSession
    placed = running_total(sources.filter("words > 0").select("source_number", "words"), ["source_number"], "words", "words_before")
    total, many = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    number = -(-total // block_words)
    width = _CIRCLE // max(_CELLS, many) + 1

    def place(words: str):
        return F.expr(f"CAST({words} AS DECIMAL(18,0)) * CAST({_CIRCLE} AS DECIMAL(19,0)) div CAST({max(total, 1)} AS DECIMAL(19,0))")

    arcs = placed.select("source_number", place("words_before").alias("low"), place("words_before + words").alias("high")).filter("low < high")
    arcs = arcs.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    point = F.expr(f"CAST((CAST(id + 1 AS DECIMAL(18,0)) * CAST({GOLDEN} AS DECIMAL(19,0))) % CAST({_CIRCLE} AS DECIMAL(19,0)) AS BIGINT)")
    points = spark.range(number).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {width}"))
    drawn = materialize(points.join(arcs, "cell").filter("low <= point and point < high").select("slot", "source_number"), "drawn")
    rest = sources.filter("words > 0").join(drawn.select("source_number").distinct(), "source_number", "left_anti")
    drawn = drawn.unionByName(rest.select((F.lit(number) + F.col("source_number")).alias("slot"), "source_number"))
    ranked = materialize(global_rank(drawn, ["source_number", "slot"], "rank"), "slots")
    counts = ranked.groupBy("source_number").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("slots"))
    return ranked.join(counts, "source_number").select("slot", "source_number", (F.col("rank") - F.col("first")).alias("source_rank"), "slots")


@dataclass
class Mix:
    """A planned mix.

    ``documents``: rank (a key of the rows), id, source_number, size, start (words before it in its source's stream).
    ``sources``: source_number, source, weight, source_size, target, words (the target in whole words).
    ``slots``: slot, source_number, source_rank, slots.
    """

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame

    def pieces(self) -> DataFrame:
        """slot, rank, start, length: the words of a document that a slot takes; a document that repeats has pieces for each time."""
        counts = self.slots.groupBy("source_number").agg(F.first("slots").alias("slots"))
        shared = self.sources.join(counts, "source_number").select("source_number", "source_size", "words", "slots")
        # the first ``longer`` blocks have one word more than the others
        shared = shared.selectExpr("*", "words div slots AS each", "words % slots AS longer")
        block = "CASE WHEN {0} < longer * (each + 1) THEN {0} div (each + 1) ELSE longer + ({0} - longer * (each + 1)) div greatest(each, 1) END"
        begin = "{0} * each + least({0}, longer)"
        return (
            self.documents.filter("size > 0").join(shared, "source_number")
            .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
            .withColumn("low", F.expr("round * source_size + start")).withColumn("high", F.expr("least(low + size, words)")).filter("low < high")
            .withColumn("source_rank", F.explode(F.sequence(F.expr(block.format("low")), F.expr(block.format("(high - 1)")))))
            .withColumn("a", F.greatest("low", F.expr(begin.format("source_rank")))).withColumn("b", F.least("high", F.expr(begin.format("(source_rank + 1)"))))
            .selectExpr("source_number", "source_rank", "rank", "a - low AS start", "b - a AS length")
            .join(self.slots.select("source_number", "source_rank", "slot"), ["source_number", "source_rank"])
            .select("slot", "rank", "start", "length")
        )

    def taken(self) -> DataFrame:
        """Every row with the words that the mix takes of it, repeats counted."""
        sums = self.pieces().groupBy("rank").agg(F.sum("length").alias("taken"))
        ours = self.documents.join(self.sources.select("source_number", "source", "source_size", "target"), "source_number")
        return ours.join(sums, "rank", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, key: str = "doc_id") -> Mix:
    """Targets, shuffled streams and slots for all rows of ``docs``."""
    order = [F.col("source").isNull(), "source", "shuffled", key, "size"]
    streams = materialize(running_total(word_counts(docs, key), order, "size", "before", "rank"), "streams")
    sources = targets(streams, weights)
    known = sources.select(F.col("source").alias("__source"), "source_number", "source_start")
    documents = streams.join(known, F.col("source").eqNullSafe(F.col("__source"))).select("rank", key, "source_number", "size", (F.col("before") - F.col("source_start")).alias("start"))
    return Mix(documents, sources, materialize(schedule(sources, block_words), "schedule"))
