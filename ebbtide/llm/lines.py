"""Line deduplication: a suffix array over line-id sequences by prefix doubling.

Every document is a sequence of line ids.  Suffixes are ranked by their first
line, then by two, four, ... lines: each round sorts the pairs of ranks of
neighbouring halves, and suffixes whose prefix occurs once drop out.  Suffixes
of equal rank are an interval whose common prefix has at least that many lines.

A run of consecutive lines counts as repeated when it has at least
``MIN_WORDS`` words.  Of every suffix the shortest run of that size from its
start, and of every end the shortest run up to it, are named by two overlapping
ranks; together they cover exactly the maximal repeated runs.  A line that lies
in such a run with an earlier copy (by doc_id, then text, then place) goes; the
first copy stays.  Runs needed here have at most ``MIN_WORDS`` lines, so the
number of doubling rounds is fixed however long documents are.

DataFrame functions only.  Lines are compared by 96 bits of hashes.

Nulls and edge cases: a null text stays null and has no lines; a line without
words weighs one word; rows that share doc_id and text are one document and
keep the same lines; a document all of whose lines go gets an empty text; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.operators.ranking import global_rank
from ebbtide.plans.scratch import materialize

MIN_WORDS = 50
#: Lists of deleted lines of at most this many documents and lines may be broadcast.
BROADCAST_DOCS, BROADCAST_LINES = 100_000, 1_000_000
_DOC = ["doc_id", "version"]
_WORD = r"[^\x20\x09-\x0D]+"


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, version, pos, hashes and weight of every line, and one end row per document."""
    def identified(x: Column) -> Column:
        words = F.regexp_count(x, F.lit(_WORD))
        return F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), F.least(F.greatest(words, F.lit(1)), F.lit(MIN_WORDS)).alias("w"))

    narrow = (
        docs.filter("text is not null")
        .select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines"))
        .select("doc_id", "version", F.transform("lines", identified).alias("ids"))
        .dropDuplicates(_DOC)
    )
    end = F.array(F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(0).alias("w")))
    return narrow.select(*_DOC, F.posexplode(F.concat("ids", end)).alias("pos", "id")).select(*_DOC, "pos", "id.a", "id.b", F.col("id.w").alias("w"))


def prefix_ranks(lines: DataFrame, levels: int) -> list[DataFrame]:
    """For k = 0 ... : (doc_id, version, pos, r), the rank of the 2**k lines from pos among those that occur again."""
    named = lines.filter("a is not null")
    often = named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    now = materialize(named.join(global_rank(often, ["a", "b"], "r"), ["a", "b"]).select(*_DOC, "pos", "r"), "ranks")
    found = [now]
    for k in range(levels - 1):
        step = 1 << k
        at = W.partitionBy(*_DOC).orderBy("pos").rangeBetween(step, step)
        pairs = now.withColumn("next", F.max("r").over(at)).filter("next is not null")
        often = pairs.groupBy("r", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("r", "next")
        ranked = global_rank(often, ["r", "next"], "both")
        now = materialize(pairs.join(ranked, ["r", "next"]).select(*_DOC, "pos", F.col("both").alias("r")), "ranks")
        if now.isEmpty():
            break
        found.append(now)
    return found


def shortest_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, version, start, size): shortest runs of ``MIN_WORDS`` words from each line and up to each line."""
    doc = W.partitionBy(*_DOC)
    before = F.coalesce(F.sum("w").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.select(*_DOC, "pos", before.alias("at"))
    by_words = doc.orderBy("at")
    # weights are at most MIN_WORDS, so a shortest run weighs less than twice that
    placed = placed.select(
        *_DOC, "pos",
        F.min("pos").over(by_words.rangeBetween(MIN_WORDS, 2 * MIN_WORDS - 1)).alias("end"),
        F.max("pos").over(by_words.rangeBetween(1 - 2 * MIN_WORDS, -MIN_WORDS)).alias("begin"),
    )
    runs = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("end").isNotNull(), F.struct(F.col("pos").alias("start"), (F.col("end") - F.col("pos")).alias("size"))),
        F.when(F.col("begin").isNotNull(), F.struct(F.col("begin").alias("start"), (F.col("pos") - F.col("begin")).alias("size"))),
    )))
    return placed.select(*_DOC, F.explode(runs).alias("run")).select(*_DOC, "run.start", "run.size").distinct()


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, version, deleted): the places of the lines that lie in a later copy of a repeated run."""
    lines = materialize(line_table(docs), "lines")
    levels = MIN_WORDS.bit_length()
    ranks = [r.withColumn("k", F.lit(k)) for k, r in enumerate(prefix_ranks(lines, levels))]
    every = ranks[0]
    for r in ranks[1:]:
        every = every.unionByName(r)
    runs = shortest_runs(lines).withColumn("k", F.floor(F.log2("size")).cast("int"))
    named = _named(runs, every.withColumnRenamed("r", "left"), every.withColumnRenamed("r", "right"))
    where = F.struct("doc_id", "version", "start")
    key = ["size", "left", "right"]
    named = materialize(named, "runs")
    again = named.groupBy(*key).agg(F.min(where).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    origin = materialize(again, "origins")  # written, so that the rows of a frequent run can be split
    copies = named.join(origin, key).filter(where > F.col("origin"))
    gone = copies.select(*_DOC, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    return gone.groupBy(*_DOC).agg(F.sort_array(F.collect_list("pos")).alias("deleted"))


def deleted_runs(deleted: DataFrame) -> DataFrame:
    """(doc_id, version, first, last): the maximal runs of lines that go, from ``later_copies``."""
    places = deleted.select(*_DOC, F.posexplode("deleted").alias("n", "pos"))
    return places.groupBy(*_DOC, (F.col("pos") - F.col("n")).alias("run")).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("run")


def _named(runs: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """Runs with the ranks of their first and last 2**k lines; runs that occur once have none and go."""
    r, f = runs.alias("r"), first.alias("f")
    one = r.join(f, F.expr("r.doc_id <=> f.doc_id and r.version = f.version and r.start = f.pos and r.k = f.k")).select(
        "r.doc_id", "r.version", "r.start", "r.size", "r.k", "f.left", F.expr("r.start + r.size - cast(pow(2, r.k) as int) as half")
    )
    o, t = one.alias("o"), last.alias("t")
    return o.join(t, F.expr("o.doc_id <=> t.doc_id and o.version = t.version and o.half = t.pos and o.k = t.k")).select(
        "o.doc_id", "o.version", "o.start", "o.size", "o.left", "t.right"
    )


def drop_repeated_lines(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """All columns and rows of ``docs`` with the cleaned text, and line counts; older columns of these names are replaced."""
    deleted = materialize(later_copies(docs), "deleted")
    docs_hit, lines_hit = deleted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("deleted")), F.lit(0))).first()
    small = docs_hit <= BROADCAST_DOCS and lines_hit <= BROADCAST_LINES
    hit = deleted.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), "deleted").withColumnRenamed("deleted", "__deleted")
    kept = [c for c in docs.columns if c not in names]
    joined = docs.select(*kept).join(
        F.broadcast(hit) if small else hit,
        F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__version")) & F.col("text").isNotNull(),
        "left",
    )
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__deleted"))
    # an array of one, so that the text is split once and not for every line
    cleaned = F.array_join(F.flatten(F.transform(F.array(lines), lambda x: F.transform(stay, lambda i: F.element_at(x, i + 1)))), "\n")
    return joined.select(
        *(F.when(F.col("__deleted").isNull(), F.col("text")).otherwise(cleaned).alias("text") if c == "text" else F.col(c) for c in kept),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(names[0]),
        F.coalesce(F.size("__deleted"), F.lit(0)).cast("long").alias(names[1]),
    )
