"""Secret scan with multipart credential linking.

Strong patterns are reported wherever they stand.  Weak ones (user names, long
opaque keys, service addresses) prove nothing alone: they are reported only
when a complementary part of a credential stands within their scope, and the
nearest such part is reported as their partner.  A scope is the stretch of
``SCOPE`` characters to both sides of a part inside its section: a blank line
or a line that begins with a bracket ends a section.  Parts meet in an interval
join on section and stretch, so only parts near each other are ever paired.

Texts are read once, in one scan that writes how long the matches of each kind
and the gaps between them are; all else works on these lengths.

DataFrame functions only.  Spans are code points, the end exclusive.

Nulls and edge cases: a null text is empty and has no spans; every row is a
document of its own, so repeated rows and null ids each get their result; of
two partners at equal distance the earlier one is reported; very long texts are
split into matches and gaps, never joined with themselves; columns other than
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.plans.scratch import materialize


@dataclass(frozen=True)
class Kind:
    """A pattern; the length of ``value``, a group of it, must reach ``least`` and not exceed ``most``."""

    name: str
    pattern: str
    value: int
    least: int
    role: str
    strong: bool
    most: int = (1 << 31) - 1


# Fixed values of the contract.
BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret", True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "identifier", True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "secret", True),
)
WEAK = (
    Kind("login", r"""(?i:(user|username|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 2, 3, "identifier", False),
    Kind("opaque", r"[A-Za-z0-9+/]{40,}", 0, 40, "secret", False, 40),
    Kind("endpoint", r"""(?i:[a-z][a-z0-9+.-]*)://[^\x20\x09-\x0D"'<>]+""", 0, 8, "endpoint", False),
)
#: Ends of sections: a blank line, or a line that begins with a bracket.
SECTION = Kind("section", r"\n[\x20\t\r]*(?:\n|\[)", 0, 0, "section", False)
KINDS = (*BASE, *WEAK, SECTION)
#: Roles that make a weak part of a role worth reporting.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret", "identifier")}
#: Largest distance between the starts of linked parts.
SCOPE = 300
#: Texts that this doesn't match hold no part at all.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|(?i:user|login|account|client_?id)(?i:name)?[\"']?\x20*[:=]|[A-Za-z0-9+/]{40}|://"


def _lengths(kind: Kind) -> Column:
    """Lengths of the gap before, the match and its value, of each match of a kind in text order."""

    def sizes(parts: Column) -> Column:
        return F.transform(parts, F.length)

    match = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(kind.value))
    gap = F.split("text", kind.pattern, -1)
    # the last gap, behind all matches, is of no use
    return F.filter(F.arrays_zip(sizes(gap).alias("gap"), sizes(match).alias("match"), sizes(value).alias("value")), lambda x: x["match"].isNotNull())


def match_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, row, k0, k1, ...), written: every document with a key of its own and its matches of every kind, null where it has none."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(F.col("text").rlike(_ANY), F.col("text")).alias("text"))
    weak = F.lit(False)
    for kind in WEAK:
        weak = weak | F.col("text").rlike(kind.pattern)
    columns = [F.when(F.col("text").rlike(k.pattern) & (weak if k is SECTION else F.lit(True)), _lengths(k)).alias(f"k{n}") for n, k in enumerate(KINDS)]
    return materialize(rows.select("doc_id", "row", *columns), "matches")


def credential_parts(lengths: DataFrame) -> DataFrame:
    """(row, number, kind, role, strong, section, start, end) of every part; a match starts behind all gaps and matches before it."""
    every = F.array(*(F.struct(F.lit(n).alias("number"), F.col(f"k{n}").alias("matches")) for n in range(len(KINDS))))
    rows = (
        lengths.select("row", F.explode(every).alias("of"))
        .select("row", "of.number", F.posexplode("of.matches").alias("k", "match"))
        .select("row", "number", "k", "match.*")
    )
    before = W.partitionBy("row", "number").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("match")).over(before), F.lit(0))
    fits = F.lit(False)
    for n, kind in enumerate(KINDS):
        fits = fits | ((F.col("number") == n) & F.col("value").between(kind.least, kind.most))
    upto = W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("start", start).filter(fits).withColumn("section", F.count_if(F.col("number") == len(KINDS) - 1).over(upto))

    def of(field: str) -> Column:
        return F.element_at(F.array(*(F.lit(getattr(k, field)) for k in KINDS)), F.col("number") + 1).alias(field)

    parts = placed.filter(F.col("number") < len(KINDS) - 1)
    return parts.select("row", "number", of("name").alias("kind"), of("role"), of("strong"), "section", "start", (F.col("start") + F.col("match")).alias("end"))


def partners(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, number, start, partner) of the weak parts with a complementary part in scope; ``partner`` is the nearest one."""
    wanted = F.create_map(*(x for role, others in COMPLEMENTS.items() for x in (F.lit(role), F.array(*map(F.lit, others)))))
    stretch = F.floor(F.col("start") / scope)
    weak = (
        parts.filter("not strong")
        .select("row", "number", "section", "start", stretch.alias("at"), F.explode(wanted[F.col("role")]).alias("role"))
        .select("*", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)).alias("stretch"))
        .drop("at")
    )
    other = parts.select("row", "section", "role", stretch.alias("stretch"), F.col("start").alias("there"), F.struct("kind", "start", "end").alias("part"))
    away = F.abs(F.col("start") - F.col("there"))
    near = weak.join(other, ["row", "section", "role", "stretch"]).filter(away <= scope)
    return near.groupBy("row", "number", "start").agg(F.min(F.struct(away.alias("away"), "part.start", "part.kind", "part.end")).alias("partner"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and links of every document.

    ``links`` lists each weak span with its partner, as span>span.
    """
    lengths = match_lengths(docs)
    parts = materialize(credential_parts(lengths), "parts")
    near = parts.join(partners(parts), ["row", "number", "start"], "left")
    text = F.concat_ws(":", "kind", "start", "end")
    span = F.struct("start", "number", text.alias("span"))
    link = F.struct("start", "number", F.concat(text, F.lit(">"), F.concat_ws(":", "partner.kind", "partner.start", "partner.end")).alias("span"))
    counts = [F.count_if(F.col("kind") == kind.name).alias(f"n_{kind.name}") for kind in BASE]
    base = [kind.name for kind in BASE]
    found = near.filter(F.col("strong") | F.col("partner").isNotNull()).groupBy("row").agg(
        *counts,
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(base), span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("every"),
        F.array_sort(F.collect_list(F.when(F.col("partner").isNotNull(), link))).alias("linked"),
    )
    return lengths.select("doc_id", "row").join(found, "row", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in base),
        F.sha2(F.coalesce(F.array_join("base.span", ","), F.lit("")), 256).alias("base_sha256"),
        *(F.coalesce(F.array_join(f"{a}.span", ","), F.lit("")).alias(b) for a, b in (("every", "spans"), ("linked", "links"))),
    )
