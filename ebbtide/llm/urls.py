"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

Where a rule fits, the longest one decides.  Other URLs are judged by boosted
trees trained on labelled URLs that no rule decides: a rule is a policy about
names, of which lexical features say nothing (trained on rules' verdicts too,
the trees blocked 2 to 3 % of clean URLs here).  The labels come from a lexicon
of words that spam hosts are made of; the rest counts as allowed.
The trees see no name and no label of their own host:
only lengths, depth, digit ratio, dashes, character entropy, parameter counts
and the share of blocked URLs of the host's suffix, taken over the
hosts of the other folds.  So they also judge names that the lexicon lacks.

DataFrame functions and the JVM's tree learner only.  The learner is fitted on
one labelled URL of each of about ``SAMPLE`` hosts at most, taken by hash.

Nulls and edge cases: a URL that is null or has no ``://`` has an empty host
and path and fits no rule; without labelled URLs of both kinds all other URLs
are allowed; of rules of equal length the one listed later decides; a very long
URL counts whole; repeated rows and rows without page_id each get their result;
columns other than page_id and url are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.plans.scratch import materialize

# Fixed values of the contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Whole words of a host name, as parted by dots and dashes, that label a URL as spam.
SPAM_WORDS = ("adult", "bet", "bets", "casino", "cheap", "crack", "loan", "loans", "pills", "poker", "porn", "replica", "spam", "viagra", "win")
#: Hosts that the learner is fitted on, one URL of each, so that a host of many URLs weighs no more than others.
SAMPLE = 20_000
TREES, DEPTH = 20, 4
#: Least number and share of the learnt hosts in a leaf, so that no leaf knows a single host by its length.
LEAF, LEAF_SHARE = 3, 0.001
#: Hosts are dealt to so many folds; a suffix's share of blocked URLs leaves the own fold out.
FOLDS = 5
#: Suffix statistics of at most this many rows are broadcast.
BROADCAST_SUFFIXES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "dashes", "entropy", "parameters", "has_fragment", "is_plain",
    "suffix_share", "suffix_blocked",
)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.length(text).cast("double")

    def part(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char))) / size
        return total - share * F.log2(share)

    chars = F.array_distinct(F.split(text, ""))
    return F.when(size > 0, F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), part)).otherwise(F.lit(0.0))


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def lexical(pages: DataFrame) -> DataFrame:
    """Add the features that a URL has by itself, its suffix and its host's fold."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    return pages.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
            "labels": F.size(F.split(host, r"\.")).cast("double"),
            "digit_ratio": _share(url, "[0-9]"),
            "dashes": F.regexp_count(host, F.lit("-")).cast("double"),
            "entropy": entropy(url),
            "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
            "has_fragment": url.contains("#").cast("double"),
            "is_plain": url.startswith("http://").cast("double"),
            "__suffix": F.substring_index(host, ".", -1),
            "__fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"),
        }
    )


def suffix_statistics(labelled: DataFrame, total: int, prior: float) -> DataFrame:
    """(suffix, fold, suffix_share, suffix_blocked), written: a suffix's share of all URLs, and of blocked URLs among its hosts in the other folds."""
    within = labelled.groupBy("__suffix", "__fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))
    whole = within.groupBy("__suffix").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
    rest = (F.col("all_blocked") - F.col("blocked") + 2 * prior) / (F.col("all_n") - F.col("n") + 2)
    return materialize(within.join(whole, "__suffix").select("__suffix", "__fold", (F.col("all_n") / total).alias("suffix_share"), rest.alias("suffix_blocked")), "suffixes")


def labelled_urls(pages: DataFrame, rules=RULES, spam_words=SPAM_WORDS) -> DataFrame:
    """Host, path, rule, its verdict, lexical features and label of every page, written."""
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    label = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, spam_words))).cast("double")
    return materialize(lexical(base).withColumns({"rule": rule, "ruled": verdict, "label": label}), "urls")


def block_probability(ruled: DataFrame, taught: Column | None = None) -> DataFrame | None:
    """``ruled`` with the learner's probability of block; None without labelled URLs of both kinds.

    Learnt from are the URLs that no rule decides, of which ``taught`` may leave some out; all rows are judged.
    """
    usable = (F.col("host") != "") & F.col("rule").isNull()
    usable = usable if taught is None else usable & taught
    labelled = ruled.filter(usable)
    total, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < total:
        return None
    prior = blocked / total
    vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="__features")
    suffixes = suffix_statistics(labelled, total, prior)
    few = suffixes.count() <= BROADCAST_SUFFIXES
    known = ruled.join(F.broadcast(suffixes) if few else suffixes, ["__suffix", "__fold"], "left").fillna({"suffix_blocked": prior, "suffix_share": 0.0})
    # by hash of the host, about SAMPLE hosts are left, which one small partition holds in a fixed order
    labelled = known.filter(usable)
    hosts = labelled.agg(F.approx_count_distinct("host")).first()[0]
    drawn = labelled.filter(F.pmod(F.xxhash64("host", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / hosts)) + 1)
    one = F.min(F.struct(F.xxhash64("page_id", "url").alias("drawn"), "url", "label", *_FEATURES)).alias("one")
    sample = drawn.groupBy("host").agg(one).select("host", "one.*").repartition(1).sortWithinPartitions("host")
    sample = materialize(vectors.transform(sample).select("__features", "label"), "sample")
    learner = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=max(LEAF, int(LEAF_SHARE * sample.count())), seed=7, predictionCol="__prediction")
    model = learner.setRawPredictionCol("__raw").setProbabilityCol("__probability").fit(sample)
    return model.transform(vectors.transform(known)).withColumn("block_probability", vector_to_array("__probability")[1])


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the learner's probability of block, one row per page."""
    ruled = labelled_urls(pages, rules)
    judged = block_probability(ruled)
    columns = ["page_id", "host", "path", "rule"]
    if judged is None:
        return ruled.select(*columns, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    learnt = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return judged.select(*columns, F.coalesce("ruled", learnt).alias("verdict"), "block_probability")
