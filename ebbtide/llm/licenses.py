"""License scan: phrases, and an exact set-similarity join with notice templates.

A text block is a run of consecutive words, a quarter longer than a template:
line ends, comment marks and a few words put in don't matter, so wrapped
notices and whole license texts are found like one-line notices.  Tokens are
ordered by their frequency over all documents, rarest first.  A block that
holds the wanted share of a template's distinct tokens must hold one of the
template's few rarest tokens (prefix filter), have enough of its tokens near by
at all (length filter), and enough of those that are not rarer than the first
shared one (positional filter); what passes is verified run by run.

Texts are split into words once, in one scan that writes where the templates'
tokens stand, in pieces of bounded length that overlap by the longest block.
Frequencies, filters and verification work on these pieces.

DataFrame functions only; the templates are a fixed parameter, so only their
index is broadcast.

Nulls and edge cases: a null text is empty, with no words and no labels; every
row is a document of its own, so repeated rows and null ids each get their
result; tokens of equal frequency are ordered by name, which changes no result;
very long texts are cut into pieces, so no block is missed and no array is
longer than a piece; columns other than doc_id and text are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.plans.scratch import materialize

# Fixed values of the contract.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Fixed values: (label, notice), public license notices and texts in common use.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
THRESHOLD = 0.8
#: A block is so many times as long as a template.
STRETCH = 1.25
#: A piece of a text is so many of the longest blocks.
PIECE = 4

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in text order, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _parts(notice: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in notice.lower()).split()


def block_length(notice: str) -> int:
    """Words in a block that is compared with a notice."""
    return ceil(STRETCH * len(_parts(notice)))


def tokens_of(notice: str) -> list[str]:
    """Distinct words of a notice, sorted."""
    return sorted(set(_parts(notice)))


def _phrase_places(found: Column) -> Column:
    """array<struct<at, label>> of the places where a phrase's words stand one after another."""

    def of(label: str, phrase: str) -> Column:
        parts = phrase.split()
        last = F.size(found) - len(parts)

        def here(i: Column) -> Column:
            hit = F.element_at(found, i + 1) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                hit = hit & (F.element_at(found, i + 1 + k) == part)
            return hit

        places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*(of(label, phrase) for label, phrase in PHRASES.items()))


def _pieces(found: Column, tokens: list[str], length: int, overlap: int) -> Column:
    """array<struct<piece, own, hits>>: where tokens stand in each piece and the words behind it, without empty ones.

    The first ``own`` hits lie in the piece itself.
    """

    def piece(n: Column) -> Column:
        begin = n * length
        part = F.slice(found, begin + 1, F.lit(length + overlap))
        hits = F.filter(F.transform(part, lambda w, i: F.when(w.isin(tokens), F.struct((begin + i).alias("at"), w.alias("token")))), lambda h: h.isNotNull())
        return F.struct(n.alias("piece"), hits.alias("hits"))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / length).cast("int")), piece)
    return F.when(F.size(found) > 0, F.filter(cut, lambda p: F.size(p["hits"]) > 0))


def scan_words(docs: DataFrame, tokens: list[str], length: int, overlap: int) -> DataFrame:
    """(doc_id, row, n_words, places, pieces), written: one row per document with a key of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    maybe = text.rlike("(?i)license")

    def of(found: Column) -> Column:
        none = F.array().cast("array<struct<at:bigint,label:string>>")
        return F.struct(
            F.size(found).cast("long").alias("n_words"), F.when(maybe, _phrase_places(found)).otherwise(none).alias("places"), _pieces(found, tokens, length, overlap).alias("pieces")
        )

    # an array of one, so that a text is split once
    scanned = F.transform(F.array(words(text)), of)[0]
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), scanned.alias("scanned"))
    return materialize(rows.select("doc_id", "row", "scanned.*"), "words")


def token_order(pieces: DataFrame, tokens: list[str], length: int) -> list[str]:
    """The templates' tokens by their number of occurrences over all documents, rarest first.

    Any fixed order gives the same pairs; this one makes the filters sharp.
    """
    own = pieces.select("piece", F.explode("hits").alias("hit")).filter(F.col("hit.at") < (F.col("piece") + 1) * length)
    # one row per template token at most
    seen = {r["token"]: r["count"] for r in own.groupBy(F.col("hit.token").alias("token")).count().collect()}
    return sorted(tokens, key=lambda t: (seen.get(t, 0), t))


def template_blocks(pieces: DataFrame, order: list[str], length: int, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, piece, template, label, containment): the best block of each piece that meets a template's threshold."""
    spark = pieces.sparkSession
    rank = {t: k for k, t in enumerate(order)}
    index, rows = [], []
    for n, (label, notice) in enumerate(templates):
        tokens = sorted(tokens_of(notice), key=rank.get)
        need = ceil(threshold * len(tokens))
        index += [(token, n, p) for p, token in enumerate(tokens[: len(tokens) - need + 1])]
        rows.append((n, label, tokens, need, block_length(notice)))
    by_token = spark.createDataFrame(index, "token string, template int, place int")
    by_template = spark.createDataFrame(rows, "template int, label string, tokens array<string>, need int, length int")
    rare = F.array(*(F.lit(t) for t in sorted({token for token, _, _ in index})))
    probes = pieces.withColumn("seen", F.array_distinct("hits.token")).filter(F.arrays_overlap("seen", rare))
    # both tables are the fixed templates; the first place is that of the rarest shared token
    pairs = (
        probes.select("row", "piece", F.explode("seen").alias("token")).join(F.broadcast(by_token), "token")
        .groupBy("row", "piece", "template").agg(F.min("place").alias("place")).join(F.broadcast(by_template), "template")
    )
    shared = F.filter("hits", lambda h: F.array_contains("tokens", h["token"]))
    kept = F.array_intersect("seen", F.slice("tokens", F.col("place") + 1, F.size("tokens")))
    near = pairs.join(probes.select("row", "piece", "seen", "hits"), ["row", "piece"]).filter(F.size(kept) >= F.col("need")).withColumn("shared", shared)
    # a block of n words holds at most n hits from its first one on
    block = "filter(slice(shared, i + 1, length), b -> b.at < a.at + length)"
    most = F.expr(f"array_max(transform(shared, (a, i) -> if(a.at < (piece + 1) * {length}, size(array_distinct(transform({block}, b -> b.token))), 0)))")
    return (
        near.withColumn("most", most).filter("most >= need")
        .select("row", "piece", "template", "label", (F.col("most") / F.size("tokens")).alias("containment"))
    )


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    overlap = max(block_length(notice) for _, notice in templates)
    length = PIECE * overlap
    tokens = sorted({t for _, notice in templates for t in tokens_of(notice)})
    scanned = scan_words(docs, tokens, length, overlap)
    pieces = scanned.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    blocks = template_blocks(pieces, token_order(pieces, tokens, length), length, templates)
    found = blocks.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.select("doc_id", "row", "n_words", "places").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
