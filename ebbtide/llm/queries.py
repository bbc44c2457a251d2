"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ebbtide.llm.conversations import damaged, repair_report
from ebbtide.llm.decontamination import contaminated
from ebbtide.llm.embeddings import THRESHOLD as EMBEDDING_THRESHOLD
from ebbtide.llm.embeddings import embedding_links
from ebbtide.llm.language import held_out, identify
from ebbtide.llm.licenses import TEMPLATES, THRESHOLD, block_length, scan_licenses, tokens_of
from ebbtide.llm.lines import drop_repeated_lines
from ebbtide.llm.minhash import near_duplicates
from ebbtide.llm.mixing import MOST, WEIGHTS, plan_mix
from ebbtide.llm.packing import pack_documents, tokenizer_files
from ebbtide.llm.secrets import BASE, COMPLEMENTS, KINDS, SCOPE, scan_secrets
from ebbtide.llm.sharding import shard_documents
from ebbtide.llm.textkit import small_batches
from ebbtide.llm.urls import judge_urls
from ebbtide.llm.whitening import whiten
from ebbtide.plans.scratch import materialize

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; row counts differ by one at most."""
    placed = shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 1024 tokens as best fit needs."""
    return pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it contains at least 0.75 of the shingles."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them go as later copies, and a digest of what stays."""
    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = identify(docs).withColumn("held_out", held_out())
    with small_batches(spark):
        return materialize(judged.select("doc_id", "held_out", "lang_pred", "score", "rejected"), "languages")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources in the weights 1, 2, 3 takes of every document."""
    return plan_mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and a hash of the repaired text of every conversation, after a known damage."""
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every embedding; a deviation beyond 64 bits would be null."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = {
    "pipeline": pipeline,
    "op1_embeddings": op1_embeddings,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_urls": op7_urls,
    "op8_line_dedup": op8_line_dedup,
    "op9_language": op9_language,
    "op10_minhash": op10_minhash,
    "op11_mixing": op11_mixing,
    "op12_conversations": op12_conversations,
    "op13_whitening": op13_whitening,
}

#: Words are split at ASCII white space after lower-casing A-Z; shorter texts are one shingle.
_SHINGLES = r"""
    {name}_words AS (
        SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
        FROM {table}),
    {name} AS (
        SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM {name}_words WHERE len(w) > 0)
"""
_NOTICES = ", ".join(f"({n}, '{label}', {block_length(notice)}, {tokens_of(notice)!r})" for n, (label, notice) in enumerate(TEMPLATES))



def _secrets_sql() -> str:
    """All spans as rows, a kind at a time; a match starts behind all gaps and matches before it."""
    kinds = []
    for n, k in enumerate(KINDS):
        pattern = k.pattern.replace("'", "''")
        kinds.append(
            f"SELECT row, {n} AS number, '{k.name}' AS kind, '{k.role}' AS role, {str(k.strong).lower()} AS strong, {k.least} AS least, {k.most} AS most, "
            f"list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: length(x)) AS hits, "
            f"list_transform(regexp_extract_all(text, '{pattern}', {k.value}), lambda x: length(x)) AS sizes FROM d WHERE regexp_matches(text, '{pattern}')"
        )
    roles = ", ".join(f"('{role}', '{other}')" for role, others in COMPLEMENTS.items() for other in others)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({" UNION ALL ".join(kinds)}),
    u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
    s AS (SELECT row, number, kind, role, strong, (list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0))::BIGINT AS pos, hits[i] AS long
        FROM u WHERE sizes[i] BETWEEN least AND most),
    p AS (SELECT *, count(CASE WHEN kind = 'section' THEN 1 END) OVER (PARTITION BY row ORDER BY pos) AS section,
        kind || ':' || pos || ':' || (pos + long) AS span FROM s),
    c(role, other) AS (VALUES {roles}),
    near AS (SELECT a.row, a.number, a.pos, a.span, arg_min(b.span, (abs(a.pos - b.pos), b.pos, b.kind, b.long)) AS partner
        FROM p a JOIN c ON c.role = a.role JOIN p b ON b.row = a.row AND b.role = c.other AND b.section = a.section AND abs(a.pos - b.pos) <= {SCOPE}
        WHERE NOT a.strong AND a.kind <> 'section' AND b.kind <> 'section' GROUP BY ALL),
    f AS (SELECT p.row, p.number, p.kind, p.pos, p.span, p.span || '>' || partner AS link FROM p LEFT JOIN near USING (row, number, pos)
        WHERE p.kind <> 'section' AND (p.strong OR partner IS NOT NULL)),
    g AS (SELECT row, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access, count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex,
        string_agg(CASE WHEN number < {len(BASE)} THEN span END, ',' ORDER BY pos, number) AS base, string_agg(span, ',' ORDER BY pos, number) AS spans,
        string_agg(link, ',' ORDER BY pos, number) AS links FROM f GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
    FROM d LEFT JOIN g USING (row)
    """


def _conversations_sql() -> str:
    """All states' best edits grow row by row in one recursion, as whole strings; the checksum is taken bit by bit."""

    def then(of: str, price: str, letter: str, line: str = "") -> str:
        text = f"{of}.t" if not line else f"list_append({of}.t, {line})"
        return f"CASE WHEN {of} IS NOT NULL THEN struct_pack(c := ({of}.c + {price})::INT, p := {of}.p || '{letter}', t := {text}) END"

    def best(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"

    def given(condition: str, option: str) -> str:
        return f"CASE WHEN {condition} THEN {option} END"

    user, assistant = "'user:'", "'assistant:'"
    keep, rerole = "CASE WHEN truncated THEN 3 ELSE 0 END", "CASE WHEN truncated THEN 6 ELSE 3 END"
    row, as_user, as_assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    ready = "NOT blank AND NOT duplicate"
    return f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
    k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
    h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT)),
        lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM k, crc),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_extract(text, '[^\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$')[1] AS last FROM d),
    r AS (SELECT conv_id, turn, role, text, i, role[1] AS initial, last = '' OR last IS NULL AS blank, again AND last <> '' AS duplicate,
        last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM f),
    n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN blank THEN 1 END) AS blank, count(CASE WHEN duplicate THEN 1 END) AS duplicate,
        count(CASE WHEN truncated THEN 1 END) AS truncated, count(CASE WHEN pair NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal FROM r GROUP BY conv_id),
    nothing AS (SELECT struct_pack(c := 0::INT, p := '', t := []::VARCHAR[]) AS o),
    v AS (
        SELECT conv_id, 0::BIGINT AS i, o, NULL::STRUCT(c INT, p VARCHAR, t VARCHAR[]) AS s, NULL::STRUCT(c INT, p VARCHAR, t VARCHAR[]) AS u, NULL::STRUCT(c INT, p VARCHAR, t VARCHAR[]) AS a FROM n, nothing
        UNION ALL
        SELECT conv_id, i, {then('o', '4', 'D')},
            {best(then('s', '4', 'D'), given(f"{ready} AND initial = 's'", then('o', keep, 'K', row)))},
            {best(then('u', '4', 'D'), *(given(f"{ready} AND initial = 'u'", then(q, keep, 'K', row)) for q in 'osa'), *(given(ready, then(q, rerole, 'R', as_user)) for q in 'osa'))},
            {best(then('a', '4', 'D'), given(f"{ready} AND initial = 'a'", then('u', keep, 'K', row)), given(ready, then('u', rerole, 'R', as_assistant)))}
        FROM (SELECT conv_id, i, role, text, initial, blank, duplicate, truncated, o, s, {best('u1', then('a1', '3', 'I', user))} AS u, a1 AS a
            FROM (SELECT *, {best('a', then('u1', '3', 'I', assistant))} AS a1
            FROM (SELECT r.conv_id, r.i, role, text, initial, blank, duplicate, truncated, o, s, a, {best('u', *(then(q, '3', 'I', user) for q in 'osa'))} AS u1
            FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1)))),
    w AS (SELECT v.conv_id, {best('o', 'a', then('u', '3', 'I', assistant), then(then('s', '3', 'I', user).join(['(', ')']), '3', 'I', assistant))} AS x
        FROM v JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND n.rows = v.i)
    SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
        coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.p, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id
    """


_ORACLES = {
    "op11_mixing": r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {many} + 1 AS weight FROM d GROUP BY source),
    o AS (SELECT *, {most} * source_size AS most, sum(source_size) OVER () AS total,
        sum({most} * source_size) OVER (ORDER BY {most} * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        sum(weight) OVER (ORDER BY {most} * source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM s),
    l AS (SELECT total - coalesce(before, 0) AS words, shares FROM o WHERE (total - coalesce(before, 0)) * weight <= most * shares ORDER BY words DESC, shares DESC LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN words * weight > most * l.shares THEN most ELSE words::DOUBLE * weight / l.shares::DOUBLE END AS target FROM o, l),
    p AS (SELECT doc_id, size, source_size, target, floor(target + 0.5) AS words,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
    SELECT doc_id, size, source_size, target, list_sum(list_transform(range({most}), lambda k: greatest(0, least(k * source_size + start + size, words) - k * source_size - start)))::BIGINT AS taken FROM p
    """.format(most=MOST, many=len(WEIGHTS)),
    "op12_conversations": _conversations_sql(),
    "op4_licenses": r"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
    p AS (SELECT doc_id, t, len(w) AS n_words,
        list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
        list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
        list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl FROM w),
    b AS (SELECT *, list_concat(mit, apache, gpl) AS places,
        list_concat(CASE WHEN len(apache) > 0 THEN ['apache'] ELSE [] END, CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END, CASE WHEN len(mit) > 0 THEN ['mit'] ELSE [] END) AS base FROM p),
    n(template, label, length, ids) AS (VALUES {notices}),
    nt AS (SELECT template, length, unnest(ids) AS token FROM n),
    i AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM w),
    x AS (SELECT doc_id, pos, w[pos + 1] AS token FROM i),
    y AS (SELECT doc_id, template, length, pos, token FROM x JOIN nt USING (token)),
    z AS (SELECT doc_id, template FROM y JOIN n USING (template) GROUP BY doc_id, template, ids HAVING count(DISTINCT token) >= ceil({threshold} * len(ids))),
    r AS (SELECT y.* FROM y SEMI JOIN z ON z.doc_id = y.doc_id AND z.template = y.template),
    o AS (SELECT a.doc_id, a.template, a.pos, count(DISTINCT b.token) AS n FROM r a JOIN r b
        ON a.doc_id = b.doc_id AND a.template = b.template AND b.pos >= a.pos AND b.pos < a.pos + a.length GROUP BY a.doc_id, a.template, a.pos),
    h AS (SELECT doc_id, list(DISTINCT label) AS more, max(o.n / len(ids)) AS best FROM o JOIN n USING (template) WHERE o.n >= ceil({threshold} * len(ids)) GROUP BY doc_id)
    SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
        array_to_string(base, ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
        greatest(coalesce(best, 0), CASE WHEN len(places) > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
    FROM b LEFT JOIN h USING (doc_id)
    """.format(notices=_NOTICES, threshold=THRESHOLD),
    "op1_embeddings": """
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {threshold}),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
    FROM embeddings LEFT JOIN many ON many.a = vec_id LEFT JOIN least ON least.a = vec_id
    """.format(threshold=EMBEDDING_THRESHOLD),
    "op5_secrets": _secrets_sql(),
    "op10_minhash": "WITH RECURSIVE " + _SHINGLES.format(name="d", key="doc_id", table="documents")
    + """, sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    same AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM d x JOIN d y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
    links AS (SELECT a, b FROM same JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same.n >= 75 * (p.n + q.n - same.n)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = doc_id
    """,
    "op8_line_dedup": r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, lines, unnest(range(0, len(lines) + 1)) AS pos FROM d WHERE text IS NOT NULL),
    w AS (SELECT doc_id, lines, pos, CASE WHEN pos = len(lines) THEN 0
        ELSE least(greatest(len(regexp_extract_all(lines[pos + 1], '[^\x20\x09-\x0D]+')), 1), 50) END AS w FROM l),
    b AS (SELECT doc_id, lines, pos, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM w),
    runs AS (
        SELECT x.doc_id, any_value(x.lines) AS lines, x.pos AS s, min(y.pos) AS e FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.a >= x.a + 50 GROUP BY x.doc_id, x.pos
        UNION
        SELECT y.doc_id, any_value(y.lines), max(x.pos), y.pos FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.a >= x.a + 50 GROUP BY y.doc_id, y.pos),
    named AS (SELECT doc_id, s, e, array_to_string(lines[s + 1:e], chr(10)) AS run FROM runs),
    later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS n FROM named) WHERE n > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, e)) AS p FROM later) GROUP BY doc_id)
    SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_deleted,
        sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
            list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)), '') END) AS text_sha256
    FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op3_decontamination": "WITH " + _SHINGLES.format(name="d", key="doc_id", table="documents") + ","
    + _SHINGLES.format(name="b", key="item_id", table="benchmark")
    + """, sizes AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
    SELECT doc_id, item_id, count(*)::BIGINT AS common, item_shingles::BIGINT AS item_shingles, count(*)::DOUBLE / item_shingles AS containment
    FROM d JOIN b USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING 4 * count(*) >= 3 * item_shingles
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
