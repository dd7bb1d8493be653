"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm import archives, code_compression, decontaminate, exact_dedup, language_id, licenses, near_dedup, packing, quality, secret_scan, suffix_dedup, tool_calls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Two increments over all documents: the base rules, then all rules with what the ledger holds by then.
    ledger, findings, _ = secret_scan.scan(docs, rules=secret_scan.BASE_RULES)
    _, _, found = secret_scan.scan(docs, ledger=ledger, findings=findings)
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(secret_scan.spans(F.filter("findings", lambda f: f["kind"].isin(base))), 256).alias("base_sha256"),
        secret_scan.spans(F.col("findings")).alias("spans"),
    )


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """SQL for one kind's spans in the text t: a list of structs."""
    pattern = pattern.replace("'", "''")
    total = lambda x: f"coalesce(list_sum({x}), 0)"
    test = f" WHERE g[i] >= {least}" if least else ""
    return f"""(SELECT list({{'s': p, 'r': {rank}, 'e': p + m[i], 'k': '{kind}'}}) FROM (
        SELECT i, m, g, CAST({total('b[1:i]')} + {total('m[1:i-1]')} AS BIGINT) AS p FROM (
            SELECT unnest(range(1, len(m) + 1)) AS i, b, m, g FROM (SELECT
                list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS b,
                list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS m,
                list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS g))){test})"""


OP2_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_sort(list_concat({", ".join(f"coalesce({_spans_sql(r.kind, i, r.pattern, r.group, r.least)}, [])" for i, r in enumerate(secret_scan.RULES))})) AS f FROM docs),
texts AS (SELECT doc_id, f, list_transform(f, lambda x: x.k || ':' || x.s || ':' || x.e) AS a,
                 list_transform(list_filter(f, lambda x: x.r < 3), lambda x: x.k || ':' || x.s || ':' || x.e) AS b FROM found)
SELECT doc_id, CAST(len(list_filter(f, lambda x: x.r = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(f, lambda x: x.r = 1)) AS BIGINT) AS n_access,
       CAST(len(list_filter(f, lambda x: x.r = 2)) AS BIGINT) AS n_hex, sha256(coalesce(array_to_string(b, ','), '')) AS base_sha256,
       coalesce(array_to_string(a, ','), '') AS spans
FROM texts
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "links", "nearest")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP5_SQL = f"""
WITH t AS (SELECT *, greatest(1, length // {licenses.STEPS}) AS step FROM (VALUES {", ".join(f"({_text(name)}, {_text(pair)}, {n}, {m})" for name, pair, n, m in licenses.template_rows(licenses.TEMPLATES))}) AS v(license, bigram, license_bigrams, length)),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT doc_id, r, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM d WHERE len(w) > 1),
h AS (SELECT doc_id, r, pos, b.bigram, license, license_bigrams AS n, length AS m, step FROM b JOIN t USING (bigram)),
c AS (SELECT r, license, n FROM h GROUP BY ALL HAVING count(DISTINCT bigram) >= ceil({licenses.DICE} / (2 - {licenses.DICE}) * n - 1e-9)),
s AS (SELECT h.*, size, CAST(ceil(m * size / step) AS BIGINT) + 1 AS blocks FROM h SEMI JOIN c ON h.r = c.r AND h.license = c.license, (VALUES {", ".join(f"({x}::DOUBLE)" for x in licenses.SIZES)}) AS z(size)),
x AS (SELECT doc_id, r, license, n, m, size, pos, bigram, unnest(range(pos // step - blocks + 1, pos // step + 1)) AS win FROM s),
u AS (SELECT DISTINCT doc_id, r, license, n, m, min(pos) AS low, max(pos) AS high, count(DISTINCT bigram) AS shared FROM x GROUP BY doc_id, r, license, n, m, size, win),
v AS (SELECT u.doc_id, u.r, license, n, m, low, high, shared, count(DISTINCT b.bigram) AS own FROM u JOIN b ON b.r = u.r AND b.pos BETWEEN low AND high
      WHERE shared >= ceil({licenses.DICE} / (2 - {licenses.DICE}) * n - 1e-9) GROUP BY ALL),
q AS (SELECT *, 2.0::DOUBLE * shared / (own + n) AS score FROM v WHERE 2.0::DOUBLE * shared / (own + n) >= {licenses.DICE} - 1e-9),
best AS (SELECT a.* FROM q a ANTI JOIN q o ON a.r = o.r AND a.license = o.license
         AND abs(CAST(floor(a.low * {licenses.PLACES} / a.m) AS BIGINT) - CAST(floor(o.low * {licenses.PLACES} / o.m) AS BIGINT)) < {licenses.PLACES}
         AND (o.score > a.score OR (o.score = a.score AND (o.high - o.low < a.high - a.low OR (o.high - o.low = a.high - a.low AND o.low < a.low)))))
SELECT doc_id, license, CAST(low AS INTEGER) AS first_word, CAST(high - low + 2 AS INTEGER) AS words, shared, CAST(own AS INTEGER) AS unit_bigrams, n AS license_bigrams, round(score, 6) AS dice
FROM best
"""


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.derived_calls(table(spark, sf_dir, "conversations")))


OP6_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, text AS content, length(coalesce(text, '')) AS n, len(string_split(coalesce(text, ''), ' ')) AS w FROM conversations),
made AS (
    SELECT conv_id, 'c' || turn AS call_id, turn, n, w, to_json(text) AS j,
           CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'lookup' END AS tool,
           list_concat(CASE WHEN n % 5 = 0 THEN ['c' || (turn + 2)] ELSE [] END, CASE WHEN w % 2 = 0 THEN ['c' || (turn - 2)] ELSE [] END) AS needs
    FROM t WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS n_calls, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, tool, j) AS k FROM made),
calls AS (SELECT * FROM ranked WHERE k = 1),
answers AS (
    SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS result_turn, min(content) AS content, count(*) AS n_results
    FROM t WHERE role = 'user' AND turn > 0 AND conv_id IS NOT NULL GROUP BY ALL),
wanted AS (SELECT conv_id, call_id, turn, unnest(needs) AS needs FROM calls),
edges AS (SELECT a.conv_id, a.turn, b.turn AS needs FROM wanted a JOIN calls b ON a.conv_id = b.conv_id AND a.needs = b.call_id),
lacking AS (SELECT DISTINCT conv_id, call_id FROM wanted a ANTI JOIN calls b ON a.conv_id = b.conv_id AND a.needs = b.call_id),
reach AS (
    SELECT conv_id, turn, needs AS far FROM edges
    UNION
    SELECT r.conv_id, r.turn, e.needs FROM reach r JOIN edges e ON r.conv_id = e.conv_id AND r.far = e.turn),
label AS (SELECT c.conv_id, c.turn, greatest(c.turn, coalesce(max(far), c.turn)) AS order_turn, coalesce(bool_or(far = c.turn), false) AS round
          FROM calls c LEFT JOIN reach r ON c.conv_id = r.conv_id AND c.turn = r.turn GROUP BY c.conv_id, c.turn),
cyclic AS (
    SELECT conv_id, turn FROM label WHERE round
    UNION SELECT a.conv_id, a.turn FROM reach r JOIN label a ON r.conv_id = a.conv_id AND r.turn = a.turn
    JOIN label b ON r.conv_id = b.conv_id AND r.far = b.turn WHERE b.round AND a.order_turn = b.order_turn),
sound AS (SELECT e.conv_id, e.turn, e.needs FROM edges e JOIN label a ON e.conv_id = a.conv_id AND e.turn = a.turn JOIN label b ON e.conv_id = b.conv_id AND e.needs = b.turn
          ANTI JOIN cyclic c ON e.conv_id = c.conv_id AND e.turn = c.turn WHERE a.order_turn = b.order_turn),
hops AS (
    SELECT conv_id, turn, needs AS at, 1 AS hops FROM sound
    UNION
    SELECT h.conv_id, h.turn, s.needs, h.hops + 1 FROM hops h JOIN sound s ON h.conv_id = s.conv_id AND h.at = s.turn),
deepest AS (SELECT conv_id, turn, max(hops) AS hops FROM hops GROUP BY ALL),
linked AS (
    SELECT c.*, l.order_turn, coalesce(d.hops, 0) AS order_hops, y.turn IS NOT NULL AS cycle, a.result_turn, a.content, a.n_results,
           n % 3 = 2 AND n % 11 = 0 AS broken, k.call_id IS NOT NULL AS lacks,
           CASE WHEN n % 3 = 0 AND n % 7 = 0 THEN 'limit: not integer' WHEN n % 3 = 1 AND n % 5 = 0 THEN 'to: not allowed' ELSE '' END AS problems
    FROM calls c JOIN label l ON c.conv_id = l.conv_id AND c.turn = l.turn
    LEFT JOIN cyclic y ON c.conv_id = y.conv_id AND c.turn = y.turn
    LEFT JOIN deepest d ON c.conv_id = d.conv_id AND c.turn = d.turn
    LEFT JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
    LEFT JOIN lacking k ON c.conv_id = k.conv_id AND c.call_id = k.call_id)
SELECT conv_id, call_id, turn, order_turn, CAST(order_hops AS INTEGER) AS order_hops,
       CASE WHEN broken THEN 'invalid_json' WHEN problems <> '' THEN 'invalid_arguments' WHEN cycle THEN 'cycle' WHEN lacks THEN 'missing_dependency'
            WHEN n_results IS NULL THEN 'missing_result' ELSE 'linked' END AS status,
       problems, n_calls, coalesce(n_results, 0) AS n_results, result_turn,
       '{"arguments":' || CASE WHEN broken THEN 'null' WHEN n % 3 = 0 THEN '{"limit":' || CASE WHEN n % 7 = 0 THEN '"' || w || '"' ELSE '' || w END || ',"query":' || j || '}'
            WHEN n % 3 = 1 THEN '{"text":' || j || ',"to":"' || CASE WHEN n % 5 = 0 THEN 'xx' ELSE 'en' END || '"}' ELSE '{"exact":true,"id":' || turn || '}' END
       || ',"id":"' || call_id || '","result":' || coalesce(to_json(content), 'null') || ',"tool":"' || tool || '"}' AS line
FROM linked
UNION ALL
SELECT a.conv_id, a.call_id, NULL, a.result_turn, 0, 'orphan_result', '', 0, a.n_results, a.result_turn, NULL
FROM answers a ANTI JOIN calls c ON a.conv_id = c.conv_id AND a.call_id = c.call_id
"""


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archives.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()).select("text", "lang"))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.length("bytes").cast("bigint").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, run: n + run["high"] - run["low"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, low, substr(h, 2 * low + 1, 2 * {2 * suffix_dedup.WINDOW - 1}) AS part FROM (
    SELECT r, h, unnest(range(0, greatest(length(h) // 2 - {suffix_dedup.WINDOW - 1}, 0), {suffix_dedup.WINDOW})) AS low FROM d)),
w AS (SELECT r, low + s AS s, md5_number(substr(part, 2 * s + 1, {2 * suffix_dedup.WINDOW})) AS k FROM (
    SELECT r, low, part, unnest(range(0, length(part) // 2 - {suffix_dedup.WINDOW - 1})) AS s FROM c)),
again AS (SELECT r, s FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) m ON w.k = m.k),
opened AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + {suffix_dedup.WINDOW} THEN 1 ELSE 0 END AS fresh FROM again),
runs AS (SELECT r, min(s) AS low, max(s) + {suffix_dedup.WINDOW} AS high FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM opened) GROUP BY r, run),
pieces AS (SELECT d.r, low, high, h, substr(h, 2 * coalesce(lag(high) OVER (PARTITION BY d.r ORDER BY low), 0) + 1, 2 * (low - coalesce(lag(high) OVER (PARTITION BY d.r ORDER BY low), 0))) AS piece FROM d JOIN runs ON d.r = runs.r),
cut AS (SELECT r, sum(high - low) AS removed, count(*) AS spans, string_agg(piece, '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS kept FROM pieces GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(table(spark, sf_dir, "embeddings"))


def _assigned_sql(k: int) -> str:
    """The nearest entries of codebooks b{k}, as a{k}; for four entries a part, as the tables have."""
    way = " + ".join(f"(p.y[{i}] - b.y[{i}]) * (p.y[{i}] - b.y[{i}])" for i in range(1, 5))
    return f"a{k} AS (SELECT vec_id, part, any_value(label) AS label, any_value(p.y) AS y, min({{'d': {way}, 'e': entry}}) AS best FROM p JOIN b{k} b USING (part) GROUP BY vec_id, part)"


def _moved_sql(k: int) -> str:
    mean = ", ".join(f"CAST(floor(CAST(sum(y[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"m{k} AS (SELECT part, best.e AS entry, [{mean}] AS y FROM a{k} GROUP BY ALL), b{k + 1} AS (SELECT part, entry, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"


OP13_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({code_compression.SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, label, part, x[4 * part + 1 : 4 * part + 4] AS y FROM v, (SELECT unnest(range({code_compression.PARTS})) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {code_compression.ENTRIES}),
b0 AS (SELECT part, entry, y FROM p JOIN f USING (vec_id)),
{", ".join(f"{_assigned_sql(k)}, {_moved_sql(k)}" for k in range(code_compression.ROUNDS))},
{_assigned_sql(code_compression.ROUNDS)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{code_compression.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM b{code_compression.ROUNDS}) AS codebooks_sha256
FROM c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_tool_calls": op6_tool_calls,
    "op7_arc_to_warc": op7_arc_to_warc,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_whitening": op12_whitening,
    "op13_code_compression": op13_code_compression,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_license_scan": OP5_SQL,
    "op6_tool_calls": OP6_SQL,
    "op7_arc_to_warc": OP7_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op13_code_compression": OP13_SQL,
}
