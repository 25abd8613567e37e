"""Queries of the operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.llm import (collocations, html_content, licenses, mixing, nnls_packing, packing, pii, pu_quality,
                           quality_rules, runs, simhash, topk, toxicity)
from annospark.llm.common import table

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         length(text) AS n, length(text) - length(translate(text, '#*$%&|<>', '')) AS symbols,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT::DOUBLE AS bits
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((bits + 0.5) / 4503599627370496.0::DOUBLE) / CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE,
           CASE WHEN n > 0 THEN (1.0::DOUBLE - symbols::DOUBLE / n) * (1.0::DOUBLE - symbols::DOUBLE / n) ELSE 1.0::DOUBLE END) END AS key
  FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM per),
weighted AS (SELECT *, [3, 1, 2][place % 3 + 1]::BIGINT AS weight, 2 * source_size AS cap FROM placed),
summed AS (
  SELECT *, cap::DOUBLE / weight AS full_at,
         coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights,
         1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(weight) OVER () AS all_weight
  FROM weighted
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((goal - caps) / (all_weight - weights), (full_at, place)) AS level FROM summed
  WHERE cap * (all_weight - weights) >= weight * (goal - caps)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM summed, level),
planned AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM targets),
running AS (
  SELECT k.doc_id, k.size, k.source, p.source_size, p.target, p.epochs,
         p.target - p.epochs * p.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, round(target, 6) AS target,
       (size * (epochs + CASE WHEN before + size / 2.0 < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""


@register("op1_mixing", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TOP_K_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id,
         coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1]::HUGEINT * p[2])), 0)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@register("op3_top_k", TOP_K_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


@register("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


@register("op5_fertility_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@register("op6_licences", licenses.oracle_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op7_pu_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op9_html_content")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


@register("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["kind_no"]), c["start"].cast("string"),
                                                                     c["end"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["base"])

    def count(no):
        return F.size(F.filter("base", lambda c: c["kind_no"] == no)).cast("long")
    counts = [count(no).alias(f"n_{kind}") for no, kind in enumerate(pii.KINDS)]
    return found.withColumn("base", base).select(
        "doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


#: A run's words match those one period before, so its stretches of eight words do; islands of equal stretches are runs.
RUNS_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
crc AS (
  SELECT DISTINCT doc_id, encode(doc_id::VARCHAR) AS id, 0 AS step, 4294967295::BIGINT AS c FROM rows WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, id, step + 1, xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT)
  FROM (SELECT doc_id, id, step, CASE WHEN step % 8 = 0
               THEN xor(c, ('0x' || substr(hex(id), 2 * (step // 8) + 1, 2))::BIGINT) ELSE c END AS b
        FROM crc WHERE step < 8 * octet_length(id))),
hashed AS (SELECT doc_id, xor(c, 4294967295::BIGINT) AS h FROM crc WHERE step = 8 * octet_length(id)),
planned AS (
  SELECT r, rows.doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) AS g
  FROM rows LEFT JOIN hashed USING (doc_id)),
placed AS (
  SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM planned),
changed AS (
  SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1])
                            ELSE ws END AS ws FROM placed),
stretches AS (
  SELECT r, i, list_aggregate(ws[i + 1:i + 8], 'string_agg', ' ') AS s
  FROM changed, unnest(range(greatest(n - 7, 0))) u(i)),
again AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM stretches x JOIN stretches y ON x.r = y.r AND x.s = y.s AND y.i > x.i),
islands AS (
  SELECT r, q, min(i) AS start, max(i) - min(i) + 8 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM again) GROUP BY r, q, island),
runs AS (
  SELECT r, start, length, min(q) AS q FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY r),
best AS (
  SELECT x.* FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.r = x.r AND (y.length * x.q > x.length * y.q OR (y.length * x.q = x.length * y.q
      AND (y.start < x.start OR (y.start = x.start AND y.q < x.q)))))),
dropped AS (
  SELECT r, list(DISTINCT i) AS gone FROM runs, unnest(range(start + q, start + length)) u(i) GROUP BY r)
SELECT c.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.length // b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(list_aggregate(CASE WHEN gone IS NULL THEN c.ws ELSE list_transform(
         list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: ws[i + 1]) END, 'string_agg', ' '), '')) AS collapsed_sha256
FROM changed c LEFT JOIN listed USING (r) LEFT JOIN best b ON b.r = c.r LEFT JOIN dropped d ON d.r = c.r
"""


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: in about a tenth of the documents the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size("w"), F.lit(1)).cast("long")
    g = F.floor(h / 10)
    chosen = docs.select(F.col("doc_id"), F.col("text"), F.when(h % 10 == 0, words).alias("w"), n.alias("n"), (g % n).alias("a"),
                         (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
    root = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(root, turns)), 1, (F.col("n") - F.col("a")).cast("int"))
    made = F.array_join(F.concat(F.slice("w", 1, F.col("a").cast("int")), again), " ")
    return chosen.select("doc_id", F.when(F.size("w") > 0, made).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs", RUNS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(planted_periods(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    top = F.col("top")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)),
counts AS (
  SELECT lang, k, array_to_string(ws[i + 1:i + k], ' ') AS phrase, count(*) AS f
  FROM pieces, unnest(range(len(ws))) u(i), (VALUES (1), (2), (3), (4)) v(k) WHERE i + k <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
phrases AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT p.lang, p.phrase, p.a, c, x.f AS l, y.f AS r, 2000000::HUGEINT * p.a // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM phrases) p
  JOIN counts x ON x.lang = p.lang AND x.phrase = array_to_string(p.ws[1:c], ' ')
  JOIN counts y ON y.lang = p.lang AND y.phrase = array_to_string(p.ws[c + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM cuts),
inner_ AS (
  SELECT lang, array_to_string(ws[s + 1:s + m], ' ') AS phrase, max(a) AS most
  FROM phrases, (VALUES (2), (3)) v(m), unnest(range(3)) u(s) WHERE m < k AND s + m <= k GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM best b JOIN totals USING (lang) LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE place = 1 AND (most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


@register("op12_collocations", PHRASES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register("op13_nnls_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.packed_pieces(table(spark, sf_dir, "documents"))
