"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake.llm import chunks, decontaminate, fingerprints, html, language, licenses, neardup, packing, pii, sharding, turns, two_fit, whitening
from dossierlake.llm.common import read_table, shared_folder


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_next(read_table(spark, sf_dir, "documents"))


SHARDS = 40


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: slots of documents dealt to 40 shards by their summed bytes; the map is stored and read back."""
    text = F.col("text")
    records = read_table(spark, sf_dir, "documents").select(
        "doc_id", sharding.record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        sharding.slot_of(F.col("doc_id")).alias("virtual_slot"))
    path = shared_folder(spark, "slot-map")
    sharding.write_map(sharding.first_map(sharding.slot_table(records), SHARDS), path, 1)
    placed = sharding.assigned(records, sharding.read_map(spark, path), ("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op3_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_findings(read_table(spark, sf_dir, "documents"))


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html.extracted(pages, html.fit(pages)).select("page_id", "url", "text", "n_chars")


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, pii.KINDS[:4]), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op7_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"))
    model = language.fit(docs.where("NOT held_out").select("doc_id", "text", "lang"))
    return language.identified(docs, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(read_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"))


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit.packed(read_table(spark, sf_dir, "documents"))


def op13_wagner_fischer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(read_table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posts a JOIN posts b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sets UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON doc_id = node
"""


# Edits per state of the grammar, from the first turn to the last. Inserts are left out: at these costs, deleting the
# turn that an insert would answer is always cheaper. All audits of a conversation then have one length, so the least one is found by state.
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (
  SELECT named.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, copy,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
turns AS MATERIALIZED (
  SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 3
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS before FROM damaged),
ways AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, pos, state, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit FROM (
    SELECT t.conv_id, t.pos, CASE WHEN edit = 'D' THEN w.state WHEN edit = 'K' AND w.state = 0 AND t.c = 's' THEN 1 WHEN w.state = 2 THEN 3 ELSE 2 END AS state,
      w.cost + CASE edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN edit <> 'D' AND t.fault = 1 THEN 5 ELSE 0 END AS cost, w.audit || edit AS audit
    FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1, (SELECT unnest(['D', 'K', 'R']) AS edit)
    WHERE edit = 'D' OR t.fault < 2 AND CASE edit WHEN 'K' THEN t.c = CASE WHEN w.state = 2 THEN 'a' ELSE 'u' END OR (w.state = 0 AND t.c = 's')
      ELSE t.c <> CASE WHEN w.state = 2 THEN 'a' ELSE 'u' END END)
  GROUP BY conv_id, pos, state),
sizes AS (
  SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 2) AS blank,
    count_if(fault = 3) AS duplicate, count_if(fault = 1) AS truncated, count_if(before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
best AS (
  SELECT w.conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit
  FROM ways w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.pos WHERE state IN (0, 3) GROUP BY w.conv_id),
said AS (
  SELECT t.*, substr(audit, pos, 1) AS edit, row_number() OVER (PARTITION BY t.conv_id ORDER BY pos) AS place,
    first_value(t.c) OVER (PARTITION BY t.conv_id ORDER BY pos) AS opening, first_value(substr(audit, pos, 1)) OVER (PARTITION BY t.conv_id ORDER BY pos) AS first_edit
  FROM turns t JOIN best b ON b.conv_id IS NOT DISTINCT FROM t.conv_id WHERE substr(audit, pos, 1) <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN opening = 's' AND first_edit = 'K' THEN 1 ELSE 0 END) % 2 = 1
    THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS body FROM said GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def packing_sql(buckets: int = packing.BUCKETS, budget: int = packing.BUDGET) -> str:
    """The same packing over the table documents; the steps of the dynamic programme are written out."""
    longest = packing.LONGEST
    steps = ["d1 AS (SELECT j, 0 AS i, level * upto AS cost FROM levels)"]
    for b in range(2, buckets + 1):
        steps.append(
            f"d{b} AS (SELECT j, arg_min(i, (cost, i)) AS i, min(cost) AS cost FROM (SELECT l.j, d.j AS i, d.cost + l.level * (l.upto - k.upto) "
            f"AS cost FROM levels l JOIN d{b - 1} d ON d.j < l.j JOIN levels k ON k.j = d.j) GROUP BY j)")
    chain = ["c0 AS (SELECT max(j) AS j, least(max(j), %d) AS b FROM levels)" % buckets]
    for s in range(1, buckets + 1):
        cases = " ".join(f"WHEN c.b = {b} THEN (SELECT i FROM d{b} WHERE d{b}.j = c.j)" for b in range(2, buckets + 1))
        chain.append(f"c{s} AS (SELECT CASE {cases} END AS j, b - 1 AS b FROM c{s - 1} c)")
    bounds = " UNION ALL ".join(f"SELECT j FROM c{s}" for s in range(buckets))
    return rf"""
WITH counted AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS total FROM documents),
cut AS (
  SELECT doc_id, piece, least(total - piece * {longest}, {longest}) AS tokens
  FROM (SELECT doc_id, total, CAST(unnest(range(0, greatest(CAST(ceil(total / {longest}.0) AS BIGINT), 1))) AS BIGINT) AS piece FROM counted)),
leveled AS (SELECT tokens AS level, count(*) AS n FROM cut WHERE tokens > 0 GROUP BY 1),
levels AS (SELECT level, CAST(sum(n) OVER (ORDER BY level) AS BIGINT) AS upto, row_number() OVER (ORDER BY level) AS j FROM leveled),
{", ".join(steps)}, {", ".join(chain)},
bounds AS (
  SELECT level AS bound, CAST(row_number() OVER (ORDER BY level) - 1 AS INTEGER) AS bucket FROM levels WHERE j IN (SELECT j FROM ({bounds}) WHERE j IS NOT NULL)),
placed AS (SELECT cut.*, (SELECT min(bucket) FROM bounds WHERE bound >= tokens) AS bucket FROM cut WHERE tokens > 0),
numbered AS (
  SELECT p.*, b.bound, row_number() OVER (PARTITION BY p.bucket ORDER BY doc_id NULLS FIRST, piece, tokens) - 1 AS pos,
    greatest({budget} // b.bound, 1) AS room FROM placed p JOIN bounds b USING (bucket))
SELECT doc_id, piece, tokens, bucket, bound, CAST(pos // room AS BIGINT) AS batch, CAST(pos % room AS BIGINT) AS place, bound - tokens AS padding FROM numbered
UNION ALL SELECT doc_id, piece, tokens, NULL, NULL, NULL, NULL, NULL FROM cut WHERE tokens = 0
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_fingerprints, op2_virtual_slots, op3_license_compression, op4_template_leaks, op5_dom_trees, op6_disclosure, op7_centroids,
        op8_gear_chunks, op9_minhash, op10_length_buckets, op11_block_whitening,
        op12_best_two_fit, op13_wagner_fischer)
}
ORACLES: dict[str, str] = {"op9_minhash": OP9_SQL, "op10_length_buckets": packing_sql(), "op13_wagner_fischer": OP13_SQL}
