"""State changes and file rules over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import headings as HD
from dossierlake.lexicons.corpus import CORPUS_CHAPTERS
from dossierlake.operators import merged as M, state as ST
from dossierlake.plans import sqltext as S
from dossierlake.plans.registry import register
from dossierlake.session import shared_folder
from dossierlake.sources import files as FS
from dossierlake.sources.tables import table

_INCOMING = """inc AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'U' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
   UNION ALL SELECT -l_orderkey - 1, max(l_suppkey), 'N', round(sum(l_extendedprice), 2) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)"""


def _incoming(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("U").alias("o_orderstatus"),
        F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"),
    )
    fresh = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(
        F.max("l_suppkey").alias("o_custkey"), F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice")
    )
    fresh = fresh.select((-F.col("l_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return urgent.unionByName(fresh)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register(
    "upsert_merge",
    f"""WITH {_INCOMING} SELECT o_orderkey, coalesce(o.o_custkey, inc.o_custkey) AS o_custkey, inc.o_orderstatus, inc.o_totalprice
      FROM inc LEFT JOIN orders o USING (o_orderkey)
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM inc)""",
    covers="K2",
)
def upsert_merge(spark, sf_dir):
    return ST.upsert(_orders(spark, sf_dir), _incoming(spark, sf_dir), "o_orderkey", keep=("o_custkey",))


@register(
    "replace_by_key",
    """WITH inc AS (SELECT l_orderkey, -l_linenumber AS l_linenumber, l_quantity + 1 AS l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM inc
    UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM inc)""",
    covers="K3",
)
def replace_by_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    columns = ["l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity"]
    late = lines.filter(F.col("l_shipdate") >= "1998-06-01").select(
        "l_orderkey", (-F.col("l_linenumber")).cast("bigint").alias("l_linenumber"), (F.col("l_quantity") + 1).alias("l_quantity")
    )
    return ST.replace_by_key(lines.select(*columns), late, "l_orderkey")


@register(
    "delete_cascade",
    """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT 'documents' AS part, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'removed_chunks', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM gone)""",
    covers="K4, J3",
)
def delete_cascade(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "document_id")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id")
    )
    parts = ST.delete_documents(orders, lines, orders.filter(F.col("o_orderstatus") == "P"))
    counts = [
        df.agg(F.count("*").cast("bigint").alias("n")).select(F.lit(name).alias("part"), "n")
        for name, df in zip(("documents", "chunks", "removed_chunks"), parts)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register(
    "written_upsert",
    f"""WITH {_INCOMING} SELECT o_orderkey, coalesce(o.o_custkey, inc.o_custkey) AS o_custkey, inc.o_orderstatus, inc.o_totalprice
      FROM inc LEFT JOIN orders o USING (o_orderkey)
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM inc)""",
    covers="K2 on a written table",
)
def written_upsert(spark, sf_dir):
    path = shared_folder(spark, "orders")
    M.create(_orders(spark, sf_dir), "o_orderkey", path)
    M.upsert(spark, path, _incoming(spark, sf_dir), "o_orderkey", keep=("o_custkey",))
    return M.read(spark, path)


@register(
    "written_replace_delete",
    """WITH inc AS (SELECT l_orderkey, -l_linenumber AS l_linenumber, l_quantity + 1 AS l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'),
    gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM inc WHERE l_orderkey NOT IN (SELECT * FROM gone)
    UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM inc) AND l_orderkey NOT IN (SELECT * FROM gone)""",
    covers="K3, K4 on a written table",
)
def written_replace_delete(spark, sf_dir):
    lines, path = table(spark, sf_dir, "lineitem"), shared_folder(spark, "lineitem")
    columns = ["l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity"]
    late = lines.filter(F.col("l_shipdate") >= "1998-06-01").select(
        "l_orderkey", (-F.col("l_linenumber")).cast("bigint").alias("l_linenumber"), (F.col("l_quantity") + 1).alias("l_quantity"))
    M.create(lines.select(*columns), "l_orderkey", path)
    M.replace(spark, path, late, "l_orderkey")
    gone = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    M.delete(spark, path, gone, "l_orderkey")
    return M.read(spark, path)


@register(
    "missing_documents",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    covers="K15, F9, U3",
)
def missing_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return ST.not_indexed(docs, table(spark, sf_dir, "labels"), "doc_id")


@register(
    "customers_without_orders",
    """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
      SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')""",
    covers="K15 on the star schema",
)
def customers_without_orders(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    recent = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    return ST.not_indexed(customers, recent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register(
    "orders_latest_per_customer",
    """SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS latest, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
    covers="A14 on the star schema",
)
def orders_latest_per_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    newest = F.max_by(
        F.struct("o_orderdate", "o_orderkey"), F.struct(F.col("o_orderdate"), (-F.col("o_orderkey")).alias("k"))
    )
    best = orders.groupBy("o_custkey").agg(newest.alias("b"))
    day = F.date_format("b.o_orderdate", "yyyy-MM-dd")
    return best.select("o_custkey", day.alias("latest"), F.col("b.o_orderkey").alias("o_orderkey"))


@register(
    "lineitem_conditional_counts",
    """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS lines, CAST(count_if(l_discount = 0) AS BIGINT) AS no_discount,
      CAST(count_if(l_quantity > 25) AS BIGINT) AS large, CAST(count_if(l_shipdate < TIMESTAMP '1995-01-01') AS BIGINT) AS early
    FROM lineitem GROUP BY l_returnflag""",
    covers="A5 on the star schema",
)
def lineitem_conditional_counts(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("lines"), F.count_if(F.col("l_discount") == 0).alias("no_discount"),
        F.count_if(F.col("l_quantity") > 25).alias("large"), F.count_if(F.col("l_shipdate") < "1995-01-01").alias("early"),
    )
    return counted.select("l_returnflag", *[F.col(c).cast("bigint").alias(c) for c in ("lines", "no_discount", "large", "early")])


_NAME = "translate(lower(trim(p, ' ')), ' _-.()[]', '')"
_COMPACT = f"regexp_replace({_NAME}, '^[0-9]+', '')"
_PATH_SQL = """CASE doc_id % 9 WHEN 0 THEN source || '/00.old/' || doc_id || '.pdf' WHEN 1 THEN source || '/참고 자료/' || doc_id || '.pdf'
   WHEN 2 THEN source || '/.cache/' || doc_id || '.docx' WHEN 3 THEN source || '/01_Temp/' || doc_id || '.docx' WHEN 4 THEN source || '/' || doc_id || '.xlsx'
   WHEN 5 THEN source || '/~$' || doc_id || '.pptx' WHEN 6 THEN source || '/계약서류/' || lang || '.pdf' WHEN 7 THEN source || '/backup_x/' || doc_id || '.pdf'
   ELSE source || '/' || lang || '/' || doc_id || '.pptx' END"""


@register(
    "folder_scan_reasons",
    f"""WITH f AS (SELECT doc_id, {_PATH_SQL} AS path FROM documents), p AS (SELECT *, string_split(path, '/') AS parts FROM f)
    SELECT doc_id, path, CASE
      WHEN len(list_filter(parts, lambda p: starts_with(p, '.') OR list_contains({S.str_list(FS.TEMPORARY_NAMES)}, {_COMPACT}))) > 0 OR starts_with(parts[-1], '~$') THEN 'temp_or_hidden'
      WHEN len(list_filter(parts, lambda p: regexp_matches(lower(trim(p, ' ')), {S.quote(FS.OLD_ENDINGS)}))) > 0 THEN 'old_path'
      WHEN len(list_filter(parts, lambda p: {S.contains_any(_COMPACT, FS.REFERENCE_PARTS + FS.ADMINISTRATIVE_PARTS)})) > 0 THEN 'reference_material'
      WHEN NOT regexp_matches(lower(parts[-1]), '[.](pdf|docx|pptx|ppt)$') THEN 'unsupported_extension'
      WHEN contains(lower(path), 'backup_') THEN 'exclude_pattern' ELSE '' END AS reason FROM p""",
    covers="S1-S5, K14",
)
def folder_scan_reasons(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang")
    path = F.expr(_PATH_SQL)
    return docs.select("doc_id", path.alias("path")).withColumn(
        "reason", FS.exclusion_reason(F.col("path"), patterns=("backup_",))
    )


@register(
    "normalize_chapters",
    f"""WITH h AS (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations),
    n AS (SELECT *, {S.norm_chapter('text')} AS nt, regexp_replace(lower(text), {S.quote(HD.NOT_TITLE_CHARS)}, '', 'g') AS ct FROM h),
    c AS (SELECT *, coalesce(nullif({S.canonical_case('nt', 'ct', CORPUS_CHAPTERS)}, ''), '기타') AS chapter FROM n)
    SELECT id, chapter AS chapter_title, {S.norm_chapter('chapter')} AS normalized_chapter_title, md5(nt) AS section_digest,
      md5({S.norm_chapter("chapter || CASE WHEN trim(text, ' ') IN ('', chapter) THEN '' ELSE ' > ' || trim(text, ' ') END")}) AS path_digest FROM c""",
    covers="K11",
)
def normalize_chapters(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("chapter_title"),
        F.col("text").alias("section_title"), F.lit("").alias("heading_path"),
    )
    done = ST.normalize_chapters(rows, CORPUS_CHAPTERS)
    return done.select(
        "id", "chapter_title", "normalized_chapter_title", F.md5("normalized_section_title").alias("section_digest"),
        F.md5("normalized_heading_path").alias("path_digest"),
    )


@register(
    "search_log_rows",
    """SELECT 'log_' || substr(sha1('topic:' || event_type || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 16) AS log_id,
      event_type AS query_text, 'topic' AS query_type, CAST(user_id AS BIGINT) AS result_count FROM events""",
    covers="K6, X22",
)
def search_log_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = ST.log_rows(events, "topic", stamp, "event_type", "user_id").drop("created_at")
    return rows.withColumn("result_count", F.col("result_count").cast("bigint"))
