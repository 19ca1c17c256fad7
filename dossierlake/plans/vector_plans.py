"""Embedding and vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import batch as B, keyword as KW, ranking as R, vectors as V
from dossierlake.plans import sqltext as S
from dossierlake.plans.registry import register
from dossierlake.sources.tables import table


def sparse_sql(key: str, body: str, source: str) -> str:
    """(key, slot, weight) of a table, as SQL."""
    return f"""SELECT key, slot, weight FROM (
      SELECT key, CAST(concat('0x', substr(md5(token), 1, 8)) AS BIGINT) % 384 AS slot,
             CAST(sum(CASE WHEN contains('02468ace', substr(md5(token), 10, 1)) THEN 1 ELSE -1 END) AS BIGINT) AS weight
      FROM (SELECT {key} AS key, unnest({S.tokens(body)}) AS token FROM {source}) GROUP BY ALL) WHERE weight <> 0"""


@register(
    "hash_embedding_sparse",
    f"""WITH e AS ({sparse_sql('doc_id', 'text', 'documents')}),
    n AS (SELECT key, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM e GROUP BY key)
    SELECT key AS doc_id, slot, weight, round(weight / norm, 6) AS value FROM e JOIN n USING (key)""",
    covers="X10, R18",
)
def hash_embedding_sparse(spark, sf_dir):
    sparse = V.sparse_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")
    norm = F.sqrt(F.col("square").cast("double"))
    return sparse.select("doc_id", "slot", "weight", F.round(F.col("weight") / norm, 6).alias("value"))


_VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_CENTROIDS = f"""
  cells AS (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  mean AS (SELECT label, pos, avg(v) AS v FROM cells GROUP BY label, pos),
  len AS (SELECT label, sqrt(sum(v * v)) AS norm FROM mean GROUP BY label),
  cent AS (SELECT label, list(v / norm ORDER BY pos) AS centroid FROM mean JOIN len USING (label) GROUP BY label)"""


@register(
    "vector_topk_cosine",
    f"""WITH {_CENTROIDS},
    s AS (SELECT cent.label AS query_id, vec_id, round(list_inner_product({_VEC}, centroid), 6) AS score FROM embeddings, cent),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
    SELECT query_id, vec_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 20""",
    covers="R4, J9, X9, F10, W4",
)
def vector_topk_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = V.centroids(vectors, "label", "embedding")
    top = B.vector_top(vectors, "vec_id", "embedding", queries, "label", "centroid", 20)
    return top.select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@register(
    "vector_topk_by_label",
    f"""WITH {_CENTROIDS},
    s AS (SELECT label, vec_id, round(list_inner_product({_VEC}, centroid), 6) AS score FROM embeddings JOIN cent USING (label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT label, vec_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""",
    covers="W4, R4 with candidate ids",
)
def vector_topk_by_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    own = vectors.join(V.centroids(vectors, "label", "embedding"), "label")
    scored = own.select("label", "vec_id", F.round(V.dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))
    return KW.top_rows_per(scored, "label", "score", "vec_id", 10).withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "label_precision_at_k",
    f"""WITH {_CENTROIDS},
    s AS (SELECT cent.label AS query_id, embeddings.label AS found, vec_id,
            round(list_inner_product({_VEC}, centroid), 6) AS score FROM embeddings, cent),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
    SELECT query_id, CAST(count(*) AS BIGINT) AS results, CAST(count_if(found = query_id) AS BIGINT) AS relevant,
           round(CAST(count_if(found = query_id) AS DOUBLE) / count(*), 6) AS precision_at_k
    FROM r WHERE rank <= 30 GROUP BY query_id""",
    covers="E7",
)
def label_precision_at_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = V.centroids(vectors, "label", "embedding")
    top = B.vector_top(vectors, "vec_id", "embedding", queries, "label", "centroid", 30)
    judged = top.join(vectors.select("vec_id", "label"), "vec_id")
    relevant = F.count_if(F.col("label") == F.col("query_id"))
    return judged.groupBy("query_id").agg(
        F.count("*").cast("bigint").alias("results"),
        relevant.cast("bigint").alias("relevant"),
        F.round(relevant / F.count("*"), 6).alias("precision_at_k"),
    )


@register(
    "max_normalise",
    """SELECT event_id, event_type, round(value / max(value) OVER (PARTITION BY event_type), 6) AS share
    FROM events WHERE value > 0""",
    covers="A16",
)
def max_normalise(spark, sf_dir):
    # The whole table is no bounded candidate set: take the maximum with a map-side
    # aggregate and join it back, so that a frequent type is not gathered in one window.
    events = table(spark, sf_dir, "events").filter(F.col("value") > 0)
    best = events.groupBy("event_type").agg(F.max("value").alias("best"))
    return events.join(best, "event_type").select(
        "event_id", "event_type", F.round(F.col("value") / F.col("best"), 6).alias("share")
    )


@register(
    "score_fusion_full_outer",
    """WITH k AS (SELECT l_orderkey AS id, round(max(l_discount) * 10, 6) AS ks FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    v AS (SELECT o_orderkey AS id, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS vs FROM orders
          WHERE o_orderstatus = 'F')
    SELECT id, coalesce(ks, 0::DOUBLE) AS keyword_score, coalesce(vs, 0::DOUBLE) AS vector_score,
           round(coalesce(ks, 0) * 0.4::DOUBLE + coalesce(vs, 0) * 0.6::DOUBLE, 6) AS score
    FROM k FULL OUTER JOIN v USING (id)""",
    covers="J4, R5, X8, U1",
)
def score_fusion_full_outer(spark, sf_dir):
    keyword = (
        table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.round(F.max("l_discount") * 10, 6).alias("keyword_score"))
    )
    orders = table(spark, sf_dir, "orders")
    best = orders.agg(F.max("o_totalprice")).scalar()
    vector = orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / best, 6).alias("vector_score")
    )
    return R.fuse(keyword, vector, ["id"])
