"""Duplicate detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import dedup as D, delta as DL
from dossierlake.plans import sqltext as S
from dossierlake.plans.registry import register
from dossierlake.session import shared_folder, written
from dossierlake.sources.tables import corpus_documents, table


@register(
    "exact_dups",
    """SELECT sha256(text) AS digest, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_key
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
    covers="X12 = 1.0",
)
def exact_dups(spark, sf_dir):
    return D.exact_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


SIGNATURE_SQL = f"""
st AS (SELECT doc_id, source, {S.tokens('text')} AS toks FROM documents),
sg AS MATERIALIZED (SELECT doc_id, source, (list_sort(list_distinct(CASE WHEN len(toks) < 5
      THEN list_transform(toks, lambda t: substr(sha1(t), 1, 12))
      ELSE list_transform(range(1, len(toks) - 3), lambda i: substr(sha1(array_to_string(toks[i:i + 4], ' ')), 1, 12)) END)))[1:2000] AS sig
   FROM st)
"""


@register(
    "shingle_signature",
    f"""WITH {SIGNATURE_SQL} SELECT doc_id, CAST(len(sig) AS BIGINT) AS hashes, coalesce(sig[1], '') AS smallest,
    md5(array_to_string(sig, ' ')) AS digest FROM sg""",
    covers="X11",
)
def shingle_signature(spark, sf_dir):
    signed = table(spark, sf_dir, "documents").select("doc_id", D.signature("text").alias("sig"))
    return signed.select(
        "doc_id", F.size("sig").cast("bigint").alias("hashes"),
        F.coalesce(F.get("sig", F.lit(0)), F.lit("")).alias("smallest"), F.md5(F.array_join("sig", " ")).alias("digest"),
    )


PAIRS_SQL = f"""{SIGNATURE_SQL},
sh AS (SELECT doc_id, source, unnest(sig) AS h FROM sg),
pc AS (SELECT a.doc_id AS newer, b.doc_id AS older, a.source, count(*) AS shared FROM sh a JOIN sh b
       ON a.source = b.source AND a.h = b.h AND a.doc_id > b.doc_id GROUP BY ALL),
sim AS MATERIALIZED (SELECT newer, older, pc.source FROM pc JOIN sg x ON x.doc_id = newer JOIN sg y ON y.doc_id = older
       WHERE CAST(shared AS DOUBLE) / (len(x.sig) + len(y.sig) - shared) >= 0.8::DOUBLE),
ord AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS pos FROM sg),
nb AS (SELECT ord.doc_id, ord.source, pos, coalesce(list(newer) FILTER (WHERE newer IS NOT NULL), []) AS nbs
       FROM ord LEFT JOIN sim ON sim.older = ord.doc_id GROUP BY ALL),
walk AS (
  SELECT source, 1::BIGINT AS pos, [doc_id] AS kept FROM nb WHERE pos = 1
  UNION ALL
  SELECT nb.source, nb.pos, CASE WHEN list_has_any(kept, nbs) THEN kept ELSE list_append(kept, nb.doc_id) END
  FROM walk JOIN nb ON nb.source = walk.source AND nb.pos = walk.pos + 1),
final AS (SELECT source, kept FROM walk QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos DESC) = 1)
"""


@register(
    "dedup_keepers",
    f"""WITH RECURSIVE {PAIRS_SQL}
    SELECT nb.doc_id, list_contains(kept, nb.doc_id) AS kept,
           CASE WHEN NOT list_contains(kept, nb.doc_id) THEN list_max(list_intersect(kept, nbs)) END AS duplicate_of
    FROM nb JOIN final USING (source)""",
    covers="J8, R16, R17, A14",
)
def dedup_keepers(spark, sf_dir):
    docs = corpus_documents(spark, sf_dir)
    judged = D.keep_newest(docs, "doc_id", "text", "project_id", "file_mtime")
    return judged.select("doc_id", "kept", "duplicate_of")


# The same walk over the first batch, then over what it kept and the second batch.
TWO_RUNS_SQL = f"""{PAIRS_SQL.split("ord AS (")[0]}
nbs_of AS (SELECT sg.doc_id, sg.source, coalesce(list(newer) FILTER (WHERE newer IS NOT NULL), []) AS nbs
       FROM sg LEFT JOIN sim ON sim.older = sg.doc_id GROUP BY ALL),
one AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS pos FROM nbs_of WHERE doc_id % 2 = 0),
walk1 AS (
  SELECT source, 1::BIGINT AS pos, [doc_id] AS kept FROM one WHERE pos = 1
  UNION ALL
  SELECT one.source, one.pos, CASE WHEN list_has_any(kept, nbs) THEN kept ELSE list_append(kept, one.doc_id) END
  FROM walk1 JOIN one ON one.source = walk1.source AND one.pos = walk1.pos + 1),
kept1 AS MATERIALIZED (SELECT unnest(kept) AS doc_id FROM (SELECT source, kept FROM walk1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos DESC) = 1)),
two AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS pos FROM nbs_of
        WHERE doc_id % 2 = 1 OR doc_id IN (SELECT doc_id FROM kept1)),
walk2 AS (
  SELECT source, 1::BIGINT AS pos, [doc_id] AS kept FROM two WHERE pos = 1
  UNION ALL
  SELECT two.source, two.pos, CASE WHEN list_has_any(kept, nbs) THEN kept ELSE list_append(kept, two.doc_id) END
  FROM walk2 JOIN two ON two.source = walk2.source AND two.pos = walk2.pos + 1),
kept2 AS MATERIALIZED (SELECT source, kept FROM walk2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos DESC) = 1)
"""


@register(
    "dedup_incremental",
    f"""WITH RECURSIVE {TWO_RUNS_SQL}
    SELECT nbs_of.doc_id, CASE WHEN nbs_of.doc_id % 2 = 0 THEN nbs_of.doc_id IN (SELECT doc_id FROM kept1) END AS kept_first,
      coalesce(list_contains(kept2.kept, nbs_of.doc_id), false) AS kept,
      CASE WHEN (nbs_of.doc_id % 2 = 1 OR nbs_of.doc_id IN (SELECT doc_id FROM kept1)) AND NOT list_contains(kept2.kept, nbs_of.doc_id)
        THEN list_max(list_intersect(kept2.kept, nbs)) END AS duplicate_of
    FROM nbs_of LEFT JOIN kept2 USING (source)""",
    covers="R16, R17, F9",
)
def dedup_incremental(spark, sf_dir):
    """Documents of even number are indexed first, then those of odd number are added from kept postings."""
    signed = corpus_documents(spark, sf_dir).select("doc_id", "project_id", "file_mtime", D.signed_numbers("text").alias("s"))
    docs = written(signed.select("doc_id", "project_id", "file_mtime", F.col("s.numbers").alias("signature"), "s.digest"), "signed")
    names = ("doc_id", "project_id")
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    judged = written(D.keep_newest(first, "doc_id", "signature", "project_id", "file_mtime", signed=True).select("doc_id", F.col("kept").alias("kept_first")), "judged")
    # The signatures stay where they are; what is not indexed, the smaller part, is left out of each reading.
    gone = written(judged.groupBy("doc_id").agg(F.bool_or("kept_first").alias("kept_first")).where("NOT kept_first").select("doc_id"), "gone")
    indexed = first.join(gone, "doc_id", "left_anti")
    common, path = DL.common_hashes(indexed, *names), shared_folder(spark, "postings")
    DL.save(DL.prefixes(indexed, *names, common), path)
    added = written(DL.prefixes(second, *names, common), "added")
    again = DL.keep_newest(second, indexed, added, DL.kept(spark, path, added), *names, "file_mtime").select("doc_id", "kept", "duplicate_of")
    rest = F.coalesce("kept", "kept_first")
    return docs.select("doc_id").join(judged, "doc_id", "left").join(again, "doc_id", "left").select("doc_id", "kept_first", rest.alias("kept"), "duplicate_of")


@register(
    "turn_similarity",
    f"""WITH st AS (SELECT conv_id, turn, {S.tokens('text')} AS toks FROM conversations),
    sg AS (SELECT conv_id, turn, (list_sort(list_distinct(CASE WHEN len(toks) < 5
      THEN list_transform(toks, lambda t: substr(sha1(t), 1, 12))
      ELSE list_transform(range(1, len(toks) - 3), lambda i: substr(sha1(array_to_string(toks[i:i + 4], ' ')), 1, 12)) END)))[1:2000] AS sig FROM st)
    SELECT a.conv_id, a.turn, CASE WHEN len(a.sig) = 0 OR len(b.sig) = 0 THEN 0.0::DOUBLE
      ELSE round(CAST(len(list_intersect(a.sig, b.sig)) AS DOUBLE) / (len(a.sig) + len(b.sig) - len(list_intersect(a.sig, b.sig))), 6) END AS jaccard
    FROM sg a JOIN sg b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
    covers="X12, U2",
)
def turn_similarity(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", D.signature("text").alias("sig"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("sig").alias("before"))
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(D.jaccard(F.col("sig"), F.col("before")), 6).alias("jaccard")
    )
