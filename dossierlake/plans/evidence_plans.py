"""Structured extraction over the reranked benchmark results."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions import labels as L
from dossierlake.operators import evidence as EV, rerank as RR
from dossierlake.plans import sqltext as S
from dossierlake.plans.intent_plans import RERANK_SQL, benchmark_results
from dossierlake.plans.registry import register

UNKNOWN = S.quote(EV.UNKNOWN)
_SENT_SQL = f"""{RERANK_SQL}, ev AS MATERIALIZED (SELECT *, {S.sentence('snip')} AS sent,
   lower(document_title || ' ' || snip) AS ehay FROM reranked)"""


def reranked(spark, sf_dir):
    return RR.rerank(benchmark_results(spark, sf_dir), "doc_id", 10).withColumn("score", F.col("final_score"))


def _known(expr: str) -> str:
    return f"coalesce(nullif({expr}, ''), {UNKNOWN})"


def _has(expr: str, points: float) -> str:
    return f"CASE WHEN {expr} <> '' THEN {points}::DOUBLE ELSE 0.0::DOUBLE END"


def _fmt(expr: str) -> str:
    return f"printf('%.2f', least({expr}, 0.95::DOUBLE))"


_KW_HITS = "list_filter(kw, lambda w: contains({}, lower(w)))"


@register(
    "evidence_rows",
    f"""WITH {_SENT_SQL} SELECT query_id, doc_id, {_known('topic')} AS subject,
      {_known(f"array_to_string({_KW_HITS.format('ehay')}[1:6], ', ')")} AS checked_items, {_known('sent')} AS evidence,
      {_fmt(f"0.35::DOUBLE + {_has('sent', 0.25)} + least(len({_KW_HITS.format('ehay')}), 4) * 0.08::DOUBLE")} AS confidence FROM ev""",
    covers="E1",
)
def evidence_rows(spark, sf_dir):
    rows = EV.evidence_rows(reranked(spark, sf_dir))
    return rows.select("query_id", "doc_id", "subject", "checked_items", "evidence", "confidence")


def _first(terms, low: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, {S.quote(t.lower())}) THEN {S.quote(t)}" for t in terms) + " ELSE '' END"


def _cond(name: str, hay: str) -> str:
    return f"coalesce(list_filter(conds, lambda e: e.k = {S.quote(name)} AND contains({hay}, lower(e.v)))[1].v, '')"


_STAFF = f"""sf0 AS (SELECT *, lower(sent) AS slow, lower(project_name || ' ' || document_title || ' ' || snip) AS shay FROM ev),
sf1 AS (SELECT *, coalesce(nullif({_first(EV.ROLE_TERMS, 'slow')}, ''), {_cond('role', 'slow')}) AS rf,
    coalesce(nullif({_first(EV.GRADE_TERMS, 'slow')}, ''), {_cond('grade', 'slow')}) AS gf,
    coalesce(nullif({_first(EV.PROJECT_TERMS, 'slow')}, ''), {_cond('project_type', 'slow')}) AS pf,
    list_filter(list_transform(conds, lambda e: e.v), lambda v: contains(shay, lower(v))) AS met FROM sf0)"""


@register(
    "staff_rows",
    f"""WITH {_SENT_SQL}, {_STAFF} SELECT query_id, doc_id, {_known(f"regexp_extract(sent, {S.quote(EV.NAME_LABEL)}, 1)")} AS name,
      {_known('gf')} AS grade, {_known('rf')} AS role, {_known("array_to_string(met, ', ')")} AS matched_conditions,
      {_known('project_name')} AS client_project, {_known('pf')} AS project_kind,
      {_fmt(f"0.35::DOUBLE + {_has('sent', 0.2)} + least(len(met), 3) * 0.1::DOUBLE + {_has('rf', 0.1)} + {_has('gf', 0.05)}")} AS confidence FROM sf1""",
    covers="E2",
)
def staff_rows(spark, sf_dir):
    rows = EV.staff_rows(reranked(spark, sf_dir))
    return rows.select(
        "query_id", "doc_id", "name", "grade", "role", "matched_conditions", "client_project", "project_kind", "confidence"
    )


_COST = f"""co AS (SELECT *, regexp_extract(sent, {S.quote(L.AMOUNT)}) AS am, regexp_extract(sent, {S.quote(L.QUANTITY)}) AS qu,
   regexp_extract(sent, {S.quote(L.UNIT_PRICE)}) AS up FROM ev)"""


@register(
    "cost_rows",
    f"""WITH {_SENT_SQL}, {_COST} SELECT query_id, doc_id, coalesce({_KW_HITS.format('lower(sent)')}[1], {UNKNOWN}) AS cost_item,
      {_known('qu')} AS quantity, {_known('up')} AS unit_price, {_known('am')} AS amount,
      {_fmt(f"0.2::DOUBLE + {_has('sent', 0.2)} + {_has('am', 0.25)} + {_has('qu', 0.15)} + {_has('up', 0.15)}")} AS confidence FROM co""",
    covers="E3, X21",
)
def cost_rows(spark, sf_dir):
    rows = EV.cost_rows(reranked(spark, sf_dir))
    return rows.select("query_id", "doc_id", "cost_item", "quantity", "unit_price", "amount", "confidence")


_TREND = S.contains_any("sent", EV.TREND_TERMS)


@register(
    "technology_rows",
    f"""WITH {_SENT_SQL} SELECT query_id, doc_id,
      coalesce(nullif(array_to_string({_KW_HITS.format('lower(sent)')}[1:5], ', '), ''), nullif(topic, ''), {UNKNOWN}) AS technology,
      CASE WHEN {_TREND} THEN sent ELSE {UNKNOWN} END AS trend,
      {_fmt(f"0.35::DOUBLE + {_has('sent', 0.25)} + least(len({_KW_HITS.format('lower(sent)')}), 4) * 0.08::DOUBLE + CASE WHEN {_TREND} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END")} AS confidence
    FROM ev""",
    covers="E4",
)
def technology_rows(spark, sf_dir):
    rows = EV.technology_rows(reranked(spark, sf_dir))
    return rows.select("query_id", "doc_id", "technology", "trend", "confidence")


@register(
    "structured_rows",
    f"""WITH {_SENT_SQL}, {_STAFF} SELECT query_id, doc_id, output_type, CASE output_type
        WHEN 'staff_table' THEN {_known("array_to_string(met, ', ')")}
        WHEN 'cost_table' THEN coalesce({_KW_HITS.format('lower(sent)')}[1], {UNKNOWN})
        WHEN 'technology_table' THEN coalesce(nullif(array_to_string({_KW_HITS.format('lower(sent)')}[1:5], ', '), ''), nullif(topic, ''), {UNKNOWN})
        ELSE {_known('topic')} END AS lead_field, {_known('sent')} AS evidence, {UNKNOWN} AS area,
      {_known(f"array_to_string(list_filter(kw, lambda w: contains(lower(document_title || ' ' || project_name || ' ' || snip), lower(w))), ', ')")} AS matched,
      CAST(round(CAST(final_score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS points FROM sf1""",
    covers="E5, J11",
)
def structured_rows(spark, sf_dir):
    rows = EV.structured_rows(reranked(spark, sf_dir), "doc_id")
    lead = F.coalesce(*[
        F.try_element_at("fields", F.lit(EV.LABELS[f])) for f in ("matched_conditions", "cost_item", "technology", "subject")
    ])
    return rows.select(
        "query_id", "doc_id", "output_type", lead.alias("lead_field"),
        F.try_element_at("fields", F.lit(EV.LABELS["evidence"])).alias("evidence"), "area", "matched", "points",
    )
