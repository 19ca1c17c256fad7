"""The extractors over passages built from order lines, where every field is sometimes there and sometimes not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierlake.functions import labels as L, text as T
from dossierlake.operators import evidence as EV
from dossierlake.plans import sqltext as S
from dossierlake.plans.evidence_plans import _COST, _KW_HITS, _STAFF, _TREND, UNKNOWN, _fmt, _has, _known
from dossierlake.plans.registry import register
from dossierlake.sources.tables import table

NAMES = ("김서연", "이도윤", "박하준", "최지우", "정민서")
GRADES = ("특급", "고급", "중급", "초급", "")
ROLES = ("PM", "PL", "DBA", "컨설턴트")
KINDS = ("ISP", "BPR", "구축", "조사")
KEYWORDS = ("단가", "MSA", "클라우드", "ISP")
CONDITIONS = {"role": "PM", "grade": "특급", "project_type": "ISP"}


def _pick(values: tuple[str, ...], column: str) -> str:
    """An SQL expression that both engines read."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({column} % {len(values)} AS INT) {cases} END"


_QUANTITY, _PRICE, _AMOUNT = (
    f"CAST(CAST(floor({x}) AS BIGINT) AS {{text}})" for x in ("l_quantity", "l_extendedprice / l_quantity", "l_extendedprice"))
PASSAGE = f"""CASE CAST(l_linenumber % 4 AS INT)
  WHEN 0 THEN concat('항목 ', l_returnflag, ': 단가: ', {_PRICE}, '원 수량 ', {_QUANTITY}, '개 금액 ', {_AMOUNT}, '천원 산정. 다음 문장')
  WHEN 1 THEN concat('성명: ', {_pick(NAMES, 'l_suppkey')}, ' ', {_pick(GRADES, 'l_suppkey')}, ' ', {_pick(ROLES, 'l_partkey')}, ' ',
    {_QUANTITY}, '년 경력 ', {_pick(KINDS, 'l_orderkey')}, ' 수행. 끝')
  WHEN 2 THEN concat('plain line ', CAST(l_orderkey AS {{text}}), ' without facts. 단가 1원')
  ELSE concat('MSA 기반 ', l_linestatus, CASE WHEN l_orderkey % 2 = 0 THEN ' 동향과 클라우드 전환 ' ELSE ' 현황과 이전 ' END, {_QUANTITY}, '대. 끝') END"""
LINES_SQL = f"""ol AS (SELECT l_orderkey AS query_id, CAST(l_linenumber AS BIGINT) AS doc_id, 'p' || l_returnflag AS project_name,
    'd' || l_linestatus AS document_title, {PASSAGE.format(text='VARCHAR')} AS snip, '비용' AS topic, {S.str_list(KEYWORDS)} AS kw,
    [{', '.join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in CONDITIONS.items())}] AS conds FROM lineitem),
ev AS MATERIALIZED (SELECT *, {S.sentence('snip')} AS sent, lower(document_title || ' ' || snip) AS ehay FROM ol)"""


def line_passages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("bigint").alias("doc_id"),
        F.concat(F.lit("p"), "l_returnflag").alias("project_name"), F.concat(F.lit("d"), "l_linestatus").alias("document_title"),
        F.expr(PASSAGE.format(text="STRING")).alias("matched_text"), F.lit("비용").alias("topic"),
        F.array(*map(F.lit, KEYWORDS)).alias("expanded_keywords"),
        F.create_map(*[F.lit(x) for pair in CONDITIONS.items() for x in pair]).alias("conditions"),
    )


@register(
    "line_costs",
    f"""WITH {LINES_SQL}, {_COST} SELECT query_id, doc_id, coalesce({_KW_HITS.format('lower(sent)')}[1], {UNKNOWN}) AS cost_item,
      {_known('qu')} AS quantity, {_known('up')} AS unit_price, {_known('am')} AS amount,
      {_fmt(f"0.2::DOUBLE + {_has('sent', 0.2)} + {_has('am', 0.25)} + {_has('qu', 0.15)} + {_has('up', 0.15)}")} AS confidence FROM co""",
    covers="E3, X21",
)
def line_costs(spark, sf_dir):
    return EV.cost_rows(line_passages(spark, sf_dir)).select(
        "query_id", "doc_id", "cost_item", "quantity", "unit_price", "amount", "confidence")


@register(
    "line_staff",
    f"""WITH {LINES_SQL}, {_STAFF} SELECT query_id, doc_id, {_known(f"regexp_extract(sent, {S.quote(EV.NAME_LABEL)}, 1)")} AS name,
      {_known('gf')} AS grade, {_known('rf')} AS role, {_known("array_to_string(met, ', ')")} AS matched_conditions, {_known('pf')} AS project_kind,
      {_fmt(f"0.35::DOUBLE + {_has('sent', 0.2)} + least(len(met), 3) * 0.1::DOUBLE + {_has('rf', 0.1)} + {_has('gf', 0.05)}")} AS confidence FROM sf1""",
    covers="E2",
)
def line_staff(spark, sf_dir):
    return EV.staff_rows(line_passages(spark, sf_dir)).select(
        "query_id", "doc_id", "name", "grade", "role", "matched_conditions", "project_kind", "confidence")


@register(
    "line_technology",
    f"""WITH {LINES_SQL} SELECT query_id, doc_id,
      coalesce(nullif(array_to_string({_KW_HITS.format('lower(sent)')}[1:5], ', '), ''), nullif(topic, ''), {UNKNOWN}) AS technology,
      CASE WHEN {_TREND} THEN sent ELSE {UNKNOWN} END AS trend FROM ev""",
    covers="E4",
)
def line_technology(spark, sf_dir):
    return EV.technology_rows(line_passages(spark, sf_dir)).select("query_id", "doc_id", "technology", "trend")


@register(
    "line_amounts",
    f"""WITH {LINES_SQL}, b AS (SELECT query_id, doc_id, {S.squeeze('snip')} AS body FROM ev)
    SELECT query_id, doc_id, regexp_extract(body, {S.quote(L.AMOUNT)}) AS amount, regexp_extract(body, {S.quote(L.QUANTITY)}) AS quantity,
      regexp_extract(body, {S.quote(L.UNIT_PRICE)}) AS unit_price, regexp_extract(body, {S.quote(L.EXPERIENCE_YEARS)}) AS years FROM b""",
    covers="X21",
)
def line_amounts(spark, sf_dir):
    rows = line_passages(spark, sf_dir).select("query_id", "doc_id", T.squeeze("matched_text").alias("body"))
    patterns = {"amount": L.AMOUNT, "quantity": L.QUANTITY, "unit_price": L.UNIT_PRICE, "years": L.EXPERIENCE_YEARS}
    return rows.select("query_id", "doc_id", *[F.regexp_extract("body", p, 0).alias(c) for c, p in patterns.items()])
