"""Request documents (RFPs): requirement sections, keywords, weighted queries, fusion per project."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.functions.text import (
    bind, clean_text, contains_any, explode_rows, first_filled, text_or_empty, trim_snippet,
)
from dossierlake.functions.tokens import tokenize
from dossierlake.lexicons import fixed_values as V
from dossierlake.operators.keyword import SCORE_DIGITS, top_rows_per
from dossierlake.operators.tagging import design_votes
from dossierlake.operators.reports import UNKNOWN
from dossierlake.session import written

# Patterns, scores, limits and labels.
MONEY_OR_PERIOD = "(?:\\d[\\d,]*(?:원|천원|만원|백만원|억원)|\\d+\\s*(?:개월|일|년)|\\d{4}[./-]\\d{1,2}(?:[./-]\\d{1,2})?)"
# Every form starts with a digit; most places of a text fail on that one test.
MONEY_FOUND = f"(?=\\d){MONEY_OR_PERIOD}"
SECTION_NUMBER = "(?i)^\\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[IVX]+|\\d+(?:\\.\\d+)*)[.)]?\\s+"
# Words that mark a line as a title.
TITLE_MARKERS = ("한다", "하여", "하고", "위해", "통해", "방안", "체계")
LETTERS = "^[A-Za-z가-힣]+$"
COMPACT_MARKS = " \t\n./\\-_,·:：()[]"
TITLE_CHARS = 32
CONTEXT_AFTER_HEADING = 6
CONTEXT_BEFORE_HEADING = 4
SECTION_LIMIT = 12
SECTION_KEY_CHARS = 120
KEYWORD_LIMIT = 15
PRIORITY_VOTE = 24
DESIGN_VOTE = 12
DESIGN_TOKEN_VOTE = 4
KEYWORDS_PER_QUERY = 4
KEYWORD_QUERY_WEIGHT = 1.45
REQUIREMENT_QUERY_WEIGHT = 1.35
REQUIREMENTS_SHOWN = 8
REQUIREMENT_QUERIES = 6
REQUIREMENT_KEYWORDS = 8
BUSINESS_TYPE_HINTS = ("ISP", "ISMP", "BPR", "PI", "컨설팅", "구축", "운영", "고도화")
NAME_LABELS = ("사업명", "용역명", "과제명")
CLIENT_LABELS = ("발주기관", "수요기관", "기관명")
PURPOSE_LABELS = ("사업목적", "추진목적", "목적")
TOP_SCORES = 5
TOP_REASONS = 3
PROJECT_PAGES = 10
NO_KEYWORDS = "핵심 키워드"


@dataclass(frozen=True)
class RequestLexicon:
    """The hint lists requirement extraction reads; the default is the Korean set."""

    headings: Sequence[str] = V.REQUIREMENT_SECTION_HINTS
    content: Sequence[str] = V.CONSULTING_CONTENT_HINTS
    actions: Sequence[str] = V.REQUIREMENT_ACTION_HINTS
    administrative: Sequence[str] = V.ADMINISTRATIVE_HINTS
    noise: Sequence[str] = V.NOISE_KEYWORDS
    priority: Sequence[tuple[str, Sequence[str]]] = V.PRIORITY_REQUIREMENT_PHRASES


KOREAN_REQUESTS = RequestLexicon()


def compact(value: Column) -> Column:
    return F.translate(F.lower(value), COMPACT_MARKS, "")


def plain_compact(value: str) -> str:
    return "".join(c for c in value.lower() if c not in COMPACT_MARKS)


def _compacts(values: Sequence[str]) -> list[str]:
    return [c for c in dict.fromkeys(plain_compact(v) for v in values) if c]


def is_title_like(paragraph: Column, lexicon: RequestLexicon) -> Column:
    bare = F.trim(F.regexp_replace(paragraph, SECTION_NUMBER, ""))
    return bind(
        bare, lambda b: (F.length(b) <= TITLE_CHARS) & ~contains_any(b, lexicon.actions) & ~contains_any(b, TITLE_MARKERS)
    )


def judge_paragraph(paragraph: Column, lexicon: RequestLexicon) -> Column:
    """struct(text, heading, noise, title, score) of one paragraph."""

    def judged(c: Column) -> Column:
        heading = contains_any(c, _compacts(lexicon.headings))
        content = contains_any(c, _compacts(lexicon.content))
        money = F.rlike(paragraph, F.lit(MONEY_FOUND))
        noise = (money & ~content) | contains_any(c, _compacts(lexicon.administrative))
        flags = F.struct(
            heading.alias("heading"), content.alias("content"), money.alias("money"), noise.alias("noise"),
            is_title_like(paragraph, lexicon).alias("title"),
        )
        return bind(
            flags,
            lambda f: F.struct(
                paragraph.alias("text"), f["heading"].alias("heading"), f["noise"].alias("noise"), f["title"].alias("title"),
                (
                    F.when(f["heading"], 4).otherwise(0) + F.when(f["content"], 3).otherwise(0)
                    + F.when(contains_any(paragraph, lexicon.actions), 1).otherwise(0)
                    - F.when(f["money"], 3).otherwise(0) - F.when(f["title"], 1).otherwise(0)
                ).alias("score"),
            ),
        )

    return bind(compact(paragraph), judged)


def requirement_sections(body: Column, lexicon: RequestLexicon = KOREAN_REQUESTS, limit: int = SECTION_LIMIT) -> Column:
    """G1: a fold over the paragraphs; after a heading the bar is lower for a few paragraphs."""
    lines = F.filter(F.split(clean_text(body), "\n"), lambda l: l != "")
    paragraphs = F.transform(lines, lambda l: judge_paragraph(l, lexicon))
    start = F.struct(F.lit(0).alias("context"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("taken"))

    def fold(ps: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            eager = s["context"] > 0
            by_context = ~p["heading"] & eager & (p["score"] >= 1)
            take = ~p["noise"] & (
                (p["heading"] & ~p["title"] & (p["score"] >= 2)) | by_context | (~p["heading"] & (p["score"] >= 3))
            )
            taken = F.when(take, F.concat(s["taken"], F.array(p["text"]))).otherwise(s["taken"])
            context = (
                F.when(p["noise"], F.greatest(F.lit(0), s["context"] - 1))
                .when(p["heading"], CONTEXT_AFTER_HEADING).when(by_context, s["context"] - 1).otherwise(s["context"])
            )
            next_heading = F.coalesce(F.get(ps, s["at"] + 1)["heading"], F.lit(False))
            raised = ~p["noise"] & ((F.size(s["taken"]) > 0) | take) & next_heading
            moved = F.struct(
                F.when(raised, F.greatest(context, F.lit(CONTEXT_BEFORE_HEADING))).otherwise(context).alias("context"),
                (s["at"] + 1).alias("at"), taken.alias("taken"),
            )
            return F.when(F.size(s["taken"]) >= limit, s).otherwise(moved)

        return F.aggregate(ps, start, step, lambda s: s["taken"])

    def distinct(taken: Column) -> Column:
        keys = F.transform(taken, lambda t: F.substring(compact(t), 1, SECTION_KEY_CHARS))
        return bind(keys, lambda ks: F.filter(taken, lambda t, i: (F.get(ks, i) != "") & (F.array_position(ks, F.get(ks, i)) == i + 1)))

    return F.slice(bind(bind(paragraphs, fold), distinct), 1, limit)


def is_valid_keyword(word: Column, lexicon: RequestLexicon = KOREAN_REQUESTS) -> Column:
    """Two to twenty compact characters, no amount, no number, no noise word."""
    def named(c: Column) -> Column:
        return (F.length(c) >= 2) & (F.length(c) <= 20) & ~contains_any(c, _compacts(lexicon.noise))

    # letters alone hold no mark and are no amount and no number
    other = bind(compact(word), lambda c: named(c) & ~F.rlike(word, F.lit(MONEY_FOUND)) & ~F.rlike(c, F.lit("^\\d+$")))
    return F.when(F.rlike(word, F.lit(LETTERS)), named(F.lower(word))).otherwise(other)


def _sources(requests: DataFrame, key: str, sections: str, body: str) -> DataFrame:
    """Key, sections, body and the text that is searched, written down: many branches read them, and each would fold over the paragraphs."""
    joined = F.array_join(sections, "\n")
    return written(requests.select(
        key, sections, F.when(F.size(sections) > 0, F.col(body)).alias(body),
        F.when(F.size(sections) > 0, joined).otherwise(clean_text(body)).alias("source"),
    ), "requests")


def request_keywords(
    requests: DataFrame, key: str, sections: str, body: str, limit: int = KEYWORD_LIMIT,
    lexicon: RequestLexicon = KOREAN_REQUESTS,
) -> DataFrame:
    """(key, keyword, votes, place) from priority phrases, design keywords and section tokens."""
    return _keywords(_sources(requests, key, sections, body), key, sections, body, limit, lexicon)


def _keywords(rows: DataFrame, key: str, sections: str, body: str, limit: int, lexicon: RequestLexicon) -> DataFrame:
    low = F.lower("source")
    phrases = F.array(*[
        F.when(contains_any(low, [v.lower() for v in variants]), F.struct(F.lit(word).alias("keyword"), F.lit(i).alias("at")))
        for i, (word, variants) in enumerate(lexicon.priority)
    ])
    fixed = explode_rows(rows, [key], F.filter(phrases, lambda p: p.isNotNull()), "b").select(
        key, F.col("b.keyword").alias("keyword"), F.lit(PRIORITY_VOTE).alias("votes"), F.col("b.at").cast("bigint").alias("at")
    )
    design = design_places(rows, key, "source", limit * 2).select(
        key, "keyword", F.lit(DESIGN_VOTE).alias("votes"), (F.col("place") + 1_000).alias("at")
    )
    strong = _compacts(tuple(lexicon.content) + tuple(lexicon.actions))
    tokens = F.flatten(F.transform(sections, lambda s: tokenize(s)))
    cast = rows.select(key, F.posexplode_outer(tokens).alias("at", "keyword")).filter(F.col("keyword").isNotNull())
    spoken = cast.select(
        key, "keyword", F.when(contains_any(compact(F.col("keyword")), strong), DESIGN_TOKEN_VOTE).otherwise(1).alias("votes"),
        (F.col("at") + 1_000_000).cast("bigint").alias("at"),
    )
    ballots = fixed.unionByName(design).unionByName(spoken).filter(is_valid_keyword(F.col("keyword"), lexicon))
    order = [F.desc("votes"), F.asc("at")]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    # Dealt by key once, for the sums and the places; only the best are written down.
    counted = ballots.repartition(key).groupBy(key, "keyword").agg(F.sum("votes").cast("bigint").alias("votes"), F.min("at").alias("at"))
    best = written(counted.withColumn("p", place).filter(F.col("p") <= limit * 2).drop("p"), "best")
    # Keys meet keys first: the texts of the few rows without a word are looked up, the others stay where they are.
    asked = rows.filter(F.size(sections) > 0)
    without = written(asked.select(key).distinct().join(best.select(key).distinct(), key, "left_anti").select(F.col(key).alias("without")), "without")
    silent = asked.join(without, F.col(key).eqNullSafe(F.col("without")), "left_semi")
    fallback = design_places(silent, key, body, limit * 2).filter(is_valid_keyword(F.col("keyword"), lexicon)).select(
        key, "keyword", F.lit(1).cast("bigint").alias("votes"), F.col("place").alias("at")
    )
    ranked = best.unionByName(fallback).withColumn("p", place)
    ranked = ranked.filter(F.col("p") <= limit * 2).withColumn("same", compact(F.col("keyword")))
    first = F.row_number().over(Window.partitionBy(key, "same").orderBy("p"))
    kept = ranked.withColumn("first", first).filter(F.col("first") == 1)
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("p")).cast("bigint"))
    return placed.filter(F.col("place") <= limit).select(key, "keyword", "votes", "place")


def design_places(rows: DataFrame, key: str, body: str, limit: int) -> DataFrame:
    votes = design_votes(rows, key, body, F.lit(""))
    order = Window.partitionBy(key).orderBy(F.desc("votes"), F.asc("first_at"))
    return votes.withColumn("place", F.row_number().over(order).cast("bigint")).filter(F.col("place") <= limit)


def _after_label(body: Column, labels: Sequence[str]) -> Column:
    found = [F.substring(F.trim(F.regexp_extract(body, f"{label}\\s*[:：]\\s*(.+)", 1)), 1, 120) for label in labels]
    return first_filled(*found)


def _purpose(body: Column, labels: Sequence[str]) -> Column:
    lines = F.filter(F.transform(F.split(body, "\n"), lambda l: F.trim(l)), lambda l: l != "")

    def window(ls: Column) -> Column:
        hits = F.filter(F.transform(ls, lambda l, i: F.when(contains_any(l, labels), i)), lambda i: i.isNotNull())
        at = F.get(hits, F.lit(0))
        return F.when(at.isNull(), F.lit("")).otherwise(trim_snippet(F.array_join(F.slice(ls, at + 1, 4), " "), 400))

    return bind(lines, window)


def summarize(
    requests: DataFrame, body: str, lexicon: RequestLexicon = KOREAN_REQUESTS, name_labels=NAME_LABELS,
    client_labels=CLIENT_LABELS, purpose_labels=PURPOSE_LABELS, type_hints=BUSINESS_TYPE_HINTS,
) -> DataFrame:
    """Labelled names, business type, purpose, sections and snippet of each request."""
    text = F.col(body)
    kind = None
    for hint in type_hints:
        hit = F.contains(F.lower(text), F.lit(hint.lower()))
        kind = F.when(hit, F.lit(hint)) if kind is None else kind.when(hit, F.lit(hint))
    return requests.withColumns({
        "business_name": _after_label(text, name_labels), "client_name": _after_label(text, client_labels),
        "business_type": kind.otherwise(F.lit("")), "purpose": _purpose(text, purpose_labels),
        "sections": requirement_sections(text, lexicon), "summary_text": trim_snippet(text, 900),
    }).withColumns({
        "main_requirements": F.slice("sections", 1, REQUIREMENTS_SHOWN), "main_tasks": F.slice("sections", 1, 5),
        "evaluation_items": F.slice(F.filter(F.slice("sections", 1, 8), lambda s: F.contains(s, F.lit("평가"))), 1, 5),
    })


def weighted_queries(
    requests: DataFrame, key: str, sections: str, body: str, lexicon: RequestLexicon = KOREAN_REQUESTS
) -> DataFrame:
    """(key, position, query_text, weight): keywords in fours, then the keywords of each requirement."""
    rows = _sources(requests, key, sections, body)
    words = _keywords(rows, key, sections, body, KEYWORD_LIMIT, lexicon)
    fours = words.groupBy(key, F.floor((F.col("place") - 1) / KEYWORDS_PER_QUERY).alias("position")).agg(
        F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("w")
    ).select(
        key, "position", F.concat_ws(" ", F.transform("w", lambda x: x["keyword"])).alias("query_text"),
        F.lit(KEYWORD_QUERY_WEIGHT).alias("weight"),
    )
    single = rows.select(
        key, F.posexplode_outer(F.slice(sections, 1, REQUIREMENT_QUERIES)).alias("number", "section")
    ).filter(F.col("section").isNotNull())
    single = single.select(
        F.concat_ws("/", F.col(key).cast("string"), F.col("number").cast("string")).alias("part"), key, "number",
        F.array("section").alias("one"), "section",
    )
    part_words = request_keywords(single, "part", "one", "section", REQUIREMENT_KEYWORDS, lexicon)
    per_section = (
        part_words.filter(F.col("place") <= 6).groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("w"))
        .join(single.select("part", key, "number"), "part")
        .select(
            key, (F.col("number") + 100).cast("bigint").alias("position"),
            F.concat_ws(" ", F.transform("w", lambda x: x["keyword"])).alias("query_text"),
            F.lit(REQUIREMENT_QUERY_WEIGHT).alias("weight"),
        )
    )
    both = fours.unionByName(per_section).filter(F.trim("query_text") != "")
    first = F.row_number().over(Window.partitionBy(key, "query_text").orderBy("position"))
    return both.withColumn("n", first).filter(F.col("n") == 1).drop("n")


def fuse_queries(results: DataFrame, request: str, item: str, score: str, weight: str) -> DataFrame:
    """Best weighted score of each item over all queries of a request."""
    weighted = results.withColumn("weighted", F.round(F.col(score) * F.col(weight), SCORE_DIGITS))
    return weighted.groupBy(request, item).agg(F.max("weighted").alias("score"))


def aggregate_projects(results: DataFrame, request: str, item: str, k: int = 10) -> DataFrame:
    """Projects of each request. `results` are the bounded result lists of the requests."""
    order = Window.partitionBy(request, "project_id").orderBy(F.desc("score"), F.asc(item))
    ranked = results.withColumn("n", F.row_number().over(order))
    first_of_document = F.row_number().over(Window.partitionBy(request, "project_id", "document_id").orderBy("n"))
    ranked = ranked.withColumn("in_document", first_of_document)
    by_rank = lambda value, upto=None: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("n") <= upto if upto else F.lit(True), F.struct("n", value.alias("v"))))),
        lambda x: x["v"],
    )
    words = F.concat_ws(", ", F.slice("matched_keywords", 1, 5))
    reason = F.concat(
        "document_title", F.lit(" p."), F.col("page_no").cast("string"), F.lit("에서 "), first_filled(words, F.lit(NO_KEYWORDS)),
        F.lit(" 관련 내용이 매칭됨"),
    )
    usage = F.concat(F.lit("p."), F.col("page_no").cast("string"), F.lit(" 문단을 제안 구조와 근거 문구 참고용으로 활용 가능"))
    titles = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("in_document") == 1, F.struct("n", "document_title")))), lambda x: x["document_title"]
    )
    grouped = ranked.groupBy(request, "project_id").agg(
        F.first("project_name").alias("project_name"),
        F.round(F.round(F.avg(F.when(F.col("n") <= TOP_SCORES, F.col("score"))), 9), SCORE_DIGITS).alias("similarity_score"),
        F.concat_ws(", ", F.slice(titles, 1, 5)).alias("related_documents"),
        F.slice(F.sort_array(F.collect_set(F.when(F.col("page_no") > 0, F.col("page_no")))), 1, PROJECT_PAGES).alias("pages"),
        by_rank(reason, TOP_REASONS).alias("matching_reasons"), by_rank(usage, TOP_REASONS).alias("usage_points"),
    )
    return top_rows_per(grouped, request, "similarity_score", "project_id", k)


def point(value: Column | str, limit: int = 180) -> Column:
    """A text on one line, cut to `limit` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text_or_empty(value), "\\s+", " "))
    return bind(flat, lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))))


def map_requirements(requirements: DataFrame, results: DataFrame, request: str, item: str, k: int = 3) -> DataFrame:
    """The results that share most words with each requirement, with project, page, evidence and use.

    `requirements` (request, number, requirement) and `results` are bounded lists of one
    request, so they meet on the request key. A request without any has a single requirement of null. Where a requirement has
    no usable word, the first results stand for it; what is not known is marked as such.
    """
    requirements = requirements.withColumn("requirement", F.coalesce("requirement", F.lit(UNKNOWN)))
    tokens = F.filter(F.array_distinct(F.split("requirement", "\\s+")), lambda t: (F.length(t) >= 2) & (F.col("requirement") != UNKNOWN))
    wanted = requirements.withColumn("tokens", tokens)
    columns = [c for c in ("document_title", "project_name", "canonical_heading_path", "matched_text") if c in results.columns]
    described = results.withColumn("seen", F.concat_ws(" ", *[text_or_empty(c) for c in columns]))
    pairs = wanted.join(described, request).withColumn(
        "overlap", F.size(F.filter("tokens", lambda t: F.contains(F.col("seen"), t)))
    )
    order = Window.partitionBy(request, "number").orderBy(F.desc("overlap"), F.desc("score"), F.asc(item))
    able = (F.col("overlap") > 0) | (F.size("tokens") == 0)
    best = pairs.filter(able).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    pages = [F.col(c).cast("string") for c in ("display_page", "page_no") if c in results.columns]
    known = {
        "document_title": F.col("document_title"), "project_name": F.col("project_name"), "page": first_filled(*pages, F.lit("")),
        "evidence": point("matched_text"), "usage_point": point("matched_text"),
    }
    found = best.select(request, "number", item, "overlap", "place", *[c.alias(name) for name, c in known.items()])
    return wanted.select(request, "number", "requirement").join(found, [request, "number"], "left").withColumns(
        {name: first_filled(name, F.lit(UNKNOWN)) for name in known})
