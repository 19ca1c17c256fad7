"""Domain tags and weighted design keywords of documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.functions.text import bind, contains_any, text_or_empty
from dossierlake.functions.tokens import PLAIN_WORD, expand_synonyms, tokenize
from dossierlake.lexicons import fixed_values as V

# Vote weights, limits and word shapes.
KOREAN_TAGS = {
    "DR": V.DR_KEYWORDS, "CLOUD_COST": V.CLOUD_COST_KEYWORDS, "MSA": V.MSA_KEYWORDS, "STAFF": V.STAFF_KEYWORDS,
    **V.TECHNICAL_DOMAIN_KEYWORD_GROUPS,
}
KEYWORDS_PER_TAG = 4
TAG_LIMIT = 24
PHRASE_VOTES = ((V.TECHNICAL_DESIGN_PHRASES, 14), (V.RESEARCH_DOMAIN_PHRASES, 11), (V.ARCHITECTURE_PHRASES, 8))
CONTEXT_VOTE = 7
TECHNICAL_VOTE = 4
KEYWORD_LIMIT = 12
CONTEXT_TOKENS = 8
TECHNICAL_PARTS = (
    "클라우드", "msa", "마이크로서비스", "api", "컨테이너", "쿠버네티스", "kubernetes", "데브옵스", "cicd", "데이터",
    "인터페이스", "연계", "보안", "인프라", "서비스", "플랫폼",
)
PREDICATE_ENDINGS = ("한다", "된다", "했다", "있다", "없다", "한다면", "되도록")
ORGANIZATION_ENDINGS = ("공사", "공단", "평가원", "연구원", "재단", "위원회", "진흥원", "협회", "청", "부")
VENDOR_ENDINGS = ("컨소시엄", "주식회사")
STOP_PARTS = ("ismp", "bpr", "제안서", "보고서")
GENERIC_MARKS = " ./\\-_,·"
COMMON_RATIO = 0.7
COMMON_MINIMUM = 5


def domain_tags(text: Column, groups: Mapping[str, Sequence[str]] = KOREAN_TAGS) -> Column:
    """Each tag with its first four keywords in the text, twenty-four entries at most."""
    stop = {w.lower() for w in V.DOMAIN_KEYWORD_STOPWORDS}
    entries = [
        F.struct(
            F.lit(tag).alias("tag"),
            F.array(*[
                F.struct(F.lit(w).alias("word"), F.lit(w.lower()).alias("low")) for w in words if w.lower() not in stop
            ]).alias("words"),
        )
        for tag, words in groups.items()
    ]

    def matched(hay: Column, group: Column) -> Column:
        found = F.slice(F.filter(group["words"], lambda w: F.contains(hay, w["low"])), 1, KEYWORDS_PER_TAG)
        named = lambda ws: F.concat(F.array(group["tag"]), F.transform(ws, lambda w: w["word"]))
        none = F.array().cast("array<string>")
        return bind(found, lambda ws: F.when(F.size(ws) > 0, named(ws)).otherwise(none))

    tags = bind(F.lower(text), lambda hay: F.flatten(F.transform(F.array(*entries), lambda g: matched(hay, g))))
    return F.slice(F.array_distinct(tags), 1, TAG_LIMIT)


def compact_generic(value: Column) -> Column:
    return bind(F.lower(value), lambda low: F.when(contains_any(low, tuple(GENERIC_MARKS)), F.translate(low, GENERIC_MARKS, "")).otherwise(low))


def _compact(word: str) -> str:
    return "".join(c for c in word.lower() if c not in GENERIC_MARKS)


def _ends_with(value: Column, endings: Sequence[str]) -> Column:
    return F.rlike(value, F.lit("(?:" + "|".join(endings) + ")$"))


def is_stop_token(token: Column, more: Sequence[str] = ()) -> Column:
    """P20: tokens that never name a design topic; `more` are parts the caller adds, such as names of vendors."""
    # The plain words come first: they are most of a Latin text, and nothing else needs to be known of them.
    plain_word = F.rlike(token, F.lit(PLAIN_WORD)) & ~F.lower(token).isin(*V.ALLOWED_ACRONYMS)
    return plain_word | bind(compact_generic(token), lambda compact: (
        compact.isin(*sorted({_compact(w) for w in V.DOMAIN_STOPWORDS}))
        | F.rlike(token, F.lit("^\\d+$")) | F.rlike(compact, F.lit("^\\d+$")) | (F.length(compact) > 14)
        | _ends_with(compact, ORGANIZATION_ENDINGS + VENDOR_ENDINGS)
        | F.rlike(compact, F.lit("[가-힣]{3,}r$")) | _ends_with(token, PREDICATE_ENDINGS)
        | contains_any(compact, STOP_PARTS + tuple(_compact(w) for w in more if _compact(w)))
    ))


def is_generic_token(token: Column) -> Column:
    return compact_generic(token).isin(*sorted({_compact(w) for w in V.GENERIC_ANCHOR_TERMS}))


def is_variant_token(token: Column) -> Column:
    variants = {_compact(v) for phrases, _ in PHRASE_VOTES for _, values in phrases for v in values}
    return compact_generic(token).isin(*sorted(variants))


def context_text(context: Column) -> Column:
    """Path marks read as blanks, synonyms expanded."""
    return F.translate(expand_synonyms(context), "\\/_-.()[]", " " * 9)


def design_votes(
    rows: DataFrame, key: str, body: Column | str, context: Column | str, more_stops: Sequence[str] = ()
) -> DataFrame:
    """(key, keyword, votes, first_at), before the cut to the best twelve."""
    source = rows.select(F.col(key), text_or_empty(body).alias("body"), text_or_empty(context).alias("context"))
    source = source.withColumn("context_words", context_text(F.col("context")))
    source = source.withColumn("hay", F.concat_ws(" ", "body", "context_words"))
    hay = F.col("hay")
    lowered = F.lower(F.concat_ws(" ", hay, F.col("context")))
    def holds(text: Column, variants: Sequence[str]) -> Column:
        """Spellings with Hangul are looked for only in texts that have any."""
        lows = [v.lower() for v in variants]
        korean = [v for v in lows if any("가" <= c <= "힣" for c in v)]
        return contains_any(text["low"], [v for v in lows if v not in korean]) | (text["hangul"] & contains_any(text["low"], korean))

    fixed = lambda text: [
        F.when(holds(text, variants), F.struct(F.lit(word).alias("keyword"), F.lit(vote).alias("votes")))
        for phrases, vote in PHRASE_VOTES for word, variants in phrases
    ]
    from_context = F.slice(
        F.array_distinct(
            F.filter(
                tokenize("context_words"),
                lambda t: ~t.isin(*V.DOMAIN_STOPWORDS) & ~is_generic_token(t) & ~is_stop_token(t, more_stops) & (F.length(t) >= 2),
            )
        ),
        1, CONTEXT_TOKENS,
    )
    from_text = F.filter(tokenize(hay, tuple(V.ALLOWED_ACRONYMS)), lambda t: ~(is_stop_token(t, more_stops) | is_generic_token(t) | is_variant_token(t)))

    def vote(votes: Column):
        return lambda t: F.struct(t.alias("keyword"), votes.alias("votes"))

    technical = lambda t: F.when(contains_any(t, TECHNICAL_PARTS), TECHNICAL_VOTE + 1).otherwise(1)
    ballots = F.concat(
        bind(bind(lowered, lambda low: F.struct(low.alias("low"), F.rlike(low, F.lit("[가-힣]")).alias("hangul"))),
             lambda text: F.filter(F.array(*fixed(text)), lambda b: b.isNotNull())),
        F.transform(from_context, vote(F.lit(CONTEXT_VOTE))),
        F.transform(from_text, lambda t: F.struct(t.alias("keyword"), technical(t).alias("votes"))),
    )
    cast = source.select(key, F.posexplode_outer(ballots).alias("at", "ballot")).filter(F.col("ballot").isNotNull())
    return cast.groupBy(key, F.col("ballot.keyword").alias("keyword")).agg(
        F.sum("ballot.votes").cast("bigint").alias("votes"), F.min("at").cast("bigint").alias("first_at")
    )


def design_keywords(
    rows: DataFrame, key: str, body: Column | str, context: Column | None = None, limit: int = KEYWORD_LIMIT,
    more_stops: Sequence[str] = (),
) -> DataFrame:
    """(key, keyword, votes, place) with place 1..limit; ties go to the earlier keyword."""
    ctx = F.lit("") if context is None else context
    votes = design_votes(rows, key, body, ctx, more_stops)
    order = Window.partitionBy(key).orderBy(F.desc("votes"), F.asc("first_at"))
    ranked = votes.withColumn("place", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("place") <= limit).drop("first_at")


def without_common_keywords(keywords: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """Drop keywords that stand in at least max(5, 70 %) of the documents."""
    frequency = keywords.groupBy("keyword").agg(F.countDistinct(key).alias("documents"))
    total = documents.agg(F.count("*")).scalar()
    cutoff = F.greatest(F.lit(COMMON_MINIMUM), F.floor(total * COMMON_RATIO))
    common = frequency.filter(F.col("documents") >= cutoff).select("keyword")
    return keywords.join(common, "keyword", "left_anti")
