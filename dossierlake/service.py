"""The whole job chain: index folders, search the index, match a request document."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.config import Settings
from dossierlake.functions import headings as HD
from dossierlake.functions.text import first_filled, text_or_empty
from dossierlake.operators import (
    dedup as D, delta as DL, ingest as IN, intents as Q, keyword as KW, reports as RP, requests as RQ, rerank as RR, search as H, state as ST,
    tagging as TG, taxonomy as TX,
)
from dossierlake.operators.versions import Versions, buckets_of, numbered_folders
from dossierlake.session import checkpoint
from dossierlake.sources.files import scan_folder, with_metadata
from dossierlake.sources.parsers import parse_files, units_of_files

PROJECT_COLUMNS = ("project_id", "project_name", "client_name", "year", "business_type", "folder_path")
DOCUMENT_COLUMNS = (
    "document_id", "project_id", "document_title", "document_type", "file_path", "file_type", "file_name", "is_final",
    "canonical_key", "file_mtime", "signature",
)
KEYS = {"projects": "project_id", "documents": "document_id", "chunks": "document_id"}


DIAGNOSTIC_HAYSTACK = (
    "document_title", "project_name", "client_name", "canonical_heading_path", "heading_path", "domain_keywords", "matched_text",
)
# The test queries of the search diagnostics.
QUALITY_QUERIES = (
    "목표모델에서 DR 관련 산출물 찾아줘",
    "목표 아키텍처에서 재해복구 관련 내용 찾아줘",
    "To-Be 인프라에서 RTO RPO 관련 내용 찾아줘",
    "목표시스템에서 이중화 방안 찾아줘",
    "정보기술동향에서 MSA 관련 내용 찾아줘",
    "기술 트렌드에서 마이크로서비스 관련 내용 찾아줘",
    "비용산정에서 클라우드 TCO 근거 찾아줘",
    "소요예산에서 클라우드 사용량 기반 비용 찾아줘",
    "투입인력에서 ISP 경험 있는 PM 찾아줘",
    "참여인력 주요경력에서 ISMP 경험자 찾아줘",
)


class ChapterNotFound(ValueError):
    """No chunk lies in the requested chapter; carries the closest known chapters."""

    def __init__(self, chapter: str, suggestions: list[str]):
        super().__init__(f"no chapter {chapter!r}; close: {', '.join(suggestions) or 'none'}")
        self.chapter, self.suggestions = chapter, suggestions


@dataclass(frozen=True)
class IndexTables:
    projects: DataFrame
    documents: DataFrame
    chunks: DataFrame


class Dossiers:
    """A thin handle on one index folder; every method only composes operators."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings

    def _path(self, name: str) -> str:
        return f"{self.settings.data_dir.rstrip('/')}/{name}"

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, self._path("index"))

    def tables(self) -> IndexTables:
        return IndexTables(*[self.versions.read(n) for n in ("projects", "documents", "chunks")])

    def scan(self, roots: list[str]) -> DataFrame:
        s = self.settings
        parts = [
            with_metadata(scan_folder(
                self.spark, root, s.supported_extensions, s.exclude_patterns, s.exclude_reference_materials, content=True), root)
            for root in roots
        ]
        return reduce(DataFrame.unionByName, parts)

    def index(self, roots: list[str], version: int, rebuild: bool = True) -> dict[str, int]:
        """Scan, parse, drop duplicates, chunk, publish a new version of the three tables and its report.

        Without `rebuild`, files the index holds already are skipped. New documents are compared with the
        indexed ones of their projects: the newest of a group of duplicates stays, whichever side it is on,
        and an indexed document that goes takes its chunks along. Only touched buckets are written.
        """
        scanned = self.scan(roots)
        accepted = scanned.filter(F.col("reason") == "")
        before = None if rebuild or not self.versions.numbers() else self.tables()
        if before is not None:
            accepted = ST.not_indexed(accepted, before.documents, "document_id")
        return self._run(scanned, accepted, before, version)

    def reindex_document(self, root: str, file_path: str, version: int) -> dict[str, int]:
        """K4: one file parsed again; its chunks are replaced and older duplicates of it go."""
        scanned = self.scan([root]).filter(F.col("file_path").endswith(file_path))
        return self._run(scanned, scanned.filter(F.col("reason") == ""), self.tables(), version)

    def _run(self, scanned: DataFrame, accepted: DataFrame, before: IndexTables | None, version: int) -> dict[str, int]:
        s = self.settings
        # Parsed text is the costly part: it is written once and read by every later step.
        parsed = checkpoint(parse_files(accepted))
        units = units_of_files(parsed)
        meta = accepted.drop("content", "reason", "length", "relative_path")
        texts = units.groupBy("file_path").agg(
            F.array_sort(F.collect_list(F.struct("page_no", "unit_text"))).alias("pages")
        ).select("file_path", F.array_join(F.transform("pages", lambda p: p["unit_text"]), "\n").alias("text"))
        fresh = checkpoint(meta.join(texts, "file_path").withColumn("signature", D.signature("text")))
        judged = checkpoint(self._newest(fresh, before, version))
        documents = fresh.join(judged.filter("kept").select("document_id"), "document_id", "left_semi")
        described = units.join(documents.drop("text", "signature"), "file_path")
        chunks = IN.chunks_of_units(described, size=s.chunk_size, overlap=s.chunk_overlap)
        context = F.concat_ws(" ", "document_title", "file_name", "file_path")
        ranked = TG.design_keywords(documents, "document_id", "text", context, more_stops=s.stop_words)
        keywords = ranked.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("k")).select(
            "document_id", F.array_join(F.transform("k", lambda x: x["keyword"]), ", ").alias("keywords")
        )
        new = {
            "projects": documents.select(*PROJECT_COLUMNS).dropDuplicates(["project_id"]),
            "documents": documents.select(*DOCUMENT_COLUMNS), "chunks": chunks.join(keywords, "document_id", "left"),
        }
        touched = None if before is None else self._merge(new, judged)
        self.versions.publish(version, {n: (t, KEYS[n]) for n, t in new.items()}, touched)
        return self._report(scanned, parsed, judged, version)

    def _merge(self, new: dict[str, DataFrame], judged: DataFrame) -> dict[str, set[int]]:
        """Put the touched buckets with the changes in them in place of the new tables; gives the buckets."""
        gone = judged.filter("NOT kept").select("document_id")
        touched = {
            "projects": buckets_of(new["projects"], "project_id"),
            "documents": buckets_of(new["documents"].select("document_id").union(gone), "document_id"),
        }
        touched["chunks"] = touched["documents"]
        old = {n: self.versions.read(n, touched[n]) for n in new}
        left = {n: old[n].join(gone, "document_id", "left_anti").select(*old[n].columns) for n in ("documents", "chunks")}
        new["projects"] = ST.upsert(old["projects"], new["projects"], "project_id")
        new["chunks"] = ST.replace_by_key(
            ST.not_indexed(left["chunks"], new["documents"], "document_id"), new["chunks"], "document_id")
        new["documents"] = ST.upsert(left["documents"], new["documents"], "document_id")
        return touched

    def _newest(self, fresh: DataFrame, before: IndexTables | None, version: int) -> DataFrame:
        """document_id, kept and duplicate_document_id of the new documents and the indexed ones they meet in the kept postings.

        The duplicate rule needs a number as key; it is the leading part of the document id. Postings of documents
        that have gone since, or of a run that failed, find no document.
        """
        def keyed(rows: DataFrame) -> DataFrame:
            number = F.conv(F.substring("document_id", 5, 15), 16, 10).cast("bigint").alias("number")
            return rows.select("document_id", "project_id", "file_mtime", "signature", number)

        new, names = keyed(fresh), ("number", "project_id")
        indexed = None if before is None else keyed(ST.not_indexed(before.documents, fresh, "document_id"))
        bases = [b for b in numbered_folders(self.spark, self._path("postings"), "base") if b in self.versions.numbers()]
        base = self._path(f"postings/base={(bases[-1] if indexed is not None and bases else version):010d}")
        if indexed is None or not bases:
            built = new if indexed is None else indexed
            DL.common_hashes(built, *names).write.mode("overwrite").parquet(f"{base}/common")
        common = self.spark.read.parquet(f"{base}/common")
        added = checkpoint(DL.prefixes(new, *names, common))
        if indexed is None:
            judged = D.keep_newest(new, "number", "signature", "project_id", "file_mtime", signed=True)
        else:
            if not bases:
                DL.save(DL.prefixes(indexed, *names, common), f"{base}/lists")
            judged = DL.keep_newest(new, indexed, added, DL.kept(self.spark, f"{base}/lists", added), *names, "file_mtime")
        judged = checkpoint(judged.select("number", "kept", "duplicate_of"))
        DL.save(added.join(judged.where("kept").select(F.col("number").alias("leader")), "leader", "left_semi"), f"{base}/lists")
        named = new.select("number", "document_id")
        named = named if indexed is None else named.unionAll(indexed.select("number", "document_id"))
        other = named.select(F.col("number").alias("duplicate_of"), F.col("document_id").alias("duplicate_document_id"))
        return named.join(judged.select("number", "kept", "duplicate_of"), "number").join(other, "duplicate_of", "left").select(
            "document_id", "kept", "duplicate_document_id")

    def _report(self, scanned: DataFrame, parsed: DataFrame, judged: DataFrame, version: int) -> dict[str, int]:
        """K8: a row for each excluded, failed, duplicate and indexed file, as JSON lines next to the index."""
        now = self.tables()
        path = scanned.select("document_id", "file_path")
        sizes = now.chunks.groupBy("document_id").agg(
            F.count("*").alias("chunk_count"), F.concat_ws(", ", F.array_sort(F.collect_set("chapter_title"))).alias("chapters"))
        kind = lambda name: F.lit(name).alias("kind")
        parts = [
            scanned.filter(F.col("reason") != "").select(kind("excluded"), "document_id", "file_path", F.col("reason").alias("detail")),
            parsed.filter(F.col("error").isNotNull()).select(kind("failed"), "file_path", F.col("error").alias("detail")),
            judged.filter("NOT kept").join(path, "document_id", "left").select(
                kind("duplicate"), "document_id", "file_path", F.col("duplicate_document_id").alias("detail")),
            judged.filter("kept").join(path, "document_id").join(sizes, "document_id").select(
                kind("indexed"), "document_id", "file_path", "chunk_count", F.col("chapters").alias("detail")),
        ]
        report = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        target = self._path(f"reports/version={version:010d}")
        ST.write_report(report, target)
        kinds = {r["kind"]: r["count"] for r in self.spark.read.schema(report.schema).json(target).groupBy("kind").count().collect()}
        return {
            "projects": now.projects.count(), "documents": now.documents.count(), "chunks": now.chunks.count(),
            "failed": kinds.get("failed", 0), "excluded": kinds.get("excluded", 0), "duplicates": kinds.get("duplicate", 0),
        }

    def remove_excluded(self, roots: list[str], version: int) -> dict[str, int]:
        """Indexed documents whose files the rules exclude by now go, with their chunks."""
        excluded = self.scan(roots).filter(F.col("reason") != "").select("document_id")
        now = self.tables()
        gone = checkpoint(now.documents.join(excluded, "document_id", "left_semi").select("document_id"))
        documents, chunks, _ = ST.delete_documents(now.documents, now.chunks, gone)
        tables = {"projects": now.projects, "documents": documents, "chunks": chunks}
        self.versions.publish(version, {n: (t, KEYS[n]) for n, t in tables.items()})
        return {"documents": documents.count(), "removed": gone.count()}

    @property
    def _ranking(self) -> dict:
        s = self.settings
        return {"weights": (s.keyword_weight, s.vector_weight), "dimensions": s.embedding_dimensions}

    def search(self, query: str, k: int | None = None, filters: dict | None = None, scope: dict | None = None) -> DataFrame:
        ranked = H.search(self.tables().chunks, query, k or self.settings.top_k, filters=filters, scope=scope, **self._ranking)
        return H.result_rows(ranked, F.lit(query))

    def chapter_filters(self, chapter: str, filters: dict | None = None) -> dict:
        """Filters with the norms of a chapter, or ChapterNotFound with suggestions."""
        norms = HD.chapter_norms(chapter)
        rows = H.apply_filters(self.tables().chunks, filters)
        filled = rows.filter((F.col("heading_path") != "") & (F.col("heading_norm") != ""))
        if filled.isEmpty() or rows.filter(KW.in_chapter(norms)).isEmpty():
            close = TX.suggest_chapters(RP.chapter_names(rows, 500), "chapter_title", norms)
            raise ChapterNotFound(chapter, [r.chapter_title for r in close.collect()])
        return {**(filters or {}), "chapter_norms": norms}

    def topic_search(self, queries: DataFrame, k: int | None = None, filters: dict | None = None, scope: dict | None = None) -> DataFrame:
        """Parse, expand, search wide, rerank: the best k results of every query (query_id, query_text).

        Q11, F8: a chapter found in a query filters its results; where nothing is left, the query is searched
        again without that filter. There are as many filtered searches as chapters in the lexicon at most.
        """
        k = k or self.settings.top_k
        parsed = checkpoint(Q.expand_queries(Q.parse_queries(queries)))
        asked = parsed.select("query_id", first_filled("semantic_query", "query_text").alias("query_text"), "target_chapter")
        chunks, wide = self.tables().chunks, max(3 * k, k + 20)

        def searched(rows: DataFrame, filters_: dict | None) -> DataFrame:
            return H.search_batch(chunks, rows.drop("target_chapter"), wide, filters=filters_, scope=scope, **self._ranking)

        found = parsed.filter(F.col("target_chapter") != "").select("target_chapter").distinct().collect()
        chapters = [] if "chapter_norms" in (filters or {}) else [r[0] for r in found]
        narrow = [
            searched(asked.filter(F.col("target_chapter") == c), {**(filters or {}), "chapter_norms": HD.chapter_norms(c)}) for c in chapters]
        if narrow:
            within = checkpoint(reduce(DataFrame.unionByName, narrow))
            rest = asked.join(within.select("query_id").distinct(), "query_id", "left_anti")
            found = within.unionByName(searched(rest, filters))
        else:
            found = searched(asked, filters)
        rows = H.result_rows(found, F.col("query_text")).drop("rank", "query_text")
        return RR.rerank(rows.join(parsed, "query_id"), "chunk_id", k).withColumn("score", F.col("final_score"))

    def diagnostics(self, k: int = 10) -> DataFrame:
        """The fixed test queries with their results and matched or missing keywords."""
        queries = self.spark.createDataFrame(list(enumerate(QUALITY_QUERIES)), "query_id int, query_text string")
        rows = self.topic_search(queries, k)
        hay = F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in DIAGNOSTIC_HAYSTACK]))
        return rows.withColumn("hay", hay).select(
            "query_id", "query_text", "search_domain", "target_chapter", "target_section", "target_subsection", "confidence",
            "rank", "score", "keyword_score", "vector_score", "project_name", "client_name", "document_title", "display_page",
            RP.document_area().alias("area"), "matched_text",
            F.filter("expanded_keywords", lambda w: F.contains(F.col("hay"), F.lower(w))).alias("matched_expanded"),
            F.slice(F.filter("expanded_keywords", lambda w: ~F.contains(F.col("hay"), F.lower(w))), 1, 20).alias("missing_expanded"),
        )

    def match_request(self, requests: DataFrame, k: int | None = None) -> dict[str, DataFrame]:
        """G1-G7 for a table (id, text): summaries, best chunks and similar projects."""
        k = k or self.settings.top_k
        summary = RQ.summarize(requests, "text")
        queries = RQ.weighted_queries(summary, "id", "sections", "text").withColumn(
            "query_id", F.concat_ws("/", F.col("id").cast("string"), F.col("position").cast("string"))
        )
        queries = checkpoint(queries)
        found = H.search_batch(self.tables().chunks, queries.select("query_id", "query_text"), k, **self._ranking)
        weighted = found.join(queries.select("query_id", "id", "weight"), "query_id")
        best = RQ.fuse_queries(weighted, "id", "chunk_id", "score", "weight")
        asked = summary.select("id", F.col("summary_text").alias("asked"))
        rows = best.join(self.tables().chunks, "chunk_id").join(asked, "id")
        rows = H.result_rows(rows, F.col("asked")).drop("asked")
        return {"summary": summary, "results": rows, "projects": RQ.aggregate_projects(rows, "id", "chunk_id")}

    def validate(self) -> DataFrame:
        now = self.tables()
        return RP.validation_counts(now.chunks, now.documents, IN.INDEX_VERSION)

    def validation(self) -> dict[str, DataFrame]:
        """A5: the counts, three distributions and the least certain headings."""
        chunks = self.tables().chunks
        levels = ("canonical_chapter_title", "canonical_section_title", "canonical_subsection_title")
        return {
            "counts": self.validate(), **{c: RP.distribution(chunks, F.col(c)) for c in levels},
            "low_confidence": RP.low_confidence_examples(chunks),
        }
