"""State changes of the index tables: upsert, replace, delete, audit, versions, logs, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import headings as HD, labels as L
from dossierlake.functions.text import first_filled, stable_id
from dossierlake.lexicons.fixed_values import CHAPTER_SYNONYMS


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """K2: incoming rows win, except for the `keep` columns of rows that exist already."""
    untouched = existing.join(incoming.select(key), key, "left_anti")
    if not keep:
        return untouched.select(*existing.columns).unionByName(incoming.select(*existing.columns))
    before = existing.select(key, F.lit(True).alias("was_there"), *[F.col(c).alias(f"before_{c}") for c in keep])
    merged = incoming.join(before, key, "left")
    columns = [
        F.when(F.col("was_there"), F.col(f"before_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c)
        for c in existing.columns
    ]
    return untouched.select(*existing.columns).unionByName(merged.select(*columns))


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """K3: all rows of the incoming keys are exchanged."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(
        incoming.select(*existing.columns)
    )


def delete_documents(
    documents: DataFrame, chunks: DataFrame, removed: DataFrame, key: str = "document_id", chunk: str = "chunk_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K4: remaining documents, remaining chunks, ids of the removed chunks."""
    ids = removed.select(key).distinct()
    return (
        documents.join(ids, key, "left_anti"),
        chunks.join(ids, key, "left_anti"),
        chunks.join(ids, key, "left_semi").select(chunk),
    )


def not_indexed(candidates: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Candidates whose key the index does not hold."""
    return candidates.join(indexed.select(key), key, "left_anti")


def log_rows(queries: DataFrame, kind: str, stamp: Column, text: str = "query_text", count: str = "result_count") -> DataFrame:
    """K6: search log rows; the time stamp is an argument, so that a retry writes the same ids."""
    return queries.select(
        stable_id(F.concat_ws(":", F.lit(kind), F.col(text), stamp.cast("string")), "log").alias("log_id"),
        F.col(text).alias("query_text"), F.lit(kind).alias("query_type"), F.col(count).alias("result_count"),
        stamp.alias("created_at"),
    )


def saved_searches(parsed: DataFrame, stamp: Column, count: str = "result_count") -> DataFrame:
    """Parsed queries kept as JSON."""
    fields = F.to_json(F.struct("search_domain", "target_chapter", "topic", "conditions", "expanded_keywords", "confidence"))
    return parsed.select(
        stable_id(F.concat_ws(":", F.lit("saved"), "query_text", stamp.cast("string")), "ss").alias("saved_search_id"),
        "query_text", fields.alias("parsed_query_json"), F.col(count).alias("result_count"), stamp.alias("created_at"),
    )


def saved_evidence(results: DataFrame, stamp: Column, note: str = "") -> DataFrame:
    """K6: evidence rows that point at a saved search."""
    return results.select(
        stable_id(F.concat_ws(":", F.lit("evidence"), "saved_search_id", "chunk_id", stamp.cast("string")), "ev").alias("evidence_id"),
        "saved_search_id", "chunk_id", "document_id", "page_no", F.lit(note).alias("note"), stamp.alias("created_at"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """K8: report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """K9: result rows for spreadsheets; lists become comma-separated text."""
    flat = [
        F.concat_ws(", ", f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields if f.dataType.typeName() not in ("map", "struct")
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def normalize_chapters(chunks: DataFrame, groups: HD.Groups = CHAPTER_SYNONYMS) -> DataFrame:
    """The heading columns of stored chunks, computed again from the stored titles."""
    named = [
        F.nullif(F.nullif(HD.canonical_chapter(F.col(c), groups), F.lit("")), F.lit(HD.DEFAULT_CHAPTER))
        for c in ("chapter_title", "section_title", "heading_path")
    ]
    rows = chunks.withColumn("chapter_title", F.coalesce(*named, F.lit(HD.DEFAULT_CHAPTER)))
    same = HD.normalize_chapter("section_title") == HD.normalize_chapter("chapter_title")
    rows = rows.withColumn("section_title", F.when(same, F.lit("")).otherwise(F.col("section_title")))
    rows = rows.withColumn("heading_path", HD.heading_path(F.col("chapter_title"), F.col("section_title")))
    rows = rows.withColumns({
        "canonical_chapter_title": F.col("chapter_title"),
        "normalized_chapter_title": HD.normalize_chapter("chapter_title"),
        "normalized_section_title": HD.normalize_chapter("section_title"),
        "normalized_heading_path": HD.normalize_chapter("heading_path"),
        "heading_norm": HD.search_norm(F.col("chapter_title"), F.col("section_title"), F.col("heading_path"), groups),
    })
    return rows.withColumn("heading_norm", first_filled("heading_norm", "normalized_heading_path"))


def repair_projects(projects: DataFrame, folder: str = "folder_name") -> DataFrame:
    """Project name, client, year and business type read from the folder name again."""
    rows = projects.withColumn("parsed", L.parse_project_folder(F.col(folder)))
    return rows.withColumns({
        c: F.col(f"parsed.{c}") for c in ("project_name", "client_name", "year", "business_type")
    }).drop("parsed")
