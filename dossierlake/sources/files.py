"""Files of a folder tree: listing, exclusion reasons, project and document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake.functions import labels as L
from dossierlake.functions.text import bind, contains_any, stable_id

# Names that exclude a file.
TEMPORARY_NAMES = ("temp", "tmp", "임시")
OLD_ENDINGS = "(^old$|[._-]old$)"
REFERENCE_PARTS = ("참고", "참조", "고객제공")
REFERENCE_NAMES = ("reference", "references")
ADMINISTRATIVE_PARTS = (
    "관리산출물", "사업관리", "계약", "계약cm", "cm30", "cm50", "증빙", "증빙서류", "신용평가", "건강보험", "자격득실",
    "등급확인", "착수계", "서약서", "공문", "발신공문", "수신공문", "의사소통관리", "보안관리", "감리", "양식", "출입증",
    "업체등록", "사업자등록증", "sw제품", "상용sw", "라이선스", "보증", "하자", "하자보증", "검수", "검사", "완료검사", "납품",
    "납품확인", "확약서", "구매", "물품", "자료요청", "요청의건", "실적", "투입인력", "프로파일", "수행조직", "정보화조직",
    "조견표", "일반현황", "제안업체", "템플릿", "기타문서", "차량주차등록", "주차장이용",
)
NAME_MARKS = " _-.()[]"
SUPPORTED = (".pdf", ".docx", ".pptx", ".ppt")


def compact_name(part: Column) -> Column:
    """Lower-cased, marks removed, leading digits removed."""
    return F.regexp_replace(F.translate(F.lower(F.trim(part)), NAME_MARKS, ""), "^[0-9]+", "")


def exclusion_reason(
    relative_path: Column, extensions: tuple[str, ...] = SUPPORTED, patterns: tuple[str, ...] = (), references: bool = True
) -> Column:
    """The first rule that excludes a file, '' where none does.

    The rules read the path below the scanned root, so a root inside a temporary folder
    still yields its files.
    """
    path = F.replace(relative_path, F.lit("\\"), F.lit("/"))

    def reason(parts: Column) -> Column:
        name = F.element_at(parts, -1)
        hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | compact_name(p).isin(*TEMPORARY_NAMES))
        old = F.exists(parts, lambda p: F.rlike(F.lower(F.trim(p)), F.lit(OLD_ENDINGS)))
        material = F.exists(
            parts,
            lambda p: bind(compact_name(p), lambda c: contains_any(c, REFERENCE_PARTS + ADMINISTRATIVE_PARTS) | c.isin(*REFERENCE_NAMES)),
        )
        suffix = F.lower(F.regexp_extract(name, "[^.](\\.[^.]+)$", 1))
        low = F.lower(path)
        wanted = [p.lower().replace("\\", "/") for p in patterns if p]
        return (
            F.when(hidden | F.startswith(name, F.lit("~$")), "temp_or_hidden")
            .when(old, "old_path")
            .when(F.lit(references) & material, "reference_material")
            .when(~suffix.isin(*extensions), "unsupported_extension")
            .when(contains_any(low, wanted) if wanted else F.lit(False), "exclude_pattern")
            .otherwise("")
        )

    return bind(F.split(path, "/"), reason)


def scan_folder(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = SUPPORTED, patterns: tuple[str, ...] = (),
    references: bool = True, content: bool = False,
) -> DataFrame:
    """Every file below the root with its reason; file contents are read only on request.

    Spark's file index itself leaves out names that start with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    relative = F.substring(plain, F.length(F.lit(base)) + 2, F.length(plain))
    columns = [
        plain.alias("file_path"), relative.alias("relative_path"),
        F.unix_timestamp("modificationTime").cast("double").alias("file_mtime"), "length",
    ]
    rows = files.select(*columns, *(["content"] if content else []))
    return rows.withColumn("reason", exclusion_reason(F.col("relative_path"), extensions, patterns, references))


def with_metadata(files: DataFrame, root: str) -> DataFrame:
    """Project and document columns of scanned files."""
    base = root.rstrip("/")
    parts = F.split("relative_path", "/")
    folder = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(base.rsplit("/", 1)[-1]))
    folder_path = F.when(F.size(parts) > 1, F.concat(F.lit(base + "/"), F.get(parts, F.lit(0)))).otherwise(F.lit(base))
    name = F.element_at(parts, -1)
    rows = files.withColumns({
        "folder_path": folder_path, "file_name": name, "project": L.parse_project_folder(folder),
        "document_title": F.regexp_replace(name, "\\.[^.]+$", ""),
    })
    return rows.withColumns({
        "project_id": stable_id("folder_path", "prj"), "document_id": stable_id("file_path", "doc"),
        "project_name": F.col("project.project_name"), "client_name": F.col("project.client_name"),
        "year": F.col("project.year"), "business_type": F.col("project.business_type"),
        "file_type": F.lower(F.regexp_extract("file_name", "\\.([^.]+)$", 1)),
        "document_type": L.document_type("file_name"), "is_final": L.is_final("document_title"),
        "canonical_key": F.concat_ws(":", F.nullif(F.lower(folder), F.lit("")), L.canonical_key(F.col("document_title"))),
    }).drop("project")
