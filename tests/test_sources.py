"""Folder rules, office parsers, the job chain and the incremental stream."""

import os
import zipfile

from pyspark.sql import functions as F
import pytest

from dossierlake.config import Settings, load_settings
from dossierlake.operators import ingest as IN, state as ST
from dossierlake.service import ChapterNotFound, Dossiers
from dossierlake.sources import files as FS, parsers as P
from dossierlake.streaming import incremental as INC

PATHS = [
    ("keep/report.pdf", ""), ("old/a.pdf", "old_path"), ("00.old/a.pdf", "old_path"), ("p/x_old/a.pdf", "old_path"),
    ("참고자료/a.pdf", "reference_material"), ("01_참조용/a.pdf", "reference_material"), ("고객제공자료/a.pdf", "reference_material"),
    ("사업관리/a.pdf", "reference_material"), ("증빙서류/a.pdf", "reference_material"), ("03.계약/a.pdf", "reference_material"),
    ("reference/a.pdf", "reference_material"), ("temp/a.pdf", "temp_or_hidden"), (".git/a.pdf", "temp_or_hidden"),
    ("keep/~$a.pdf", "temp_or_hidden"), ("keep/memo.txt", "unsupported_extension"), ("keep/백업본.pdf", "exclude_pattern"),
]


def test_exclusion_reasons(spark):
    rows = spark.createDataFrame(PATHS, "path string, expected string")
    got = rows.withColumn("reason", FS.exclusion_reason(F.col("path"), patterns=("백업",)))
    assert [(r.path, r.reason) for r in got.collect() if r.reason != r.expected] == []


def docx(path, paragraphs):
    body = "".join(
        f'<w:p>{"<w:pPr><w:pStyle w:val=%sHeading1%s/></w:pPr>" % (chr(34), chr(34)) if heading else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
        for text, heading in paragraphs
    )
    xml = f'<w:document xmlns:w="{P.WORD[1:-1]}"><w:body>{body}</w:body></w:document>'
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", xml)


def pptx(path, slides):
    with zipfile.ZipFile(path, "w") as archive:
        for number, shapes in enumerate(slides, start=1):
            body = "".join(f"<p:sp><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sp>" for text in shapes)
            archive.writestr(
                f"ppt/slides/slide{number}.xml",
                f'<p:sld xmlns:p="{P.SLIDES[1:-1]}" xmlns:a="{P.DRAWING[1:-1]}">{body}</p:sld>',
            )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("root") / "자료"
    project = root / "2021_공항_클라우드 구축"
    project.mkdir(parents=True)
    docx(project / "목표모델 보고서.docx", [("Ⅲ. 목표모델 수립", True), ("클린룸 복구 절차와 클라우드 전환 방안", False)])
    pptx(project / "제안서.pptx", [["Ⅰ. 사업 개요", "데이터 이관 계획", "- 7 -"], [], ["MSA 설계"]])
    (project / "깨진.docx").write_bytes(b"not a zip")
    (project / "memo.txt").write_text("x")
    return str(root)


def test_parsers(spark, folder):
    files = FS.scan_folder(spark, folder, content=True).filter("reason = ''")
    parsed = P.parse_files(files)
    assert parsed.filter("error is not null").count() == 1
    units = {(r.file_path.rsplit("/", 1)[-1], r.page_no): r for r in P.units_of_files(parsed).collect()}
    assert units[("목표모델 보고서.docx", 1)].chapter_title == "목표모델"
    assert units[("제안서.pptx", 1)].display_page == "7" and ("제안서.pptx", 3) in units and ("제안서.pptx", 2) not in units


def test_job_chain(spark, folder, tmp_path):
    dossiers = Dossiers(spark, Settings(data_dir=str(tmp_path / "index")))
    counts = dossiers.index([folder], version=1)
    assert (counts["projects"], counts["documents"], counts["failed"], counts["excluded"]) == (1, 2, 1, 1)
    hits = dossiers.search("클린룸 복구", 3).collect()
    assert hits[0].document_title == "목표모델 보고서" and "클린룸" in hits[0].matched_text
    assert dossiers.tables().projects.first().client_name == "공항"
    assert dossiers.validate().first().metadata_ready
    again = dossiers.index([folder], version=2, rebuild=False)
    assert again["documents"] == 2 and again["chunks"] == counts["chunks"]
    assert dossiers.search("클라우드", 3, filters=dossiers.chapter_filters("To-Be")).first().document_title == "목표모델 보고서"
    with pytest.raises(ChapterNotFound) as missing:
        dossiers.chapter_filters("이행계획")
    assert "목표모델" in str(missing.value.suggestions) or missing.value.suggestions == []
    report = dossiers.diagnostics(5)
    ST.write_report(report, str(tmp_path / "report"))
    ST.export_csv(report, str(tmp_path / "csv"))
    first = report.filter("query_id = 4 and rank = 1").first()
    assert first.search_domain == "technology_trend" and "MSA" in first.matched_text
    requests = spark.createDataFrame([("r", "상세 요구사항\n클라우드 전환 방안을 제시하고 MSA 설계")], "id string, text string")
    assert dossiers.match_request(requests, 5)["projects"].first().project_name.startswith("클라우드")


def test_versions_survive_failures(spark, tmp_path):
    from dossierlake.operators.versions import BUCKETS, Versions, bucket_of, buckets_of

    store = Versions(spark, str(tmp_path / "v"))
    rows = spark.range(500).selectExpr("concat('d', id) AS document_id", "id AS n")
    empty = spark.createDataFrame([], "project_id string")
    store.publish(1, {"documents": (rows, "document_id"), "projects": (empty, "project_id")})
    assert store.read("documents").count() == 500 and store.read("projects").count() == 0
    for number in (1, 0):  # a repeated number changes nothing
        with pytest.raises(ValueError):
            store.publish(number, {"documents": (rows.limit(1), "document_id")})
    broken = rows.withColumn("n", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):  # fails after the first of two tables
        store.publish(2, {"projects": (empty, "project_id"), "documents": (broken, "document_id")})
    assert store.numbers() == [1] and store.read("documents").count() == 500
    one = rows.filter("document_id = 'd7'")
    touched = buckets_of(one, "document_id")
    before = {r["bucket"]: r["folder"] for r in store.manifest(1) if r["name"] == "documents"}
    changed = store.read("documents", touched).withColumn("n", F.when(F.col("document_id") == "d7", -1).otherwise(F.col("n")).cast("bigint"))
    store.publish(3, {"documents": (changed, "document_id"), "projects": (empty, "project_id")}, {"documents": touched, "projects": set()})
    after = {r["bucket"]: r["folder"] for r in store.manifest(3) if r["name"] == "documents"}
    assert {b for b in after if after[b] != before[b]} == touched and len(touched) == 1 < BUCKETS
    now = {r["document_id"]: r["n"] for r in store.read("documents").collect()}
    assert len(now) == 500 and now["d7"] == -1 and store.read("documents", version=1).filter("n = 7").count() == 1
    store.clear()
    assert store.read("documents").count() == 0 and store.read("documents").columns == ["document_id", "n"]
    assert rows.select(bucket_of(F.col("document_id")).alias("b")).filter("b < 0").count() == 0


def test_newest_rule_across_runs(spark, tmp_path):
    """A newer copy takes the place of the indexed one; an older copy is left out; the report says so."""
    top = tmp_path / "in"
    root = top / "20240101_공항_사업"
    root.mkdir(parents=True)

    def put(name, text, mtime):
        docx(root / name, [(line, i == 0) for i, line in enumerate(text.split("\n"))])
        os.utime(root / name, (mtime, mtime))

    body = "목표모델 수립\n" + "\n".join(f"클라우드 전환 {i} 단계의 데이터 이관 절차와 검증 방안" for i in range(60))
    put("a.docx", body, 1000)
    dossiers = Dossiers(spark, Settings(data_dir=str(tmp_path / "index")))
    assert dossiers.index([str(top)], 1)["documents"] == 1
    put("b.docx", body + "\n추가 내용", 2000)
    put("c.docx", body + "\n더 오래된 내용", 500)
    counts = dossiers.index([str(top)], 2, rebuild=False)
    assert counts["documents"] == 1 and counts["duplicates"] == 2
    assert [r.file_name for r in dossiers.tables().documents.collect()] == ["b.docx"]
    assert {r.document_id for r in dossiers.tables().chunks.collect()} == {dossiers.tables().documents.first().document_id}
    report = spark.read.json(str(tmp_path / "index/reports/version=0000000002"))
    assert {r["kind"]: r["count"] for r in report.groupBy("kind").count().collect()} == {"duplicate": 2, "indexed": 1}
    put("b.docx", "목표모델 수립\n전혀 다른 내용의 문서", 3000)
    assert dossiers.reindex_document(str(top), "b.docx", 3)["documents"] == 1
    assert "전혀 다른" in dossiers.tables().chunks.first().chunk_text
    assert dossiers.validation()["counts"].count() == 1
    with pytest.raises(ValueError):
        dossiers.index([str(top)], 3)


def test_weights_of_the_settings_change_the_ranking(spark):
    from dossierlake.operators import search as H

    rows = spark.createDataFrame(
        [("1", "클라우드 전환 계획 데이터", "클라우드", "p", "a", 1.0), ("2", "클라우드", "클라우드", "p", "b", 1.0)],
        "chunk_id string, chunk_text string, embedding_text string, project_name string, file_path string, file_mtime double")
    firsts = {w: H.search(rows, "클라우드 전환", 2, weights=w).orderBy("rank").first()["score"] for w in ((1.0, 0.0), (0.0, 1.0))}
    assert firsts[1.0, 0.0] != firsts[0.0, 1.0] or H.search(rows, "클라우드 전환", 2, weights=(0.2, 0.1)).first()["score"] < 0.31


def test_settings(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text("root_folders:\n  - a\n  - b\nsearch:\n  top_k: 7\n", encoding="utf-8")
    settings = load_settings(str(path))
    assert settings.top_k == 7 and settings.root_folders == ("a", "b") and settings.chunk_size == 1000


def test_upsert_keeps_first_created(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "id int, v string, created string")
    new = spark.createDataFrame([(2, "B", "t1"), (3, "C", "t1")], "id int, v string, created string")
    got = {r.id: (r.v, r.created) for r in ST.upsert(old, new, "id", keep=("created",)).collect()}
    assert got == {1: ("a", "t0"), 2: ("B", "t0"), 3: ("C", "t1")}


def test_incremental_stream(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "document_id string, text string"

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = INC.document_stream(spark, source, spark.createDataFrame([], schema).schema)
        build = lambda docs: IN.with_chunks(IN.units_of(docs))
        INC.index_stream(stream, index, str(tmp_path / "ckpt"), build).trigger(availableNow=True).start().awaitTermination()

    drop([("d1", "first text"), ("d2", "second text")])
    run()
    drop([("d2", "changed text"), ("d3", "third text")])
    run()
    got = {r.document_id: r.chunk_text for r in spark.read.parquet(index).collect()}
    assert got == {"d1": "first text", "d2": "second text", "d3": "third text"}
