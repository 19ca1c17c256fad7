"""Command line: index folders, search, match a request. Prints JSON lines."""

from __future__ import annotations

import argparse
import json

from dossierlake.config import Settings, load_settings
from dossierlake.service import Dossiers
from dossierlake.session import build_session

SHOWN = (
    "rank", "chunk_id", "project_name", "document_title", "file_path", "page_no", "display_page", "score", "keyword_score",
    "vector_score", "matched_keywords", "missing_keywords", "keyword_coverage", "matched_text", "canonical_heading_path",
)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Evidence search over document folders")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("--root", nargs="+", required=True)
    index.add_argument("--version", type=int, required=True)
    index.add_argument("--rebuild", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int)
    request = commands.add_parser("rfp")
    request.add_argument("path")
    request.add_argument("--top-k", type=int)
    args = parser.parse_args(argv)

    spark = build_session()
    dossiers = Dossiers(spark, load_settings(args.config) if args.config else Settings())
    if args.command == "index":
        print(json.dumps(dossiers.index(args.root, args.version, args.rebuild), ensure_ascii=False))
    elif args.command == "search":
        # The result list is bounded by top-k.
        for line in dossiers.search(args.query, args.top_k).select(*SHOWN).orderBy("rank").toJSON().collect():
            print(line)
    else:
        from dossierlake.sources.files import scan_folder
        from dossierlake.sources.parsers import parse_files, units_of_files
        from pyspark.sql import functions as F

        units = units_of_files(parse_files(scan_folder(spark, args.path, references=False, content=True)))
        texts = units.groupBy(F.col("file_path").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("page_no", "unit_text"))).alias("p")
        ).select("id", F.array_join(F.transform("p", lambda u: u["unit_text"]), "\n\n").alias("text"))
        for line in dossiers.match_request(texts, args.top_k)["projects"].orderBy("id", "rank").toJSON().collect():
            print(line)


if __name__ == "__main__":
    main()
