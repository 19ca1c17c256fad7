"""Search for tables of queries: the queries travel to the rows, and only the best k per query and task come back.

Queries are read in blocks of bounded size, each handed to every task; rows are scanned once per block. What
reaches the shuffle is at most k rows for each query and task, however common a word is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions.tokens import coverage, query_terms
from dossierlake.operators.keyword import SCORE_DIGITS, top_rows_per

QUERIES_IN_BLOCK = 2000
PAIRS_WAITING = 50_000
ROWS_IN_SLICE = 100


def blocks_of(queries: DataFrame) -> Iterator[list]:
    """The rows of `queries` in lists of QUERIES_IN_BLOCK."""
    block = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == QUERIES_IN_BLOCK:
            yield block
            block = []
    if block:
        yield block


class Best:
    """The best k of each query seen so far; the smaller key wins ties."""

    def __init__(self, queries: int, k: int):
        self.k, self.bar = k, np.full(queries, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.waiting = 0

    def add(self, query: np.ndarray, key: list, score: np.ndarray, **more: np.ndarray) -> None:
        good = score >= self.bar[query]
        if not good.any():
            return
        kept = pd.DataFrame({"query": query[good], "key": pd.Series(key, dtype=object)[good].to_numpy(), "score": score[good]}
                            | {c: v[good] for c, v in more.items()})
        self.parts.append(kept)
        self.waiting += len(kept)
        if self.waiting > 200_000:
            self.cut()

    def cut(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"query": [], "key": [], "score": []})
        rows = pd.concat(self.parts).sort_values(["query", "score", "key"], ascending=[True, False, True], kind="stable")
        best = rows.groupby("query", sort=False).head(self.k)
        full = best.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.bar[full.index.to_numpy(int)] = full["min"].to_numpy(float)
        self.parts, self.waiting = [best], 0
        return best


def kind_of(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def scanned(
    rows: DataFrame, queries: DataFrame, key: str, columns: str, start: Callable[[list], Callable[[pd.DataFrame, Best], None]], k: int
) -> DataFrame:
    """Scan `rows` (key first) once per block; `start` gets the block's rows and gives what adds a batch to the best."""
    schema = f"query_id {kind_of(queries, 'query_id')}, {key} {kind_of(rows, key)}, score double{columns}"
    names = [x.strip().split()[0] for x in schema.split(",")]

    def over(block: list) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, add = Best(len(shared.value), k), start(shared.value)
            for batch in batches:
                add(batch, best)
            found = best.cut()
            ids = pd.Series([r["query_id"] for r in shared.value], dtype=object)
            out = found.rename(columns={"key": key}).assign(query_id=ids[found["query"].to_numpy(int)].to_numpy())
            yield out.reindex(columns=names) if len(out) else pd.DataFrame({c: [] for c in names}, dtype=object)

        return rows.mapInPandas(scan, schema)

    parts = [over(block) for block in blocks_of(queries)]
    return reduce(DataFrame.unionAll, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def queries_by_term(block: list) -> tuple[list[str], list[np.ndarray]]:
    found: dict[str, list[int]] = defaultdict(list)
    for i, row in enumerate(block):
        for term in row["terms"]:
            found[term].append(i)
    return list(found), [np.array(x) for x in found.values()]


def coverage_top(
    rows: DataFrame, key: str, hay: Column, queries: DataFrame, k: int, within: Column | None = None
) -> DataFrame:
    """R1 for many queries: (query_id, key, hits, keyword_score, rank), the best k rows of each query.

    One automaton over all terms of the block finds every term that a row contains, as a substring, in one
    pass. F1: with `within` a row is a candidate of a query only if a term occurs there.
    `queries` has columns (query_id, query_text).
    """
    asked = queries.select("query_id", query_terms(F.col("query_text")).alias("terms"))
    texts = rows.select(key, hay.alias("hay"), (F.lit(None).cast("string") if within is None else within).alias("within"))

    def start(block: list):
        import ahocorasick

        terms, owners = queries_by_term(block)
        sizes = np.array([max(1, len(r["terms"])) for r in block])
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(term, i)
        if terms:
            automaton.make_automaton()

        def hits(text: str) -> np.ndarray | None:
            ids = {i for _, i in automaton.iter(text)}
            return np.bincount(np.concatenate([owners[i] for i in ids]), minlength=len(block)) if ids else None

        def add(batch: pd.DataFrame, best: Best) -> None:
            query, keys, counts, waiting = [], [], [], 0

            def hand_over() -> None:
                of, n = np.concatenate(query), np.concatenate(counts)
                best.add(of, keys, n / sizes[of], hits=n, total=sizes[of])

            for value, text, part in zip(batch[key], batch["hay"], batch["within"], strict=True) if terms else ():
                found = hits(text)
                if found is None:
                    continue
                mine = np.flatnonzero(found)
                if part is not None:
                    near = hits(part)
                    mine = mine[near[mine] > 0] if near is not None else mine[:0]
                # a common word makes a pair of every row and query: those below the best so far are not kept
                mine = mine[found[mine] / sizes[mine] >= best.bar[mine]]
                query.append(mine)
                keys += [value] * len(mine)
                counts.append(found[mine])
                waiting += len(mine)
                if waiting > PAIRS_WAITING:
                    hand_over()
                    query, keys, counts, waiting = [], [], [], 0
            if query:
                hand_over()

        return add

    found = scanned(texts, asked, key, ", hits bigint, total bigint", start, k)
    scored = found.select(
        "query_id", key, "hits", F.round(coverage(F.col("hits"), F.col("total")), SCORE_DIGITS).alias("keyword_score"))
    return top_rows_per(scored, "query_id", "keyword_score", key, k)


def vector_top(
    vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int
) -> DataFrame:
    """Best k vectors by inner product for each query vector, positive scores only.

    A batch of vectors is scored against a block of queries by one matrix product.
    """
    asked = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("vector"))

    def start(block: list):
        matrix = np.array([r["vector"] for r in block], float)

        def add(batch: pd.DataFrame, best: Best) -> None:
            good = batch[batch[vector].notna()]
            if not len(good):
                return
            values, keys = good[vector].to_numpy(), good[key].to_numpy(object)
            for at in range(0, len(values), ROWS_IN_SLICE):
                scores = np.round(np.stack(values[at : at + ROWS_IN_SLICE]).astype(float) @ matrix.T, SCORE_DIGITS)
                row, query = np.nonzero((scores > 0) & (scores >= best.bar))
                best.add(query, keys[at + row].tolist(), scores[row, query])

        return add

    return top_rows_per(scanned(vectors.select(key, vector), asked, key, "", start, k), "query_id", "score", key, k)
