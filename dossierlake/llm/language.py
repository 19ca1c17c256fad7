"""Language identification by nearest centroids.

A text is the TF-IDF vector of its letter n-grams (one to three letters, lower-cased, everything else
being a word gap), hashed to `CELLS` cells and scaled to length one. Every language has up to `CENTROIDS`
centroids, found by clustering a sample of its labelled rows; a text takes the language of the centroid of
largest cosine. A text whose cosine is below the centroid's floor for texts of its length is marked as rejected: it
is nothing like what was learned. One of fewer different n-grams than the first of `LENGTHS` says too little to be rejected.

Cosines grow with the number of different n-grams, so each centroid has a floor for each class of `LENGTHS`. One in `HELD_OUT` rows
of the sample does not go into the centroids; snippets of all lengths of these rows set the floors, `FLOOR_SHARE` of
the `FLOOR_QUANTILE` of their cosines. A centroid with fewer than `ENOUGH` snippets of a class takes the floor of its
language, a class with fewer in the whole language that of the class below. Of a language with fewer
than `ENOUGH` rows in the sample all rows serve both ends, and the floors are halved.

Document counts of n-grams run over all labelled rows. The centroids are fitted on at most
`SAMPLE_PER_LANGUAGE` rows of each language, those of smallest hash of doc_id.

Defined cases: a null text, and one without a letter, is `und` with score 0 and is rejected; with no
labelled row at all every text is `und`; rows without a label are never learned from; ties go to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

UNKNOWN = "und"
CELLS = 8192
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 400
RANK_PARTS = 64
ROUNDS = 8
FLOOR_SHARE, FLOOR_QUANTILE = 0.65, 0.01
LENGTHS = np.array([40, 80, 160, 320, 640])
SNIPPETS = (25, 35, 50, 80, 130, 200, 300, 500, 1000, 2000)
HELD_OUT, ENOUGH = 4, 20
BLOCK = 1 << 20
GRAM_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """How often each cell's n-grams occur; None for a text without letters. Works block by block."""
    if not text:
        return None
    total, found = np.zeros(CELLS, np.int64), False
    for start in range(0, len(text), BLOCK):
        # two code points of the block before keep the n-grams across the edge
        points = np.frombuffer(text[max(0, start - 2) : start + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letter_table()[points]
        if not letter.any():
            continue
        found = True
        marks = np.where(letter, points, np.uint32(32))
        marks = np.concatenate([[np.uint32(32)], marks[np.concatenate([[True], letter[1:] | letter[:-1]])], [np.uint32(32)]])
        single = marks * GRAM_FACTORS[0]
        pair = single[:-1] ^ (marks[1:] * GRAM_FACTORS[1])
        triple = pair[:-1] ^ (marks[2:] * GRAM_FACTORS[2])
        for grams in (single, pair + np.uint32(1), triple + np.uint32(2)):
            grams = (grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            total += np.bincount(grams >> np.uint32(19), minlength=CELLS)
    return total if found else None


def vector(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithmic counts times weights, scaled to length one."""
    out = np.log1p(cells) * weights
    length = np.sqrt(out @ out)
    return out / length if length else out


def length_class(cells: np.ndarray) -> int:
    """The class of LENGTHS of a text, by its different n-grams, as repeated words say nothing new; -1 below the first."""
    return int(np.searchsorted(LENGTHS, np.count_nonzero(cells), "right")) - 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected."""
        cells = counts(text)
        if cells is None or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ vector(cells, self.weights)
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        length = length_class(cells)
        return self.languages[best], score, length >= 0 and score < self.floors[best, length]


def clustered(vectors: np.ndarray) -> np.ndarray:
    """The centroids of spherical k-means.

    Starts from the vectors spread furthest from those taken before, so the result depends on the rows alone.
    """
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(CENTROIDS, len(vectors)):
        centres.append(vectors[int(np.argmin((vectors @ np.array(centres).T).max(axis=1)))])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        of = np.argmax(vectors @ centres.T, axis=1)
        centres = np.array([vectors[of == i].mean(axis=0) if (of == i).any() else centres[i] for i in range(len(centres))])
        lengths = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(lengths > 0, lengths, 1)
    return centres


def floors_of(centres: np.ndarray, weights: np.ndarray, texts: list[str], share: float) -> np.ndarray:
    """For each centroid and class of lengths the cosine below which a text is rejected, from the texts and snippets of them."""
    seen: list[list[tuple[int, float]]] = [[] for _ in LENGTHS]
    for text in texts:
        for size in (*(n for n in SNIPPETS if n < len(text)), len(text)):
            for start in {0, (len(text) - size) // 2, len(text) - size}:
                cells = counts(text[start : start + size])
                if cells is not None and (length := length_class(cells)) >= 0:
                    near = centres @ vector(cells, weights)
                    seen[length].append((int(np.argmax(near)), float(near.max())))
    out, below = np.zeros((len(centres), len(LENGTHS))), 0.0
    for length, held in enumerate(seen):
        of, near = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        if len(near) >= ENOUGH:
            below = share * np.quantile(near, FLOOR_QUANTILE)
        for i in range(len(centres)):
            own = near[of == i] if len(near) else near
            out[i, length] = share * np.quantile(own, FLOOR_QUANTILE) if len(own) >= ENOUGH else below
    return out


def fit(labelled: DataFrame) -> Model:
    """The model of `labelled` (doc_id, text, lang); rows without a language are left out.

    Each task sums the document counts of its rows, so the driver gets one row of CELLS numbers per
    language, and the centroids.
    """
    rows = labelled.where("lang IS NOT NULL").select("doc_id", "text", "lang")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                cells = counts(text)
                if cells is not None:
                    held += cells > 0
                    n += 1
        filled = np.flatnonzero(held)
        yield pd.DataFrame({"cell": np.append(filled, -1), "n": np.append(held[filled], n)})

    seen = rows.select("text").mapInPandas(summed, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    by_cell = dict(zip(seen["cell"], seen["n"], strict=True))
    total = by_cell.pop(-1, 0)
    held = np.zeros(CELLS)
    held[list(map(int, by_cell))] = list(by_cell.values())
    weights = np.log((1 + total) / (1 + held)) + 1

    # the smallest hashes of each language, first of each part of it, so that no task ranks a whole language
    ranked = rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id")).alias("hash")).withColumn("part", F.pmod("hash", F.lit(RANK_PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy("hash", "doc_id")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_PER_LANGUAGE).drop("rank")
    ranked = ranked.select("doc_id", "lang").distinct()
    # bounded: SAMPLE_PER_LANGUAGE ids for each language
    sample = rows.join(F.broadcast(ranked), ["doc_id", "lang"], "left_semi")

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"], kind="stable")
        found = [(text, vector(c, weights)) for text, c in zip(frame["text"], map(counts, frame["text"]), strict=True) if c is not None]
        if not found:
            return pd.DataFrame({"lang": [], "centre": [], "floors": []}, dtype=object)
        few = len(found) < ENOUGH
        middle = clustered(np.array([v for i, (_, v) in enumerate(found) if few or i % HELD_OUT]))
        texts = [text for i, (text, _) in enumerate(found) if few or i % HELD_OUT == 0]
        floors = floors_of(middle, weights, texts, FLOOR_SHARE / 2 if few else FLOOR_SHARE)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": list(middle), "floors": list(floors)})

    fitted = sample.groupBy("lang").applyInPandas(centres, "lang string, centre array<double>, floors array<double>").toPandas()
    fitted = fitted.sort_values("lang", kind="stable")
    return Model(
        list(fitted["lang"]), weights, np.array(list(fitted["centre"])) if len(fitted) else np.zeros((0, CELLS)),
        np.array(list(fitted["floors"])) if len(fitted) else np.zeros((0, len(LENGTHS))))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected (columns of these names are replaced); no shuffle.

    The model's size depends on the number of languages only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    rest = docs.drop("lang_pred", "score", "rejected")
    return rest.select("*", predicted("text").alias("__found")).select(
        *(F.col(f"`{c}`") for c in rest.columns), "__found.lang_pred", "__found.score", "__found.rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fits(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.predict(t)[2] for t in texts], dtype=bool)

    return docs.where(fits("text"))
