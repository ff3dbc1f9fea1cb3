"""Quality by compression: which of two dictionaries makes a text smaller.

A zstandard dictionary is built from labelled good text and one from labelled bad text. Every text is cut into
chunks (a dictionary only helps the first few kilobytes of a frame), each chunk is compressed with both, and
the difference of the two sizes is taken over the size without a dictionary. That, beside how far the text
shrinks without one (repeated text shrinks so far that the difference says little), goes into a logistic curve
fitted on labelled rows that did not build the dictionaries, which gives a score from 0 to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import whole

DICT_ROWS = 1_500  # labelled rows a class that build the dictionaries, at most
FIT_ROWS = 1_500  # labelled rows a class that fit the curve, at most
DICT_BYTES = 112_640
PIECE = 1_024
PIECES = 8  # of one labelled text in a dictionary's sample, from all over it by hash, so that no text fills it alone
CHUNK = 2_048
LEVEL = 3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
MAGIC = b"\x37\xa4\x30\xec"  # how a trained dictionary begins


def fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def pieces(text: str, most: int = PIECES) -> list[bytes]:
    """At most `most` pieces of the whole text, those of the smallest hash, in text order."""
    data = text.encode("utf-8", "surrogatepass")
    found = [(xxhash.xxh64_intdigest(data[i : i + PIECE], seed=i), i) for i in range(0, len(data), PIECE)]
    return [data[i : i + PIECE] for i in sorted(i for _, i in sorted(found)[:most])]


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", rows: int = DICT_ROWS + FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """At most `rows` labelled whole texts a class (`n` numbers their identifiers), and how many usable labels each class has; by the smallest hash of the identifier, never of the held-out fold."""
    usable = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality")).where("__quality in (0, 1)")
    usable = usable.where(fold("__id") != HELD_OUT).groupBy("__id").agg(F.min("__quality").alias("__quality"))
    numbered = usable.withColumn("n", F.row_number().over(Window.partitionBy("__quality").orderBy(F.xxhash64("__id"), "__id")))
    picked = numbered.where(F.col("n") <= rows)  # at most 2 x rows identifiers, so it may be broadcast
    texts = docs.select(F.col(doc_id).alias("__id"), whole(text).alias("text")).join(F.broadcast(picked), "__id")
    counts = {r["__quality"]: r["c"] for r in usable.groupBy("__quality").agg(F.count(F.lit(1)).alias("c")).collect()}
    return texts.select("__id", F.col("__quality").cast("int").alias("quality"), F.col("n").cast("int").alias("n"), "text"), counts


def dictionary(data: list[bytes], size: int = DICT_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on pieces of texts; where they are too few for that, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, data, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"\n".join(data)[-size:] or b"\n\n\n\n\n\n\n\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Model:
    """Two dictionaries (as bytes, so that tasks can be sent them) and a logistic curve."""

    def __init__(self, good: zstandard.ZstdCompressionDict, bad: zstandard.ZstdCompressionDict):
        self.dictionaries = [d.as_bytes() for d in (good, bad)]
        self.kinds = [zstandard.DICT_TYPE_FULLDICT if d[:4] == MAGIC else zstandard.DICT_TYPE_RAWCONTENT for d in self.dictionaries]
        self.weights = (20.0, 0.0, 0.0)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for data, kind in zip(self.dictionaries, self.kinds):
            ready = zstandard.ZstdCompressionDict(data, dict_type=kind)
            ready.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=ready, write_content_size=False, write_dict_id=False))
        return [*made, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]

    def features(self, text: str, tools: list) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / size without, size without / length; (0, 1) for empty texts."""
        data = text.encode("utf-8", "surrogatepass")
        good = bad = plain = 0
        for at in range(0, len(data), CHUNK):
            chunk = data[at : at + CHUNK]
            good += len(tools[0].compress(chunk))
            bad += len(tools[1].compress(chunk))
            plain += len(tools[2].compress(chunk))
        return ((bad - good) / plain, plain / len(data)) if data else (0.0, 1.0)

    def score(self, features: tuple[float, float]) -> float:
        z = features[0] * self.weights[0] + features[1] * self.weights[1] + self.weights[2]
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def train(sample: DataFrame, counts: dict[int, int] | None = None, dict_rows: int = DICT_ROWS) -> Model:
    """Alternate texts build dictionaries and fit the curve; `counts` are the classes' true numbers of rows.

    Whole texts stay in the tasks: a bounded number of pieces a text, or two numbers, come to the driver.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(q, n, i, p) for q, n, t in zip(batch["quality"], batch["n"], batch["text"]) for i, p in enumerate(pieces(t))]
            yield pd.DataFrame(found, columns=["quality", "n", "i", "piece"])

    build = sample.where((F.col("n") % 2 == 1) & (F.col("n") <= 2 * dict_rows)).mapInPandas(cut, "quality int, n int, i int, piece binary")
    found = sorted((r["n"], r["i"], bytes(r["piece"]), r["quality"]) for r in build.collect())
    model = Model(*(dictionary([p for _, _, p, quality in found if quality == q]) for q in (1, 0)))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = model.compressors()
        for batch in batches:
            x = [model.features(t, tools) for t in batch["text"]]
            yield pd.DataFrame({"quality": batch["quality"], "n": batch["n"], "a": [a for a, _ in x], "b": [b for _, b in x]})

    fit = sample.where(F.col("n") % 2 == 0).mapInPandas(measured, "quality int, n int, a double, b double")
    points = [((a, b), q) for q, _, a, b in sorted(tuple(r) for r in fit.collect())]
    if len({q for _, q in points}) == 2:
        fitted = Counter(q for _, q in points)
        model.weights = logistic(points, {q: ((counts or {}).get(q) or n) / n for q, n in fitted.items()})
    return model


def logistic(points: list[tuple[tuple[float, float], int]], weights: dict[int, float], ridge: float = 1e-2) -> tuple[float, ...]:
    """Two slopes and an offset by Newton steps over standardised features, rows weighted by class."""
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    weight = np.where(y == 1, weights[1], weights[0])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - ridge * beta
        hessian = (a * (weight * p * (1 - p) + 1e-12)[:, None]).T @ a + ridge * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:2] / scale
    return (*map(float, slopes), float(beta[2] - slopes @ mean))


def quality_scores(docs: DataFrame, model: Model, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, score) for every row and whole text.

    Null and empty texts get the score of features (0, 1); repeated rows are scored each; an empty table gives an
    empty result; other columns are ignored.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = model.compressors()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [model.score(model.features(t, tools)) for t in batch["text"]]})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInPandas(scored, f"doc_id {kind}, score double")
