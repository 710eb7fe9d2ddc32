"""Quality classifier by compression: zstandard dictionaries of good and bad text, calibrated to a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stage, tidy

#: Labelled rows of each class to build its dictionary from, and as many to calibrate on: the only bound of the fit.
SAMPLE_ROWS = 1000
#: Pieces of a text of which a dictionary is to see a bounded number of bytes; unless fit is told so, it sees whole texts.
SAMPLE_PIECES = 16
DICTIONARY_BYTES = 112_640
#: Texts are compressed in pieces of this size, so that the dictionary counts all through a long text.
PIECE = 2048
LEVEL = 3


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of few texts, their raw bytes."""
    samples = [x for t in texts for x in pieces(t, 1024) if len(x) >= 8]
    try:
        return zs.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"12345678"


class Sizes:
    """Compressed sizes of texts under the dictionaries of bad and of good text."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.packers = []
        for data in (bad, good):
            d = zs.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zs.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> list[float]:
        """The size difference over the size sum; the size over the text's; their squares and product; shortness."""
        bad, good = (sum(len(p.compress(x)) for x in pieces(text)) for p in self.packers)
        gap, density = (bad - good) / (bad + good), min(2.0, (bad + good) / (2 * max(1, len(text))))
        return [gap, density, gap * gap, density * density, gap * density, 1 / (1 + len(text) / 64)]


@dataclass(frozen=True)
class QualityModel:
    bad: bytes
    good: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def scorer(self):
        sizes, mean, scale, w = Sizes(self.bad, self.good), np.array(self.mean), np.array(self.scale), np.array(self.weights)

        def score(texts: list[bytes]) -> np.ndarray:
            if not texts:
                return np.empty(0)
            x = (np.array([sizes.features(t) for t in texts]) - mean) / scale
            return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -40, 40)))

        return score


def calibrate(x: np.ndarray, y: np.ndarray, good_share: float, ridge: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps, the classes weighted as in good_share. Returns mean, scale and weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    share = np.where(y == 1, good_share / max(1, (y == 1).sum()), (1 - good_share) / max(1, (y == 0).sum()))
    w = np.zeros(z.shape[1])
    keep = ridge * np.diag([1e-6] + [1.0] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(len(w)), z.T @ (share * (y - p)) - keep @ w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sampled(text: Column, most: int) -> Column:
    """A binary text, or of one of more than most bytes even pieces from all through it."""
    size, piece = F.octet_length(text), most // SAMPLE_PIECES
    at = lambda i: (F.floor((size - piece).cast("double") * i / (SAMPLE_PIECES - 1)) + 1).cast("int")
    return F.when(size <= most, text).otherwise(F.concat(*[F.substring(text, at(i), F.lit(piece)) for i in range(SAMPLE_PIECES)]))


def _featured(bad: bytes, good: bytes):
    """For mapInArrow over (_y, _text): the label and the features of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(bad, good)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sizes.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int | None = None) -> QualityModel | None:
    """Fit on labelled documents that aren't held out: at most 2 * sample_rows a class that have text, least hash of the
    key first. This is the only bound; an id counts once, whatever its rows (of several texts, the least is taken).

    Every second one of a class builds its dictionary, on the driver, from whole texts, or where sample_bytes is set from
    so many bytes from all through them. The others calibrate: tasks compress whole texts, and the driver gets a row of
    numbers of each. None where a class has no text.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter(~held_out(F.col("_id")) & F.col("_id").isNotNull())
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.col(key).cast("long").alias("_id"), body.alias("_text")).filter(F.octet_length("_text") > 0)
    there = stage(rows.filter("_y in (0, 1)").distinct().join(texts.select("_id"), "_id", "left_semi"), "labelled")
    picked = {y: [r["_id"] for r in there.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(2 * sample_rows).collect()] for y in (0, 1)}
    counts = {r["_y"]: r["n"] for r in there.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    drop(there)
    if not picked[0] or not picked[1]:
        return None

    def of(parts: dict[int, list[int]]) -> DataFrame:
        """(_id, _y, _text) of the picked ids; rows of one id are one before they are shuffled."""
        ids = spark.createDataFrame([(i, y) for y in (0, 1) for i in parts[y]], "_id long, _y int")
        return texts.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    whole = F.col("_text") if sample_bytes is None else sampled(F.col("_text"), sample_bytes)
    own = {(r["_y"], r["_id"]): bytes(r["_text"]) for r in of({y: picked[y][::2] for y in (0, 1)}).select("_id", "_y", whole.alias("_text")).collect()}
    bad, good = (build_dictionary([own[y, i] for i in picked[y][::2]]) for y in (0, 1))
    seen = of({y: picked[y][1::2] or picked[y] for y in (0, 1)}).select("_y", "_text").mapInArrow(tidy(_featured(bad, good)), "y int, x array<double>").collect()
    seen = sorted((r["y"], r["x"]) for r in seen)  # sums don't depend on the order of tasks
    mean, scale, w = calibrate(np.array([x for _, x in seen]), np.array([y for y, _ in seen], float), counts[1] / (counts[0] + counts[1]))
    return QualityModel(bad, good, mean.tolist(), scale.tolist(), w.tolist())


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a last column: the calibrated chance that a text is good, from the whole text alone.

    Null texts score as empty ones; without a model every score is 0.5. Nothing is shuffled.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    at = docs.columns.index(text)
    fields = docs.withColumn(name, F.lit(0.5)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for batch in batches:
            scores = rate([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=fields.names)

    return docs.mapInArrow(tidy(run), fields)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null texts score as empty ones, and rows without doc_id are hashed as an empty id; repeated rows score alike; a score
    of exactly 0.5 is predicted 1. Where the labels know no text of a class every score is 0.5. An empty table gives an
    empty one; other columns are not read.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, whose text scores 0.5 or more."""
    packed = docs.select(F.struct("*").alias("_row"), "text")
    return score(packed, fit(docs, labels)).filter(F.col("score") >= 0.5).select("_row.*")
