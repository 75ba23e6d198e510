"""Text quality from two compressors.

A zstandard dictionary is built from labelled good text and another from labelled bad text. A
text's score is its compressed size under one less that under the other, a byte of text, turned
into a probability by a logistic curve fitted to labelled documents the dictionaries did not see.
The curve has the smaller compressed size a byte as a correction: text that repeats itself shrinks
under either dictionary, and the difference alone calls it neither good nor bad.

Fitting reads the whole texts of at most ``SAMPLE_DOCS`` labelled documents a class, chosen by hash;
scoring reads every whole text once and moves no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, shared_checkpoint, slices, text_or_empty

#: Documented bound of the training sample: documents of each class, half for the dictionary, half for the curve.
SAMPLE_DOCS = 6000
#: Whole texts go to the dictionary builder in pieces of this size, as it learns from many short samples.
CHUNK_BYTES = 1500
DICTIONARY_BYTES, LEVEL = 65536, 3
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bytes added to a length it is divided by, so that very short texts stay near the middle.
SOFT_BYTES = 24
RIDGE = 1e-3


def _chunks(data: bytes) -> list[bytes]:
    """The whole text in pieces."""
    return [data[k : k + CHUNK_BYTES] for k in range(0, len(data), CHUNK_BYTES)]


def build_dictionary(chunks: list[bytes]) -> bytes:
    """A trained dictionary of at most DICTIONARY_BYTES; where none can be trained, content of that size, from all over the text."""
    size = min(DICTIONARY_BYTES, sum(map(len, chunks)) // 4)
    while size >= 512 and len(chunks) >= 8:
        try:
            return zstandard.train_dictionary(size, chunks).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    if len(chunks) * CHUNK_BYTES <= DICTIONARY_BYTES:
        return b"".join(chunks)
    count = DICTIONARY_BYTES // CHUNK_BYTES
    return b"".join(chunks[k * len(chunks) // count] for k in range(count))


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            held = zstandard.ZstdCompressionDict(data) if data else None
            if held is not None:
                held.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
        self.empty = [len(c.compress(b"")) for c in self.pair]

    def features(self, data: bytes) -> tuple[float, float]:
        """(bad size - good size, smaller size) a byte of text; what the frame itself takes is left out."""
        good, bad = (len(c.compress(data)) - e for c, e in zip(self.pair, self.empty))
        n = len(data) + SOFT_BYTES
        return (bad - good) / n, (min(good, bad) + SOFT_BYTES / 2) / n


def design(features: np.ndarray) -> np.ndarray:
    difference, ratio = features[:, 0], features[:, 1]
    return np.stack([np.ones(len(features)), 20 * difference, 5 * ratio, 25 * ratio**2, 5 * np.abs(20 * difference) * ratio], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Newton's method with a small ridge; classes weigh as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + RIDGE * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + RIDGE * np.eye(x.shape[1])
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_fold: int, sample_docs: int) -> DataFrame:
    """(y, part, text) of at most ``sample_docs`` documents a class, outside the held-out fold.

    Ids are chosen by hash and cut at the bound; of an id that several rows have, one row a label
    counts, so neither repeated labels nor repeated documents can exceed it.
    """
    usable = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(fold("id", folds) != held_fold)
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.approx_count_distinct("id").alias("n")).collect()}  # two rows
    picked = usable.where("false")
    for y, n in sorted(sizes.items()):
        # the hash leaves about twice the bound to sort
        few = usable.where(F.col("y") == y).withColumn("deal", F.xxhash64("id", F.lit("sample"))).where(F.pmod("deal", F.lit(1 << 30)) < int(min(1.0, 2 * sample_docs / n) * (1 << 30)))
        picked = picked.union(few.dropDuplicates(["id"]).orderBy("deal", "id").limit(sample_docs).select("id", "y"))
    # at most 2 * sample_docs rows
    chosen = F.broadcast(picked.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(2)).cast("int")))
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).cast("binary").alias("text")).join(chosen, "id")
    return rows.groupBy("id", "y", "part").agg(F.min("text").alias("text")).select("y", "part", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_fold: int, sample_docs: int = SAMPLE_DOCS):
    """(good dictionary, bad dictionary, weights) from the rows outside the held-out fold."""
    sample = shared_checkpoint(_sample(docs, labels, id_col, text_col, label_col, folds, held_fold, sample_docs))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sample.where("part = 0").orderBy("y", F.xxhash64("text"), "text").toLocalIterator():
        texts[r["y"]] += _chunks(bytes(r["text"]))
    good, bad = build_dictionary(texts[1]), build_dictionary(texts[0])

    def measure(batches):
        pair = Compressors(good, bad)
        for batch in batches:
            for own in slices(batch, "text", 500):
                difference, ratio = zip(*(pair.features(t) for t in own.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([own.column("y"), pa.array(difference, pa.float64()), pa.array(ratio, pa.float64())], names=["y", "difference", "ratio"])

    held = sample.where("part = 1").select("y", "text").mapInArrow(measure, "y int, difference double, ratio double").toPandas()
    if held.empty:
        return good, bad, np.zeros(5)
    held = held.sort_values(["y", "difference", "ratio"])
    return good, bad, fit_logistic(design(held[["difference", "ratio"]].to_numpy()), held["y"].to_numpy(float))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, held_fold: int = HELD_OUT, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Learns from at most ``sample_docs`` labelled rows a class, whose crc32(id as text) mod ``folds`` is not
    ``held_fold``; an id that is labelled or stands in the table twice counts once a label. Null text is empty and gets the
    score of no evidence. A text of any length is compressed whole; rows that repeat each other are
    scored each. Without any labels every score is 0.5. An empty table gives an empty result; extra
    columns of either table are ignored.
    """
    good, bad, weights = train(docs, labels, id_col, text_col, label_col, folds, held_fold, sample_docs)

    def score(batches):
        pair = Compressors(good, bad)
        for own in (part for batch in batches for part in slices(batch, "text", 500)):
            found = np.array([pair.features(t) for t in own.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(design(found) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("id"), (fold(id_col, folds) == held_fold).alias("held_out"), text_or_empty(docs[text_col]).cast("binary").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(score, kind).withColumnRenamed("id", id_col)
