"""Drawing documents that resemble a target collection, by hashed-feature importance and the Gumbel trick.

Texts are split by an untrained pre-tokeniser into words with offsets; runs of consecutive words are features, and each
falls into a CRC bucket. Two histograms of buckets, of the documents and of the target, give every bucket a gain; the mean gain
of a document's features is its weight. A fixed noise per document turns the largest scores into a draw.

Words are cut once and stored as bucket numbers, two bytes each. Only the histograms (one number per bucket) reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanferry.operators.ordering import positions
from spanferry.shared import scratch_path, settle

BUCKETS = 10_000
RUN_WORDS = 1  # features are runs of 1 to so many words
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = "2024"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_CHARS = 1 << 18  # characters split at once; cut between words, so slices never show
CACHED_FEATURES, CACHED_CHARS = 100_000, 40  # features whose bucket a task remembers, and the longest of them


def _slices(text: str) -> Iterator[str]:
    """``text`` in slices that end between words."""
    at, between = 0, re.compile(BETWEEN_WORDS[:-1])
    while len(text) - at > SLICE_CHARS:
        found = between.search(text, at + SLICE_CHARS)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class Features:
    """Buckets of all runs of words of a text, in the order of the words; one instance serves one task."""

    def __init__(self, buckets: int, run_words: int) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(BETWEEN_WORDS), "removed").pre_tokenize_str
        self.buckets, self.run_words = buckets, run_words
        self.known: dict[str, int] = {}

    def _bucket(self, feature: str) -> int:
        bucket = self.known.get(feature)
        if bucket is None:
            bucket = crc32(feature.encode()) % self.buckets
            if len(feature) <= CACHED_CHARS:
                if len(self.known) >= CACHED_FEATURES:
                    self.known.clear()
                self.known[feature] = bucket
        return bucket

    def of(self, raw: bytes) -> tuple[int, list[int]]:
        """Number of words and the bucket of each feature. Only A-Z are lower-cased."""
        words, out, before = 0, [], []
        for part in _slices(raw.lower().decode("utf-8", "replace")):
            spans = [span for _, span in self.split(part)]
            found = [part[a:b] for a, b in spans]
            words += len(found)
            out += [self._bucket(w) for w in found]
            if self.run_words > 1:
                joined = before + found
                for n in range(2, self.run_words + 1):
                    first = max(len(before) - n + 1, 0)  # runs that end in this slice
                    out += [self._bucket(" ".join(joined[i : i + n])) for i in range(first, len(joined) - n + 1)]
                before = joined[-(self.run_words - 1) :]
        return words, out


def _number(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def features(docs: DataFrame, doc_id: str, text: str, buckets: int, run_words: int) -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)`` of each row; ``buckets`` packs the bucket numbers."""
    number = _number(buckets)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Features(buckets, run_words)
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                found = [cutter.of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.large_binary())]
                packed = [np.array(f, number).tobytes() for _, f in found]
                sizes = [pa.array([w for w, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(packed, pa.binary())], [doc_id, "n_words", "n_features", "buckets"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(split, f"`{doc_id}` {kind}, n_words long, n_features long, buckets binary")


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: one addition per task, ``buckets`` numbers in all."""
    number = _number(buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), number), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, 1000 times the logarithm of how much likelier the target is to use it, rounded down."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def _weights(found: DataFrame, doc_id: str, gain: np.ndarray) -> DataFrame:
    number = _number(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = (np.frombuffer(p.as_buffer(), number) for p in batch.column(3))
            weight = [int(gain[p].sum()) // len(p) if len(p) else 0 for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], [doc_id, "n_words", "n_features", "weight"])

    kind = found.schema[doc_id].dataType.simpleString()
    return found.mapInArrow(weigh, f"`{doc_id}` {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Fixed Gumbel noise of a document, times 1000 and rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    place = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(place))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", *, target_text: str = "text", buckets: int = BUCKETS,
    run_words: int = RUN_WORDS, least_words: int = LEAST_WORDS, drawn_percent: int = DRAWN_PERCENT, seed: str = SEED,
) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, n_words, n_features, weight, score, rank)``; ``rank`` is null where it is not drawn.

    Of the rows with ``least_words`` words, ``drawn_percent`` of 100 (rounded down) are drawn: the largest scores, ties to the
    smaller id, then to fewer features.

    A null text has no words and the weight 0. Ids may be null (noise of an empty id, before all others in a tie) or repeat: each
    row is drawn by itself. Texts are read whole, in slices. Other columns are ignored whatever their names. An empty table
    gives an empty one; with an empty target every gain still has its value.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "features")
    docs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    features(docs, "_id", "_text", buckets, run_words).write.parquet(path)
    found = spark.read.parquet(path)
    aims = features(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_text")), "_id", "_text", buckets, run_words)
    gain = gains(histogram(found, buckets), histogram(aims, buckets))
    scored = settle(_weights(found, "_id", gain).withColumn("score", F.col("weight") + noise(F.col("_id"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * drawn_percent // 100
    placed = positions(able.withColumn("_down", -F.col("score")), ["_down", "_id", "n_features", "weight"], name="_place")
    ranked = placed.withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("_id").alias(doc_id), "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
