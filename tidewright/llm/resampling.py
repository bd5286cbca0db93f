"""Quality classifier by importance resampling over hashed n-grams.

Two bag-of-n-grams models are counted over the same hashed features: one of the target (documents labelled
good), one of all raw text. The log ratio of the two, summed over a document, is its importance weight; k
documents are drawn without replacement by adding Gumbel noise and taking the k largest.

Features are words, pairs of words, and triples of word shapes (case, digits, punctuation, repetition), each
in its own table of ``BUCKETS``. The tables are all that leaves the tasks, so their size is fixed. The
number k is the count of documents whose weight is above what nearly all good labelled documents reach; the
k-th largest key is found by counting in ever finer bins, without a sort.

What is toxic often reads well, so that ratio can't tell it. A second one does: for every word, how much
more of the toxic than of the good labelled documents have it. A document's toxicity is that of its most
telling word. Documents above a cut aren't drawn; the cut is taken from labelled documents that the ratios
it is compared with weren't counted on (each half of them is rated by the other half).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import runs
from .text import number, plain

BUCKETS = 1 << 15
FAMILIES = 3
#: Labelled documents that are used at most, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: The cut lies midway between the weight that all but this share of good labelled documents reach and the
#: one that all but ten times this share of bad ones stay below; at the former if the two overlap.
LOST = 0.002
#: Buckets of words, without case and punctuation, that toxic documents are told by.
TOXIC_BUCKETS = 1 << 18
#: The share of good labelled documents that may be above the cut of toxicity.
TOXIC_LOST = 0.01
#: Words whose hash and shape a worker remembers.
MAX_WORDS = 100_000


class Features:
    """Buckets of the n-grams of a text, numbered through all families."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        """Bucket of the bare word in the high bits, hash of the word in the next, its shape in the low ones."""
        text = word.decode()
        bare = text.strip(".,;:!?\"'()[]{}|*#$%&<>-_=+/\\~^@`")
        shape = 0 if not bare else 1 if bare.islower() else 2 if bare.istitle() else 3 if bare.isupper() else 4 if bare.isdigit() else 5
        shape = shape * 4 + (0 if len(bare) == len(text) else 1 if text[-1] in ".,;:?" else 2 if text[-1] == "!" else 3)
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        told = zlib.crc32(bare.lower().encode()) % TOXIC_BUCKETS
        made = self.known[word] = (told << 37 | zlib.crc32(word) << 5 | shape) + 1
        return made

    def codes(self, text: str) -> np.ndarray:
        get, word = self.known.get, self.word
        codes = np.array([get(w) or word(w) for w in text.encode().split()], np.uint64)
        return codes - np.uint64(1)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all families, and those of the bare words."""
        codes = self.codes(text)
        if not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        told = (codes >> np.uint64(37)).astype(np.int64)
        hashes, shapes = codes >> np.uint64(5) & np.uint64(0xFFFFFFFF), codes & np.uint64(31)
        shapes[1:] += np.uint64(32) * (hashes[1:] == hashes[:-1])
        mix = np.uint64(0x9E3779B97F4A7C15)
        pairs = (hashes[:-1] * mix + hashes[1:]) * mix >> np.uint64(40)
        triples = ((shapes[:-2] * np.uint64(64) + shapes[1:-1]) * np.uint64(64) + shapes[2:] + np.uint64(1)) * mix >> np.uint64(40)
        size = np.uint64(BUCKETS)
        return np.concatenate([hashes % size, pairs % size + size, triples % size + size * np.uint64(2)]).astype(np.int64), told


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts = Features(), np.zeros((2, FAMILIES * BUCKETS), np.int64)
    for part in runs(batches):
        for good, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            found = np.bincount(features(text or "")[0], minlength=1)
            counts[0, : len(found)] += found
            if good:
                counts[1, : len(found)] += found
    used = counts[0].nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["bucket", "raw", "target"])


def log_ratios(marked: DataFrame) -> np.ndarray:
    """The log ratio of target and raw model in every bucket, of rows ``good, text``; one count is added to each bucket."""
    counted = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = counted.toArrow()  # at most FAMILIES * BUCKETS rows
    counts = np.ones((2, FAMILIES * BUCKETS))
    at = table.column("bucket").to_numpy()
    counts[0, at] += table.column("raw").to_numpy()
    counts[1, at] += table.column("target").to_numpy()
    shares = counts.reshape(2, FAMILIES, BUCKETS)
    shares = shares / shares.sum(axis=2, keepdims=True)
    return (np.log(shares[1]) - np.log(shares[0])).ravel()


def _presence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts = Features(), np.zeros((4, TOXIC_BUCKETS), np.int64)
    for part in runs(batches):
        for kind, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            counts[kind, np.unique(features(text or "")[1])] += 1
    used = counts.any(axis=0).nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c[used]) for c in counts)], names=["bucket", "n0", "n1", "n2", "n3"])


def toxic_ratios(kinds: DataFrame) -> np.ndarray | None:
    """Log ratios of toxic and good documents with a word of each bucket, of rows ``kind, text``: one row for each half.

    A kind is the half (0, 1) of a good document, or two more for a toxic one. One document is added to each
    bucket. Nothing if a half has no document of a kind.
    """
    sizes = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    if len(sizes) < 4:
        return None
    counted = kinds.mapInArrow(_presence, "bucket long, n0 long, n1 long, n2 long, n3 long").groupBy("bucket").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    table = counted.toArrow()  # at most TOXIC_BUCKETS rows
    counts = np.zeros((4, TOXIC_BUCKETS))
    counts[:, table.column("bucket").to_numpy()] = [table.column(f"n{k}").to_numpy() for k in range(4)]
    shares = [np.log(counts[k] + 1) - np.log(sizes[k] + 2) for k in range(4)]
    return np.stack([shares[2] - shares[0], shares[3] - shares[1]])


def _rate(batches: Iterable[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    features = Features()
    for part in runs(batches):
        rated = []
        for kind, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            told = features(text or "")[1]
            rated.append(float(ratios[1 - kind % 2, told].max()) if len(told) else None)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rated, pa.float64())], names=["kind", "toxicity"])


def toxic_model(labelled: DataFrame) -> tuple[np.ndarray, float] | None:
    """The mean ratios of both halves and the cut, of rows ``doc_id, good, toxic, text``; nothing without labels of both kinds."""
    half = number(F.col("doc_id").cast("string"), "half") % 2
    kinds = labelled.where("good or toxic").select((half + F.when(F.col("toxic"), 2).otherwise(0)).cast("int").alias("kind"), "text")
    ratios = toxic_ratios(kinds)
    if ratios is None:
        return None
    rated = kinds.mapInArrow(partial(_rate, ratios=ratios), "kind int, toxicity double").where("kind < 2")
    cut = rated.agg(F.percentile_approx("toxicity", F.lit(1 - TOXIC_LOST), F.lit(10_000))).first()[0]
    return None if cut is None else (ratios.mean(axis=0), cut)


def _weigh(batches: Iterable[pa.RecordBatch], ratios: np.ndarray, toxic: tuple[np.ndarray, float] | None) -> Iterator[pa.RecordBatch]:
    features = Features()
    for part in runs(batches):
        found = [features(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
        weights = pa.array([float(ratios[f].sum()) if len(told) else None for f, told in found], pa.float64())
        above = pa.array([bool(toxic is not None and len(told) and toxic[0][told].max() > toxic[1]) for _, told in found], pa.bool_())
        made = [pa.array([len(told) for _, told in found], pa.int64()), weights, above]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "n_words", "log_weight", "reads_toxic"])


def weigh(rows: DataFrame, ratios: np.ndarray, toxic: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """The rows with ``n_words, log_weight, reads_toxic`` in place of their last column, a text; no weight without words."""
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_weigh, ratios=ratios, toxic=toxic), f"{keep}, n_words long, log_weight double, reads_toxic boolean")


def judged(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, good, bad, toxic`` of labelled documents: good means of quality and not toxic, bad of no quality.

    Of labels that contradict each other the worst counts; null ones are neither.
    """
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    return labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.min(good).alias("good"), F.max(bad).alias("bad"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )


def labels_of_good(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids of all documents labelled good."""
    return judged(labels, doc_id).where("good").select("doc_id")


def labelled_sample(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The ``MAX_LABELLED`` judged documents with the smallest hash of their id, or all."""
    return judged(labels, doc_id).orderBy(number(F.col("doc_id").cast("string"), "label"), "doc_id").limit(MAX_LABELLED)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise fixed by id and seed."""
    u = (number(F.coalesce(doc_id.cast("string"), F.lit("")), f"{seed}:") + 0.5) / float(16**12)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> int | None:
    """The k-th largest of the whole numbers in column ``key``; nothing if there are fewer.

    Each round counts one interval in bins (a table of ``bins`` rows) and goes on within one bin.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = keys.where(F.col("key").between(low, high))
        counts = {r["b"]: r["n"] for r in inside.groupBy(F.expr(f"(key - {low}L) div {width}L").alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                break
            k -= counts[b]
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return low


@dataclass(frozen=True)
class Model:
    """Log ratios of the target; toxic ratios and their cut, if there are labels for them; the smallest key that is drawn."""

    ratios: np.ndarray
    toxic: tuple[np.ndarray, float] | None
    least: int | None

    def kept(self, seed: int) -> Column:
        drawn = F.lit(True) if self.least is None else key(seed) >= self.least
        return F.col("log_weight").isNotNull() & ~F.col("reads_toxic") & drawn


def classified(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, seed: int) -> Model:
    d = plain(docs, doc_id=doc_id, text=text)
    sample = F.broadcast(labelled_sample(labels))  # at most MAX_LABELLED rows
    marked = d.join(sample, "doc_id", "left")
    ratios = log_ratios(marked.select(F.coalesce("good", F.lit(False)).alias("good"), "text"))
    toxic = toxic_model(d.join(sample, "doc_id"))
    weighed = materialise(weigh(d, ratios, toxic))
    quantile = lambda flag, share: F.percentile_approx(F.when(F.col(flag), F.col("log_weight")), F.lit(share), F.lit(10_000))
    low, high = weighed.join(sample, "doc_id").agg(quantile("good", LOST), quantile("bad", 1 - 10 * LOST)).first()
    if low is None:  # nothing to learn from: all weights are worth the same
        return Model(ratios, toxic, None)
    cut = low if high is None or high > low else (low + high) / 2
    fit = weighed.where("log_weight is not null and not reads_toxic")
    k = fit.where(F.col("log_weight") >= cut).count()
    return Model(ratios, toxic, kth_largest(fit.select(key(seed).alias("key")), k))


def key(seed: int) -> Column:
    """Log weight and noise in whole millionths."""
    return F.round((F.col("log_weight") + gumbel(F.col("doc_id"), seed)) * 1e6).cast("long")


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``doc_id, n_words, log_weight, key, kept`` of every document.

    A text that is null or without words has no weight and isn't kept. Equal keys stand or fall together, so
    repeated rows do. What reads toxic isn't kept. Without usable labels every document with words is kept. An empty table gives an empty
    result; columns other than id and text aren't read.
    """
    model = classified(docs, labels, doc_id, text, seed)
    rows = weigh(plain(docs, doc_id=doc_id, text=text), model.ratios, model.toxic).withColumn("key", key(seed))
    return rows.withColumn("kept", model.kept(seed)).drop("reads_toxic").withColumnRenamed("doc_id", doc_id)


def select(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """The rows that ``resample`` keeps, with all their columns."""
    model = classified(docs, labels, doc_id, text, seed)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = weigh(docs.select(row, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), model.ratios, model.toxic)
    kept = rows.where(model.kept(seed))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
