"""Similarity join of documents by the Jaccard similarity of their five-word shingles.

Candidates come from bands of MinHash values. Each candidate pair is then compared on further MinHash
values, a few at a time; after each step it is dropped if the posterior probability (uniform prior) that
its similarity reaches the threshold is below ``TOLERANCE``. Pairs that pass all steps are verified exactly
on their shingles. So a link can be missed only by the bands (probability 1e-5 at a similarity of 0.8, less
above) or by the tolerance, and no false link is given.

Documents with one set of shingles are one node. Buckets of a band with the same nodes as an earlier one
are dropped. A bucket is cut into blocks of bounded size, and every pair of blocks is one unit of work: no
task holds a whole bucket, and pairs are compared as arrays and never become rows. Each unit gives for each
of its nodes how many documents it is linked to and the smallest node it is connected with; a pair counts
in the first band its nodes share only. Texts are shuffled once, shingles only of nodes that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .batches import runs
from .text import SHINGLE, plain

THRESHOLD = 0.8
BANDS, BAND_ROWS = 16, 3
STEPS, STEP = 6, 16
TOLERANCE = 1e-6
#: A block holds about so many nodes, and shingles, at most.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000
#: Rows and columns of the matrices that are compared at once.
TILE, COLUMNS = 256, 4096

_draw = np.random.Generator(np.random.PCG64(5))
FACTORS = _draw.integers(0, 1 << 63, BANDS * BAND_ROWS + STEPS * STEP, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 1 << 63, len(FACTORS), np.uint64)
WORD_FACTORS = _draw.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTORS = _draw.integers(0, 1 << 63, BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of all words if they are fewer than five."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed(total + hashes[k : k + n] * WORD_FACTORS[k])
    return np.unique(total)


def min_hashes(found: np.ndarray, first: int, last: int) -> np.ndarray:
    """MinHash values ``first`` to ``last`` of a set of shingles, 32 bits each."""
    least = np.full(last - first, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 1024):
        part = found[start : start + 1024]
        least = np.minimum(least, (part[None, :] * FACTORS[first:last, None] + TERMS[first:last, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One number for each band from its MinHash values, for one document or many."""
    grouped = mins[..., : BANDS * BAND_ROWS].reshape(*mins.shape[:-1], BANDS, BAND_ROWS).astype(np.uint64)
    return mixed((mixed(grouped + np.uint64(1)) * BAND_FACTORS).sum(axis=-1, dtype=np.uint64))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step the matches a pair needs so far, lest its posterior falls below the tolerance.

    With m of n values equal and a uniform prior, the similarity is at least t with the probability that
    n + 1 trials of chance t succeed m times at most.
    """

    def posterior(m: int, n: int) -> float:
        return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return [next(m for m in range(n + 1) if posterior(m, n) >= tolerance) for n in range(STEP, STEPS * STEP + 1, STEP)]


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in runs(batches):
        keys, sizes, bands = [], [], []
        for text in part.column(1).to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            bands.append(band_keys(min_hashes(found, 0, BANDS * BAND_ROWS)).view(np.int64).tolist() if len(found) else [])
        made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "node_key", "size", "bands"])


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in runs(batches):
        found = [shingles(t) for t in part.column(1).to_pylist()]
        mins = [min_hashes(s, 0, len(FACTORS)).tobytes() for s in found]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mins, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "mins", "shingles"])


class Unit:
    """The nodes of a block, or of two blocks whose nodes are compared across."""

    def __init__(self, band: int, across: bool, rows: list[tuple], threshold: float, needed: list[int]):
        self.band, self.threshold, self.needed = band, threshold, needed
        self.nodes = np.array([r[0] for r in rows])
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.side = np.array([r[2] for r in rows]) if across else None
        self.mins = np.stack([np.frombuffer(r[3], np.uint32) for r in rows])
        self.keys = band_keys(self.mins)
        self.sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        self.root = np.arange(len(rows))
        self.links = np.zeros(len(rows), np.int64)

    def top(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose first common band is this one, after pruning step by step."""
        seen = (self.keys[left, None, : self.band] == self.keys[None, right, : self.band]).any(axis=2) if self.band else np.zeros((len(left), len(right)), bool)
        a, b = (~seen).nonzero()
        a, b = left[a], right[b]
        if self.side is None:
            ahead = a < b
            a, b = a[ahead], b[ahead]
        matches = np.zeros(len(a), np.int64)
        for k, least in enumerate(self.needed):
            at = slice(BANDS * BAND_ROWS + k * STEP, BANDS * BAND_ROWS + (k + 1) * STEP)
            matches = matches + (self.mins[a, at] == self.mins[b, at]).sum(axis=1)
            stay = matches >= least
            a, b, matches = a[stay], b[stay], matches[stay]
        return a, b

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the shingles of each pair are as similar as asked for; sizes of intersections are matrix products."""
        rows, row_at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = [self.sets[r] for r in rows]
        sizes = np.array([len(s) for s in sets])
        of = np.repeat(np.arange(len(rows)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        number = np.cumsum(times > 1) - 1
        of, column = of[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        both = np.zeros((len(rows), len(rows)), np.float32)
        n_columns = int(column[-1]) + 1 if len(column) else 0
        for start in range(0, n_columns, COLUMNS):
            low, high = np.searchsorted(column, [start, start + COLUMNS])
            has = np.zeros((len(rows), min(COLUMNS, n_columns - start)), np.float32)
            has[of[low:high], column[low:high] - start] = 1
            both += has @ has.T
        i, j = row_at[: len(a)], row_at[len(a) :]
        inter = both[i, j].astype(np.int64)
        return inter >= self.threshold * (sizes[i] + sizes[j] - inter) - 1e-9

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.candidates(left, right)
        if not len(a):
            return
        good = self.verified(a, b)
        a, b = a[good], b[good]
        np.add.at(self.links, a, self.copies[b])
        np.add.at(self.links, b, self.copies[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def run(self) -> Iterator[tuple]:
        """``node, root, links`` of nodes with links."""
        order = np.argsort(self.nodes, kind="stable")  # so that the first of a component is its smallest node
        for name in ("nodes", "copies", "side", "mins", "keys"):
            if getattr(self, name) is not None:
                setattr(self, name, getattr(self, name)[order])
        self.sets = [self.sets[k] for k in order]
        every = np.arange(len(self.nodes))
        one, two = (every, every) if self.side is None else (every[self.side == 0], every[self.side == 1])
        for i in range(0, len(one), TILE):
            for j in range(i if self.side is None else 0, len(two), TILE):
                self.compare(one[i : i + TILE], two[j : j + TILE])
        for k in self.links.nonzero()[0].tolist():
            yield self.nodes[k].item(), self.nodes[self.top(k)].item(), int(self.links[k])


def _units(batches: Iterable[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    needed = least_matches(threshold, tolerance)
    unit, rows, kind = None, [], None

    def done(rows: list[tuple], unit: tuple) -> pa.RecordBatch:
        found = list(Unit(unit[0], unit[2] != unit[3], rows, threshold, needed).run()) if len(rows) > 1 else []
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=["node", "root", "links"])

    for part in runs(batches):
        kind = part.schema.field("node").type
        columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("band", "key", "low", "high", "node", "copies", "side", "mins", "shingles")]
        for band, key, low, high, *row in zip(*columns, strict=True):
            if (band, key, low, high) != unit:
                if rows:
                    yield done(rows, unit)
                unit, rows = (band, key, low, high), []
            rows.append(tuple(row))
    if rows:
        yield done(rows, unit)


def connected(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component of each node that has an edge ``node, root``.

    Every round first ties the larger neighbours of a node to the smallest of its neighbourhood, then the
    smaller ones, until nothing changes. Edges are no more than before; each round is written to the
    checkpoint folder.
    """
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
    edges = edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct()
    edges = materialise(edges)
    before, now = None, state(edges)
    while now != before:
        both = edges.union(edges.select("root", "node").toDF("node", "root"))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.explode(F.array(F.struct("node", "m"), F.struct(F.col("root").alias("node"), "m"))).alias("e"))
        edges = materialise(small.select("e.node", F.col("e.m").alias("root")).where("node <> root").distinct())
        before, now = now, state(edges)
    return edges


def members(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, node_key, size, bands``, once for each id that isn't null."""
    d = plain(docs, doc_id=doc_id, text=text).where("doc_id is not null")
    kind = d.schema["doc_id"].dataType.simpleString()
    sketched = d.mapInArrow(_sketch, f"doc_id {kind}, node_key binary, size long, bands array<long>")
    return sketched.groupBy("doc_id").agg(F.min(F.struct("node_key", "size", "bands")).alias("m")).select("doc_id", "m.*")


def linked(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, threshold: float, tolerance: float) -> DataFrame:
    """``node, root, links`` of nodes ``node, copies, size, bands``: one row for each unit of work in which a node has links."""
    banded = nodes.select("node", "copies", "size", F.posexplode("bands").alias("band", "key"))
    # Two sums of hashes stand for the nodes of a bucket.
    buckets = banded.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node").cast("long")).alias("y")
    )
    buckets = buckets.where("n > 1").groupBy("n", "total", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*", "n", "total")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = banded.drop("size").join(buckets.select("band", "key", blocks.alias("blocks")), ["band", "key"])
    placed = materialise(placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")))
    d = plain(docs, node=doc_id, text=text).join(placed.select("node").distinct(), "node", "left_semi")
    kind = d.schema["node"].dataType.simpleString()
    sets = d.mapInArrow(_expand, f"node {kind}, mins binary, shingles binary")
    grid = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = grid.select(
        "node", "copies", "band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side")
    )
    unit = ["band", "key", "low", "high"]
    work = grid.join(sets, "node").repartition(*unit).sortWithinPartitions(*unit)
    return work.mapInArrow(partial(_units, threshold=threshold, tolerance=tolerance), f"node {kind}, root {kind}, links long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links``.

    ``class_id`` is the smallest id of those connected by links, ``n_links`` the number of other documents
    linked directly, copies included. A text that is null or without words has no links. Rows with a null id are
    left out; repeated rows of one id are one document, of different texts with one id one is chosen by
    its hash. An empty table gives an empty result; other columns aren't read.
    """
    every = materialise(members(docs, doc_id, text))
    nodes = every.where("node_key is not null").groupBy("node_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialise(nodes)
    found = materialise(linked(docs, nodes.drop("node_key"), doc_id, text, threshold, tolerance))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.select("node", "root"))
    known = nodes.select("node_key", "node", "copies").join(links, "node", "left").join(roots, "node", "left")
    known = known.select("node_key", F.coalesce("root", "node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = every.select("doc_id", "node_key").join(known, "node_key", "left")
    return out.select(F.col("doc_id").alias(doc_id), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of their class, with all their columns; rows with a null id stay."""
    chosen = join(docs, doc_id, text).where(F.col(doc_id) == F.col("class_id")).select(F.col(doc_id).alias("_id"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(f"`{doc_id}`").alias("_id"), F.md5(F.col(f"`{text}`").cast("binary")).alias("_digest"))
    kept = rows.join(chosen, "_id", "left_semi")
    repeat = F.lag("_id").over(Window.partitionBy("_id").orderBy("_digest"))
    kept = kept.withColumn("_before", repeat).where("_before is null")
    out = kept.select("row").union(rows.where("_id is null").select("row"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
