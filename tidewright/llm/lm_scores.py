"""Cross-entropy difference: a target and a background bigram model over one vocabulary score every document.

Both models have the same form. The vocabulary is all words seen at least ``LEAST`` times in the corpus; the
rest are one unknown word. Pairs of words (and the start of a document before its first word) seen at least
``LEAST`` times are kept; their words are then known, too. The rule is the same at every size, so the models
grow with the corpus: they are tables, and no task and no driver holds one. A probability mixes the share of
the pair among those that follow its first word with the smoothed share of the word.

Documents are dealt to blocks of about ``BLOCK_BYTES`` of text by a hash of their id. A block counts its
words and pairs (so a frequent pair is one row per block, not per occurrence), the counts of all blocks are
added up, and those of the words and pairs that a block holds go back to it. A task reads the counts of one
block, then its documents one after the other. Words and pairs are known by hashes of ``KEY_BITS`` bits, and
travel as packed arrays of the hashes with the same first bits (a range); they are rows only while added up.

The score is the loss per word of the target model minus that of the background model: low for text that is
like the target. Documents are rated with models that counted them, target documents, too; leave a document
out of ``target`` to rate it as an outsider.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .batches import sized_runs
from .jaccard_join import mixed
from .text import plain

LEAST = 2
#: The part of the pair's share in a probability.
MIX = 0.7
BLOCK_BYTES = 4 << 20
#: Words a task holds before it hands their counts on, as those of a block with a very long text or many repeated rows.
MAX_TOKENS = 1_000_000
#: Some 3 of 10^6 of 3 x 10^10 different words and pairs share a key with another one.
KEY_BITS, RANGE_BITS = 54, 10
#: Keys of words are odd, those of pairs even; these two are the start of a document and the sum over all words.
START, TOTAL = 1, 3
CODEC = pa.Codec("zstd", 1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_keys(text: str | None) -> np.ndarray:
    found = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) >> np.uint64(64 - KEY_BITS) | np.uint64(1)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(before * FACTOR + words) >> np.uint64(64 - KEY_BITS) & ~np.uint64(1)


def befores(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The key before each word; ``starts`` are the places of the first words of texts."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[starts] = START
    return out


def block_of(doc_id: Column, text: Column, blocks: int) -> Column:
    """Rows without an id can't be target documents and are dealt by their text."""
    return F.pmod(F.coalesce(F.xxhash64(doc_id.cast("string")), F.lit(0)) + F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0)), F.lit(blocks))


def segments(part: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with one number in the first column."""
    place = part.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(place[a]), part.slice(a, b - a)


def packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, and columns of small numbers, byte by byte: most bytes are zeros, which shrink to nothing."""
    table = np.stack([np.diff(keys, prepend=0), *columns]).astype(np.int64)
    return CODEC.compress(table.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def unpacked(data: bytes, length: int, columns: int) -> list[np.ndarray]:
    plain_bytes = CODEC.decompress(data, 8 * length * columns, asbytes=True)
    table = np.frombuffer(plain_bytes, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(columns, length)
    return [np.cumsum(table[0]), *table[1:]]


def _counts(batches: Iterable[pa.RecordBatch], max_tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows ``place, id, text``, ids of target documents (even places) before the documents of a block (odd)."""
    block, targets, tokens = -1, set(), 0
    held: tuple[list, list] = ([], [])

    def out() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held[0]), return_counts=True)
        n_target = np.zeros_like(n)
        if held[1]:
            own, count = np.unique(np.concatenate(held[1]), return_counts=True)
            n_target[np.searchsorted(keys, own)] = count
        words = [sum(int(np.count_nonzero(x & np.uint64(1))) - int(np.count_nonzero(x == START)) for x in h) for h in held]
        keys, n, n_target = np.insert(keys, 0, TOTAL), np.insert(n, 0, words[0]), np.insert(n_target, 0, words[1])
        keys = keys.view(np.int64)
        ranges, first = np.unique(keys >> (KEY_BITS - RANGE_BITS), return_index=True)
        cuts = [slice(i, j) for i, j in zip(first, np.append(first[1:], len(keys)), strict=True)]
        data = [packed(keys[c], n[c], n_target[c]) for c in cuts]
        columns = [ranges, np.full(len(ranges), block), [c.stop - c.start for c in cuts]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(data, pa.binary())], names=["range", "block", "length", "data"])

    for part in sized_runs(batches, 2, 1 << 20):
        for place, rows in segments(part):
            if place >> 1 != block:
                if held[0]:
                    yield out()
                block, targets, tokens, held = place >> 1, set(), 0, ([], [])
            if place % 2 == 0:
                targets.update(rows.column(1).to_pylist())
                continue
            for doc_id, text in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                words = word_keys(text)
                if not len(words):
                    continue
                found = np.concatenate([words, pair_keys(befores(words, np.zeros(1, np.int64)), words), np.array([START], np.uint64)])
                held[0].append(found)
                if doc_id in targets:
                    held[1].append(found)
                tokens += len(words)
                if tokens > max_tokens:
                    yield out()
                    tokens, held = 0, ([], [])
    if held[0]:
        yield out()


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, block, length, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            same = [pa.array(np.full(length, x), pa.int64()) for x in (number, block)]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, pa.int64()) for c in unpacked(data, length, 3))], names=["range", "block", "key", "n", "n_target"])


SUMS = ("words", "target_words", "known", "known_target", "vocabulary")


def summed(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``block, key, n, n_target``, sorted by key, with the counts of the whole corpus; and the sums over their keys."""
    start = np.flatnonzero(np.diff(rows[1], prepend=-1))
    of_key = np.repeat(np.arange(len(start)), np.diff(np.append(start, rows.shape[1])))
    key = rows[1, start]
    n, n_target = (np.add.reduceat(rows[c], start) for c in (2, 3))
    total = key == TOTAL
    special = total | (key == START)
    word = (key & 1 == 1) & ~special & (n >= least)
    sums = [n[total].sum(), n_target[total].sum(), n[word].sum(), n_target[word].sum(), np.count_nonzero(word)]
    kept = (special | (n >= least))[of_key]
    return np.stack([rows[0], rows[1], n[of_key], n_target[of_key]])[:, kept], np.array(sums)


def _summed(batches: Iterable[pa.RecordBatch], least: int, most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Rows ``range, block, key, n, n_target`` sorted by key; what is left of them, packed by block, with sums over keys."""
    waiting: list[np.ndarray] = []
    held: list[np.ndarray] = []
    sums = np.zeros(len(SUMS), np.int64)

    def out() -> pa.RecordBatch:
        block, key, n, n_target = np.concatenate(held, axis=1)
        order = np.argsort(block, kind="stable")
        blocks, start = np.unique(block[order], return_index=True)
        parts = [order[i:j] for i, j in zip(start, np.append(start[1:], len(order)), strict=True)]
        data = [packed(key[x], n[x], n_target[x]) for x in parts]
        # The sums of all rows are in the first one.
        once = [pa.array([int(x)] + [0] * (len(blocks) - 1), pa.int64()) for x in sums]
        lengths = pa.array([len(x) for x in parts], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(blocks), lengths, pa.array(data, pa.binary()), *once], names=["block", "length", "data", *SUMS])

    def finish(rows: np.ndarray) -> None:
        kept, more = summed(rows, least)
        held.append(kept)
        sums[:] += more

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns[1:]])
        # Rows of the last key wait for the next batch.
        last = int(np.searchsorted(rows[1], rows[1, -1]))
        if last or (waiting and waiting[-1][1, -1] != rows[1, 0]):
            done = rows[:, :last]
            finish(np.concatenate([*waiting, done], axis=1))
            waiting = []
        waiting.append(rows[:, last:])
        if sum(x.shape[1] for x in held) > most:
            yield out()
            held.clear()
            sums[:] = 0
    if waiting:
        finish(np.concatenate(waiting, axis=1))
    if sum(x.shape[1] for x in held):
        yield out()


def counts(docs: DataFrame, target: DataFrame, blocks: int, least: int, max_tokens: int) -> DataFrame:
    """``block, length, data``: the corpus counts of the keys of each block, packed; and parts of the sums over the corpus."""
    ids = target.select(F.col("doc_id").cast("string").alias("id")).where("id is not null").distinct()
    ids = ids.select((2 * block_of(F.col("id"), F.lit(""), blocks)).alias("place"), "id", F.lit(None).cast("string").alias("text"))
    rows = docs.select((2 * block_of(F.col("doc_id"), F.col("text"), blocks) + 1).alias("place"), F.col("doc_id").cast("string").alias("id"), "text")
    rows = ids.unionByName(rows).repartition(F.floor(F.col("place") / 2)).sortWithinPartitions("place")
    dealt = rows.mapInArrow(partial(_counts, max_tokens=max_tokens), "range long, block long, length long, data binary").repartition("range")
    rows = dealt.mapInArrow(_unpacked, "range long, block long, key long, n long, n_target long").sortWithinPartitions("key")
    return rows.mapInArrow(partial(_summed, least=least), "block long, length long, data binary, " + ", ".join(f"{c} long" for c in SUMS))


@dataclass(frozen=True)
class Totals:
    """Sums over the corpus, background and target: all words, words outside the vocabulary; and the size of the vocabulary."""

    words: tuple[int, int]
    unknown: tuple[int, int]
    size: int


def totals(counted: DataFrame) -> Totals:
    nb, nt, kb, kt, size = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in SUMS)).first()
    return Totals((nb, nt), (nb - kb, nt - kt), size + 1)


class Lookup:
    """The counts of the keys of one block, background (column 0) and target (column 1)."""

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray]):
        every = np.concatenate([*keys, np.empty(0, np.uint64)])
        order = np.argsort(every)
        self.keys = every[order]
        self.counts = np.concatenate([*counts, np.empty((0, 2), np.int64)])[order]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key has counts, and the counts (zeros if not)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros((len(keys), 2))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return hit, self.counts[at] * hit[:, None]


def losses(words: np.ndarray, starts: np.ndarray, of: Lookup, sums: Totals) -> np.ndarray:
    """The loss of each word in the background and the target model."""
    known, alone = of(words)
    alone = np.where(known[:, None], alone, sums.unknown)
    alone = (alone + 1) / (np.array(sums.words) + sums.size)
    before = befores(words, starts)
    share = of(pair_keys(before, words))[1] / np.maximum(of(before)[1], 1)
    return -np.log(MIX * share + (1 - MIX) * alone)


def _score(batches: Iterable[pa.RecordBatch], sums: Totals) -> Iterator[pa.RecordBatch]:
    """Rows ``place, doc_id, text, length, data``, the packed counts of a block (even places) before its documents (odd)."""
    block, keys, values, of = -1, [], [], None
    for part in sized_runs(batches, 2, 1 << 20):
        for place, rows in segments(part):
            if place >> 1 != block:
                block, keys, values, of = place >> 1, [], [], None
            if place % 2 == 0:
                for length, data in zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True):
                    key, *n = unpacked(data, length, 3)
                    keys.append(key.view(np.uint64))
                    values.append(np.stack(n, axis=1))
                continue
            if of is None:
                of = Lookup(keys, values)
                keys, values = [], []
            texts = [word_keys(t) for t in rows.column(2).to_pylist()]
            n = np.array([len(t) for t in texts])
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            mean = np.full((len(n), 2), np.nan)
            if len(full):
                mean[full] = np.add.reduceat(losses(np.concatenate(texts), starts, of, sums), starts) / n[full, None]
            made = [pa.array(n, pa.int64()), *(pa.array(mean[:, c], pa.float64(), mask=n == 0) for c in (1, 0))]
            yield pa.RecordBatch.from_arrays([rows.column(1), *made], names=["doc_id", "n_words", "target_loss", "background_loss"])


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, block_bytes: int = BLOCK_BYTES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, difference`` of every document.

    Target documents are those whose id is in the column ``doc_id`` of ``target``; null ids never are. A text
    that is null or without words has null losses. Without target documents the target model knows no words,
    all alike. Repeated rows count as often as they occur, and ties have equal scores; an empty table gives an
    empty result; other columns aren't read. The counts are a table below ``spark.checkpoint.dir``.
    """
    d = plain(docs, doc_id=doc_id, text=text)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    folder = f"{ensure_checkpoint_dir(d.sparkSession).rstrip('/')}/word-counts-{uuid.uuid4().hex}"
    counts(d, target, blocks, least, max_tokens).write.parquet(folder)
    counted = d.sparkSession.read.parquet(folder)
    kind = d.schema["doc_id"].dataType.simpleString()
    tables = counted.select((2 * F.col("block")).alias("place"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), "length", "data")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("length", "long"), ("data", "binary"))]
    texts = d.select((2 * block_of(F.col("doc_id"), F.col("text"), blocks) + 1).alias("place"), "doc_id", "text", *none)
    rows = tables.unionByName(texts).repartition(F.floor(F.col("place") / 2)).sortWithinPartitions("place")
    rows = rows.mapInArrow(partial(_score, sums=totals(counted)), f"doc_id {kind}, n_words long, target_loss double, background_loss double")
    return rows.withColumn("difference", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("doc_id", doc_id)
