"""Phrase collocations: counts of word sequences in HAT-tries, and the phrases whose words belong together.

Phrases are counted one length after the other, each in one pass over the texts. A task numbers its words and
counts phrases of word numbers in a HAT-trie: hash containers, small enough for a processor's cache, below a
trie with at most one level for each word. A container that has grown too large bursts into a trie node over
containers by its next word. Once the trie holds too many phrases, its largest subtrees leave the task as runs
sorted by phrase. Spark's shuffle brings the runs to the partition of their prefix (the first word; a slice
of the rest as well, so a first word that very many phrases have is many partitions), where equal phrases are
added up.

A phrase can't be more frequent than its parts, so a longer one is counted only if its parts may be frequent
enough. What a task knows of that is a bitmap of fixed size with a bit for the hash of every frequent part: a
bit too many costs work and never changes a result, at any number of parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .batches import sized_runs
from .text import plain, text_of

MIN_COUNT = 10
MIN_PERCENT = 50
TOP = 2000
LONGEST = 3
#: Characters at which a text is cut into pieces; all become the first of them.
BREAKS = b".,;:!?\n\x0b\x0c\r"
TO_LOWER = bytes.maketrans(bytes(range(65, 91)) + BREAKS, bytes(range(97, 123)) + b"." * len(BREAKS))
#: A word's number in a task takes so many bits, so three fit into a signed 64-bit key.
ID_BITS = 21
#: A container of more phrases bursts; a trie node has so many containers, by the low bits of a word's number.
BURST = 16_384
FANOUT = 64
#: Phrases that a task holds before it spills, and words before it starts its numbers anew, about 0.1 kB each.
MAX_PHRASES = 1_000_000
MAX_WORDS = 500_000
#: Phrases counted between two looks at the size of the trie.
STEP = 1 << 19
#: Bits of the bitmap of frequent parts (8 MiB); a page is what Spark's bitmap functions put into one row.
MARK_BITS = 26
PAGE = 32_768
#: Prefix partitions are told apart by hash; phrases of one prefix go to so many slices.
SLICES = 16
PREFIXES = 1 << 20


def language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def places(hashes: list[np.ndarray]) -> np.ndarray:
    """The bits of phrases, from the hashes of their words in order."""
    mixed = hashes[0].copy()
    for h in hashes[1:]:
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h
        mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(64 - MARK_BITS)


class HatTrie:
    """Counts of phrases given as keys of ``size`` word numbers. An inner node is a list, a container a Counter."""

    def __init__(self, size: int, burst: int = BURST):
        self.size, self.burst = size, burst
        self.root: Counter | list = Counter()
        self.phrases = 0

    def slots(self, keys: np.ndarray, depth: int) -> np.ndarray:
        return keys >> ID_BITS * (self.size - 1 - depth) & (FANOUT - 1)

    def add(self, keys: np.ndarray) -> None:
        self.root = self._add(self.root, keys, 0)

    def _add(self, node: Counter | list, keys: np.ndarray, depth: int) -> Counter | list:
        if isinstance(node, Counter):
            before = len(node)
            node.update(keys.tolist())
            self.phrases += len(node) - before
            return self._burst(node, depth) if len(node) > self.burst and depth < self.size else node
        for slot, part in self._dealt(keys, depth):
            node[slot] = self._add(node[slot], keys[part], depth + 1)
        return node

    def _dealt(self, keys: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        slots = self.slots(keys, depth)
        order = np.argsort(slots, kind="stable")
        ends = np.searchsorted(slots[order], np.arange(FANOUT + 1)).tolist()
        return ((k, order[a:b]) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a)

    def _burst(self, container: Counter, depth: int) -> list:
        keys, counts = arrays(container)
        node: list = [Counter() for _ in range(FANOUT)]
        for slot, part in self._dealt(keys, depth):
            node[slot] = Counter(dict(zip(keys[part].tolist(), counts[part].tolist(), strict=True)))
        return node

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out the largest subtrees until ``keep`` phrases are left at most: their keys and counts."""
        if isinstance(self.root, Counter):
            subtrees = {0: self.root}
            self.root = Counter()
        else:
            subtrees = dict(enumerate(self.root))
        held = {k: [*containers(node)] for k, node in subtrees.items()}
        for k in sorted(held, key=lambda k: -sum(map(len, held[k]))):
            if self.phrases <= keep and isinstance(self.root, list):
                break
            if isinstance(self.root, list):
                self.root[k] = Counter()
            for container in held[k]:
                self.phrases -= len(container)
            if any(held[k]):
                keys, counts = zip(*map(arrays, held[k]), strict=True)
                yield np.concatenate(keys), np.concatenate(counts)


def containers(node: Counter | list) -> Iterator[Counter]:
    if isinstance(node, Counter):
        yield node
    else:
        for below in node:
            yield from containers(below)


def arrays(container: Counter) -> tuple[np.ndarray, np.ndarray]:
    n = len(container)
    return np.fromiter(container.keys(), np.int64, n), np.fromiter(container.values(), np.int64, n)


def word_array(texts: pa.Array) -> pa.DictionaryArray:
    """All words of the texts in order; ``.`` stands where a piece or a text ends."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    joined = pc.binary_join(lists, ".")[0].as_buffer()
    spaced = bytes(joined).translate(TO_LOWER).replace(b".", b" . ")
    ends = pa.py_buffer(np.array([0, len(spaced)], "<i8"))
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, ends, pa.py_buffer(spaced)])
    return pc.ascii_split_whitespace(one).flatten().dictionary_encode()


class Counting:
    """One task's words and trie."""

    def __init__(self, size: int, marks: list[bytes], max_phrases: int, max_words: int, burst: int):
        self.size, self.marks = size, [np.frombuffer(m, np.uint8) for m in marks]
        self.max_phrases, self.max_words, self.burst = max_phrases, max_words, burst
        self.start()

    def start(self) -> None:
        self.trie = HatTrie(self.size, self.burst)
        self.known: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.hashes: list[int] = []
        self.n_known = 0

    def marked(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Whether phrases of as many words may be frequent."""
        at = places(hashes)
        return self.marks[len(hashes) - 1][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0

    def learn(self, lang: str, new: list[bytes]) -> None:
        """Numbers new words; words that can't be frequent, and the end of a piece, have -1."""
        known, seed = self.known[lang], language_seed(lang)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in new), np.uint64, len(new))
        useful = self.marked([hashes]).tolist() if self.size > 1 else [True] * len(new)
        for w, h, u in zip(new, hashes.tolist(), useful, strict=True):
            if u and w != b"." and w:
                known[w] = len(self.words)
                self.words.append(w)
                self.langs.append(lang)
                self.hashes.append(h)
            else:
                known[w] = -1
        self.n_known += len(new)

    def keys(self, lang: str, texts: pa.Array) -> np.ndarray:
        coded = word_array(texts)
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.known.setdefault(lang, {})
        if new := [w for w in words if w not in known]:
            self.learn(lang, new)
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        if self.size == 1:
            return ids[ids >= 0]
        good = (ids[:-1] >= 0) & (ids[1:] >= 0)
        if self.size == 2:
            at = np.flatnonzero(good)
            return ids[at] << ID_BITS | ids[at + 1]
        at = np.flatnonzero(good)
        hashes = np.array(self.hashes, np.uint64)
        good[at] = self.marked([hashes[ids[at]], hashes[ids[at + 1]]])
        at = np.flatnonzero(good[:-1] & good[1:])
        return ids[at] << 2 * ID_BITS | ids[at + 1] << ID_BITS | ids[at + 2]

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as rows sorted by phrase."""
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string())
        rank = np.empty(len(words), np.int64)
        rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
        text = words.cast(pa.string())
        for keys, counts in self.trie.spill(keep):
            ids = [keys >> ID_BITS * (self.size - 1 - k) & (1 << ID_BITS) - 1 for k in range(self.size)]
            order = np.lexsort([rank[i] for i in reversed(ids)])
            parts = [text.take(pa.array(i[order])) for i in ids]
            phrase = pc.binary_join_element_wise(*parts, " ") if self.size > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[0][order])), phrase, pa.array(counts[order])], names=["lang", "phrase", "n"])

    def add(self, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lang in run.column(0).unique().to_pylist():
            keys = self.keys(lang, run.column(1).filter(pc.equal(run.column(0), lang)))
            for k in range(0, len(keys), STEP):
                self.trie.add(keys[k : k + STEP])
                if self.trie.phrases > self.max_phrases:
                    yield from self.runs(self.max_phrases // 2)
            if self.n_known > self.max_words:
                yield from self.runs(0)
                self.start()


def _count(batches: Iterator[pa.RecordBatch], size: int, marks: list, limits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    counting = Counting(size, [m.value for m in marks], *limits)
    for run in sized_runs(batches, 1, 4 << 20):
        yield from counting.add(run)
    yield from counting.runs(0)


def count(texts: DataFrame, size: int, marks: list, limits: tuple[int, int, int] = (MAX_PHRASES, MAX_WORDS, BURST)) -> DataFrame:
    """``lang, phrase, n``: how often phrases of ``size`` words occur whose parts are marked, from rows ``lang, text``."""
    runs = texts.mapInArrow(partial(_count, size=size, marks=marks, limits=limits), "lang string, phrase string, n long")
    prefix = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 1)), F.lit(PREFIXES))
    part = (prefix * SLICES + F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).cast("int")
    return runs.withColumn("part", part).repartition("part").groupBy("part", "lang", "phrase").agg(F.sum("n").alias("n")).drop("part")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(language_seed(lang), phrase.encode().split(b" ")) for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        size = len(words[0][1]) if words else 1
        hashes = [np.fromiter((xxhash.xxh64_intdigest(w[k], seed) for seed, w in words), np.uint64, len(words)) for k in range(size)]
        yield pa.record_batch({"place": pa.array(places(hashes).astype(np.int64) + 1)})


def bitmap(phrases: DataFrame):
    """The bits of all phrases (of one length) as a broadcast bitmap of 2**MARK_BITS bits."""
    spark = phrases.sparkSession
    at = phrases.select("lang", "phrase").mapInArrow(_places, "place long")
    pages = at.groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = bytearray((1 << MARK_BITS) // 8)
    for row in pages.collect():  # 2**MARK_BITS / PAGE rows at most
        start = (row["page"] - 1) * PAGE // 8
        bits[start : start + len(row["bits"])] = row["bits"]
    return spark.sparkContext.broadcast(bytes(bits))


def parts(phrase: Column, n: int, first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of a phrase of ``n`` words."""
    head = F.substring_index(phrase, " ", last)
    return head if first == 1 else F.substring_index(head, " ", first - 1 - last)


def best(rows: DataFrame, top: int, slices: int = 32) -> DataFrame:
    """The first ``top`` rows of each language: of each slice first, so no task sorts all rows of a language."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    within = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    return within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("slice")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, min_percent: int = MIN_PERCENT,
    top: int = TOP, limits: tuple[int, int, int] = (MAX_PHRASES, MAX_WORDS, BURST),
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of 2 to 3 words of each language.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its two parts at the cut with the lowest score
    floor(1000000 a a / (l r)), the first one if two are equal, and ``n`` all words of the language. A phrase
    goes if a longer one that holds it has ``min_percent`` of its count. Equal scores and counts are ranked by
    the bytes of the phrase. A null language is ``und``; null and empty texts have no words. Repeated rows
    count as often as they occur; a language without a frequent phrase, and an empty table, give no row.
    """
    d = plain(docs, lang=lang, text=text).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of("text").alias("text"))
    frequent = F.col("n") >= min_count
    words = materialise(count(d, 1, [], limits))
    marks = [bitmap(words.where(frequent))]
    pairs = materialise(count(d, 2, marks, limits).where(frequent))
    marks.append(bitmap(pairs))
    triples = materialise(count(d, LONGEST, marks, limits).where(frequent))

    phrase = F.col("phrase")
    inner = triples.select("lang", F.explode(F.array(parts(phrase, 3, 1, 2), parts(phrase, 3, 2, 3))).alias("phrase"), "n")
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = pairs.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < min_percent * F.col("n"), F.lit(True))).drop("most")

    def cut(rows: DataFrame, n: int) -> DataFrame:
        ways = [F.struct(F.lit(k).alias("k"), parts(phrase, n, 1, k).alias("left"), parts(phrase, n, k + 1, n).alias("right")) for k in range(1, n)]
        return rows.select("lang", "phrase", F.col("n").alias("a"), F.inline(F.array(*ways)))

    known = words.where(frequent).unionByName(pairs)
    side = lambda own, value: known.select("lang", F.col("phrase").alias(own), F.col("n").alias(value))
    cuts = cut(kept, 2).unionByName(cut(triples, 3)).join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    exact = "CAST(CAST(a AS DECIMAL(38, 0)) * a * 1000000 DIV (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT)"
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.*")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best(scored, top).join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
