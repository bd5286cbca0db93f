"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, fixed by its code point. A trigram is bound from its
letters: the product of the first one's vector rotated twice, the second one's rotated once and the third
one's. A text is the sum (bundle) of its trigrams, a language the sum of its documents; the prediction is
the language with the largest cosine. Texts are lower-cased, what isn't a letter is one space between words.

Every task bundles its documents by language and passes on one vector for each language; they are summed
by Spark. What reaches the driver is one vector per language, whatever the number of documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import runs
from .text import plain

DIMENSION = 1024
#: Trigram vectors a worker remembers, 4 kB each.
MAX_TRIGRAMS = 20_000
SPACE = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text, three code points in one number; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    is_letter = letters()[codes]
    if not is_letter.any():
        return codes[:0]
    codes[~is_letter] = SPACE
    word = np.concatenate([[SPACE], codes, [SPACE]])
    word = word[np.concatenate([[True], (word[1:] != SPACE) | (word[:-1] != SPACE)])]
    return word[:-2] << 42 | word[1:-1] << 21 | word[2:]


class Space:
    """Vectors of letters and trigrams."""

    def __init__(self, dimension: int, seed: int):
        self.dimension, self.seed = dimension, seed
        self.of_letter: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((0, self.dimension), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.of_letter:
            draw = np.random.Generator(np.random.PCG64([self.seed, code]))
            self.of_letter[code] = draw.integers(0, 2, self.dimension).astype(np.float32) * 2 - 1
        return self.of_letter[code]

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of trigrams."""
        out = np.ones((len(keys), self.dimension), np.float32)
        for shift, turns in ((42, 2), (21, 1), (0, 0)):
            codes, at = np.unique(keys >> shift & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), turns) for c in codes])[at]
        return out

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """The sum of the vectors of all trigrams; in blocks, so the work space stays small."""
        total = np.zeros(self.dimension)
        keys, counts = np.unique(grams, return_counts=True)
        for start in range(0, len(keys), 4096):
            part, n = keys[start : start + 4096], counts[start : start + 4096].astype(np.float32)
            listed = part.tolist()
            new = [k for k in listed if k not in self.rows]
            if len(new) + len(self.rows) > MAX_TRIGRAMS:
                self.forget()
                new = listed
            if new:
                self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
                self.grow(self.bound(np.array(new)))
            total += n @ self.vectors[[self.rows[k] for k in listed]]
        return total

    def grow(self, more: np.ndarray) -> None:
        filled = len(self.rows) - len(more)
        if len(self.rows) > len(self.vectors):
            bigger = np.empty((min(max(4096, 2 * len(self.rows)), MAX_TRIGRAMS), self.dimension), np.float32)
            bigger[:filled] = self.vectors[:filled]
            self.vectors = bigger
        self.vectors[filled : len(self.rows)] = more


@lru_cache(maxsize=1)
def space(dimension: int, seed: int) -> Space:
    """One for each Python worker."""
    return Space(dimension, seed)


def _bundle(batches: Iterable[pa.RecordBatch], dimension: int, seed: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for part in runs(batches):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(trigrams(text))
        for lang, grams in by.items():
            sums[lang] = sums.get(lang, 0) + space(dimension, seed).bundle(np.concatenate(grams))
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])


def prototypes(labelled: DataFrame, dimension: int = DIMENSION, seed: int = 1) -> dict[str, np.ndarray]:
    """The vector of each language of rows ``lang, text`` without nulls."""
    parts = labelled.select("lang", "text").mapInArrow(partial(_bundle, dimension=dimension, seed=seed), "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x dimension
        out.setdefault(r["lang"], np.zeros(dimension))[r["k"]] = r["x"]
    return {lang: out[lang] for lang in sorted(out)}


def _predict(batches: Iterable[pa.RecordBatch], names: list[str], profile: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    dimension = profile.shape[1]
    for part in runs(batches):
        langs, scores = [], []
        for text in part.column(part.num_columns - 1).to_pylist():
            grams = trigrams(text or "")
            if not len(grams) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            vector = space(dimension, seed).bundle(grams)
            likeness = profile @ vector / max(float(np.linalg.norm(vector)), 1e-12)
            best = int(likeness.argmax())
            langs.append(names[best])
            scores.append(min(max(float(likeness[best]), 0.0), 1.0))
        made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "lang_pred", "score"])


def predict(rows: DataFrame, known: dict[str, np.ndarray], dimension: int = DIMENSION, seed: int = 1) -> DataFrame:
    """The rows with ``lang_pred, score`` in place of their last column, a text."""
    profile = np.array([v / max(float(np.linalg.norm(v)), 1e-12) for v in known.values()]).reshape(-1, dimension)
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_predict, names=list(known), profile=profile, seed=seed), f"{keep}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    Profiles are learned from documents with text and language whose id, as text, has a crc32 that the
    number of folds doesn't divide; the others are held out. A null id counts as the empty text. A null
    text, one without a letter, or no language to learn gives ``und`` and score 0. Of equal cosines the first
    language in alphabetical order wins. Repeated rows count as often as they occur; an empty table gives
    an empty result.
    """
    d = plain(docs, doc_id=doc_id, lang=lang, text=text)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    d = d.withColumn("held_out", fold == 0)
    known = prototypes(d.where(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    return predict(d.select("doc_id", "held_out", "text"), known).withColumnRenamed("doc_id", doc_id)
