"""Token ids of whole texts by a word-level tokenizer, with the library asked once for each new word."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White-space separated words whose ids a worker remembers in each of two generations, about 0.2 kB each.
MAX_WORDS = 250_000
#: A word of one token that stands between words that are encoded together; words with it are encoded alone.
MARK = "~"
ENDS = b".,"
#: Matches U+0300 to U+037F, where all marks that compose with an ASCII letter are, and the start of special tokens.
UNEVEN = r"[\x{0300}-\x{037F}]|<\|"
TOGETHER = 500


class WordIds:
    """Ids of texts as unsigned 32-bit little-endian bytes, from the library's ids of their words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    space-separated words in a row. A run of texts becomes one array of words; each different word of it is
    looked up once, and the library is asked for those not seen lately. The tokenizer also composes and then
    lower-cases what isn't a special token, so ASCII letters without a mark to compose with can be lowered
    first, which halves the words. Texts with such marks or special tokens keep their capitals.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends_piece = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_piece[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.mark = self.ids([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError(f"{MARK} must be one token")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Many words are one call. A word of letters alone ends with the first token that ends a piece; a
        mark stands between others, and its only token shows where they end."""
        found: dict[bytes, bytes] = {}
        letters, marked, alone = [], [], []
        for w in new:
            t = w.decode()
            (letters if t.isalpha() else alone if MARK in t or "<|" in t else marked).append((w, t))
        for start in range(0, len(letters), TOGETHER):
            part = letters[start : start + TOGETHER]
            ids = self.ids([" ".join([t for _, t in part])])[0]
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(ends) != len(part):  # what is a letter differs
                alone += part
                continue
            text, places = ids.tobytes(), [0, *(ends * 4).tolist()]
            found.update([(w, text[places[k] : places[k + 1]]) for k, (w, _) in enumerate(part)])
        for start in range(0, len(marked), TOGETHER):
            part = marked[start : start + TOGETHER]
            ids = self.ids([f" {MARK} ".join([t for _, t in part])])[0]
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            text, places = ids.tobytes(), zip(np.append(0, ends[:-1] + 1) * 4, ends * 4, strict=True)
            found.update((w, text[a:b]) for (w, _), (a, b) in zip(part, places, strict=True))
        found.update((w, ids.tobytes()) for (w, _), ids in zip(alone, self.ids([t for _, t in alone]), strict=True))
        return found

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words used lately stay remembered; those of the generation before are forgotten."""
        if len(self.young) > self.max_words:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        young[b""] = b""  # white space at the ends of a text splits off nothing
        found = list(map(young.get, words))
        unknown = [k for k, ids in enumerate(found) if ids is None]
        new, ended = [], []
        for k in unknown:
            w = words[k]
            if (ids := old.get(w)) is not None:
                found[k] = young[w] = ids
            # A mark after a letter is a piece of its own: such a word is its stem and the mark.
            elif w[-1:] in ENDS and w[-2:-1].islower():
                ended.append(k)
            else:
                new.append(k)
        stems = {part for k in ended for part in (words[k][:-1], words[k][-1:])}
        for w in [w for w in stems if w not in young and w in old]:
            young[w] = old[w]
        young.update(self.learn([*{words[k] for k in new} | {w for w in stems if w not in young}]))
        for k in new:
            found[k] = young[words[k]]
        for k in ended:
            found[k] = young[words[k]] = young[words[k][:-1]] + young[words[k][-1:]]
        return found

    def together(self, texts: pa.Array) -> list[bytes]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = self.of_words(words)
        whole = pa.array(ids, pa.large_binary()).take(coded.indices)
        offsets, data = np.frombuffer(whole.buffers()[1], "<i8", len(whole) + 1, whole.offset * 8), whole.buffers()[2]
        ends = offsets[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist() if len(whole) else [0] * (len(texts) + 1)
        data = data or b""
        return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        uneven = pc.match_substring_regex(texts, UNEVEN)
        if not pc.any(uneven).as_py():
            return self.together(pc.ascii_lower(texts))
        out: list[bytes] = [b""] * len(texts)
        for mask, change in ((pc.invert(uneven), pc.ascii_lower), (uneven, lambda x: x)):
            at = pc.indices_nonzero(mask)
            for k, ids in zip(at.to_pylist(), self.together(change(texts.take(at))), strict=True):
                out[k] = ids
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
