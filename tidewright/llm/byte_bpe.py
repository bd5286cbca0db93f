"""Byte-level BPE by a transducer whose deterministic states are made when a text first needs them.

A greedy merge result is known by its neighbours: a token sequence is what the merges give exactly if
every two tokens side by side are what the merges give for the bytes of the two. So the merges become a
nondeterministic transducer that reads bytes along the trie of the vocabulary and may end a token if it
goes with the one before. Its subsets are determinised lazily: a deterministic state is the set of live
readings (token before, place in the trie). Exactly one of them ends a token with the byte just read; that
token is the step's output. Tokens on which all live readings agree are emitted; a reading in flight is no
longer than the longest token, which bounds the lookahead. States are kept per worker and dropped when
they are many.

Decoding runs a UTF-8 state machine over tokens, whose steps are composed from those of their bytes, and
hands out text whenever a character is complete.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from hashlib import sha256
from struct import iter_unpack, pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .batches import sized_runs
from .text import plain

#: What a worker remembers at most: states (about 0.7 kB each), pairs of tokens (0.1 kB), pieces and chunks of them
#: in each of two generations (0.3 kB).
MAX_STATES = 250_000
MAX_PAIRS = 500_000
MAX_PIECES = 250_000
#: Longer pieces run through the transducer each time instead of being remembered.
LONG_PIECE = 48
#: Fixed value: a public pattern whose pieces begin at a space between two characters that aren't white space.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROOT = 0
#: Bytes after which a long piece gives out what is settled.
WINDOW = 4096
#: Above every rank.
END = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merged(piece: bytes, ranks: dict[bytes, int], below: int = END) -> list[int]:
    """Merging by the book: always the leftmost pair of the lowest rank, of ranks below a limit. For single tokens only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], END))
        joined = parts[best] + parts[best + 1]
        if ranks.get(joined, END) >= below:
            break
        parts[best : best + 2] = [joined]
    return [ranks[p] for p in parts]


class Transducer:
    """Token ids of a byte string."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.size = {i: len(b) for b, i in ranks.items()}
        for token, i in ranks.items():
            node = ROOT
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][byte]
            self.token_at[node] = i
        self.longest = max(self.size.values())
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.number(((-1, ROOT),))

    def number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (0 left, 1 right) of a token while it is merged, each with the
        rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            known, at, until = [], token, END
            while True:
                known.append((at, until))
                if len(self.bytes_of[at]) == 1:
                    break
                until, at = at, self.halves(at)[side]
            self.edges[side][token] = known
        return known

    def halves(self, token: int) -> list[int]:
        """The two tokens whose merge makes this one."""
        return merged(self.bytes_of[token], self.ranks, below=token)

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens as they are, side by side.

        A merge across the border happens if its rank comes before the merges that take its two parts up;
        of equal ranks the left pair comes first.
        """
        known = self.neighbours.get((left, right))
        if known is None:
            if len(self.neighbours) > MAX_PAIRS:
                self.neighbours.clear()
            bytes_of, rank, known = self.bytes_of, self.ranks.get, True
            for a, a_until in self.edge(left, 1):
                for b, b_until in self.edge(right, 0):
                    across = rank(bytes_of[a] + bytes_of[b], END)
                    if across < a_until and across <= b_until and across < END:
                        known = False
            self.neighbours[left, right] = known
        return known

    def step(self, at: int, byte: int) -> tuple[int, int]:
        """The next state, and the last token of what has been read if it ends here; made on first use."""
        live, last = [], -1
        for before, node in self.states[at]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and (before < 0 or self.adjacent(before, token)):
                last = token
            if self.children[child]:
                live.append((before, child))
        live.append((last, ROOT))
        made = (self.number(tuple(sorted(live))), last)
        self.steps[at][byte] = made
        return made

    def settled(self, at: int, last: list[int]) -> int:
        """How many of the bytes read belong to tokens on which all live readings agree."""
        size, shared = self.size, None
        for _, node in self.states[at]:
            place = len(last) - self.depth[node]
            borders = {place}
            while place > 0:
                place -= size[last[place - 1]]
                borders.add(place)
            shared = borders if shared is None else shared & borders
        return max(shared)

    def emit(self, last: list[int]) -> list[int]:
        """The tokens of bytes that are decided, back from the end."""
        out, place, size = [], len(last), self.size
        while place:
            token = last[place - 1]
            out.append(token)
            place -= size[token]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.forget()
        if len(data) <= WINDOW:
            at, steps, last = 0, self.steps, []
            for byte in data:
                made = steps[at].get(byte) or self.step(at, byte)
                at = made[0]
                last.append(made[1])
            return self.emit(last)
        return self.encode_long(data)

    def encode_long(self, data: bytes) -> list[int]:
        """The same with a bounded window: tokens are given out as soon as all readings agree on them."""
        out: list[int] = []
        at, last = 0, []
        for start in range(0, len(data), WINDOW):
            if len(self.states) > self.max_states:
                state = self.states[at]
                self.forget()
                at = self.number(state)
            for byte in data[start : start + WINDOW]:
                at, token = self.steps[at].get(byte) or self.step(at, byte)
                last.append(token)
            done = self.settled(at, last)
            out.extend(self.emit(last[:done]))
            del last[:done]
        return out + self.emit(last)


#: States of UTF-8: 0 between characters, 1 to 3 bytes still to come, then the four restricted second bytes.
CLOSED, BROKEN = 0, -1
SECOND = {0xE0: (4, 0xA0, 0xBF, 1), 0xED: (5, 0x80, 0x9F, 1), 0xF0: (6, 0x90, 0xBF, 2), 0xF4: (7, 0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    """The state after one more byte."""
    if state == CLOSED:
        if byte < 0x80:
            return CLOSED
        if byte in SECOND:
            return SECOND[byte][0]
        return 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 < byte <= 0xEF else 3 if 0xF0 < byte < 0xF4 else BROKEN
    for number, low, high, after in SECOND.values():
        if state == number:
            return after if low <= byte <= high else BROKEN
    return state - 1 if state > 0 and 0x80 <= byte <= 0xBF else BROKEN


class Decoder:
    """Text from token ids as they come; a character that is cut between tokens waits for its rest.

    Tokens of whole characters leave the machine closed as they find it, so it takes steps only at the others.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: list[dict[int, int]] = [{} for _ in range(8)]
        self.table = pa.array([bytes_of.get(i) for i in range(max(bytes_of) + 1)], pa.large_binary())
        self.whole = np.array([i in bytes_of and self.closes(bytes_of[i]) for i in range(len(self.table))])
        self.state, self.held = CLOSED, np.empty(0, np.int64)

    @staticmethod
    def closes(token: bytes) -> bool:
        at = CLOSED
        for byte in token:
            at = at if at == BROKEN else utf8_step(at, byte)
        return at == CLOSED

    def move(self, state: int, token: int) -> int:
        at = state
        for byte in self.bytes_of[token]:
            at = utf8_step(at, byte)
            if at == BROKEN:
                raise ValueError(f"token {token} breaks a character")
        self.moves[state][token] = at
        return at

    def take(self, ids: Iterable[int]) -> bytes:
        """The bytes of the characters that are complete after these ids."""
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        state, last, opened = self.state, -1, 0
        for k in np.flatnonzero(~self.whole[ids]).tolist():
            if state == CLOSED:
                opened = k
            elif k != last + 1:
                break
            token = int(ids[k])
            after = self.moves[state].get(token)
            state, last = self.move(state, token) if after is None else after, k
        if state != CLOSED and last != len(ids) - 1:
            raise ValueError("a character is cut short")
        every = np.concatenate([self.held, ids])
        done = len(every) if state == CLOSED else len(self.held) + opened if self.state == CLOSED or opened else 0
        self.state, self.held = state, every[done:]
        found = self.table.take(pa.array(every[:done]))
        return found.buffers()[2].to_pybytes() if done else b""

    def feed(self, ids: Iterable[int]) -> str:
        """The text that is complete after these ids."""
        return self.take(ids).decode()

    def end(self) -> None:
        if len(self.held):
            raise ValueError("the ids end within a character")


class Codec:
    """Encoding of texts, each match of the pattern by itself, and decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.cut_at_spaces = pattern == SPACE_LED
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.decoder = Decoder(self.transducer.bytes_of)

    def piece(self, piece: str) -> tuple[bytes, bytes]:
        """The ids as unsigned 32-bit numbers, and as text with a space before each; long pieces aren't remembered."""
        made = self.young.get(piece) or self.old.get(piece)
        if made is None:
            ids = self.transducer.encode(piece.encode())
            made = pack(f"<{len(ids)}I", *ids), (" %d" * len(ids) % tuple(ids)).encode()
        if len(piece) <= LONG_PIECE:
            self.young[piece] = made
        return made

    def encode(self, text: str) -> list[int]:
        self.age()
        return [i for p in self.split(text) for i, in iter_unpack("<I", self.piece(p)[0])]

    def decode(self, ids: Iterable[int], chunk: int = 1 << 16) -> Iterator[str]:
        """The text in parts, from ids taken in chunks."""
        ids = list(ids)
        for start in range(0, len(ids), chunk):
            yield self.decoder.feed(ids[start : start + chunk])
        self.decoder.end()

    def age(self) -> None:
        """What is remembered is that of two generations."""
        if len(self.young) > MAX_PIECES:
            self.young, self.old = {}, self.young

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """The same of a text of any number of pieces."""
        pieces = self.split(chunk)
        if len(pieces) == 1:
            return self.piece(chunk)
        made = [self.piece(p) for p in pieces]
        made = b"".join([i for i, _ in made]), b"".join([t for _, t in made])
        if len(chunk) <= LONG_PIECE:
            self.young[chunk] = made
        return made

    def of_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        self.age()
        young, old = self.young, self.old
        found = list(map(young.get, chunks))
        for k in [k for k, x in enumerate(found) if x is None]:
            c = chunks[k]
            if c in old:
                found[k] = young[c] = old[c]
            else:
                found[k] = self.chunk(c)
        return found

    def digest(self, ids: bytes, text: bytes) -> tuple[int, str, str]:
        """Number of ids, and the hashes of the ids and of what they decode to."""
        numbers = np.frombuffer(ids, "<u4")
        back = sha256()
        for start in range(0, len(numbers), 1 << 16):
            back.update(self.decoder.take(numbers[start : start + (1 << 16)]))
        self.decoder.end()
        return len(numbers), sha256(text[1:]).hexdigest(), back.hexdigest()

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Of each text. Texts are cut before single spaces into chunks, each different chunk is looked up once.

        A piece of the pattern never goes on beyond a space between two characters that aren't white space, and
        begins there, so the chunks are matched by themselves. Texts with other white space beside a space, and
        those of other patterns, are matched whole.
        """
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        unlike = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        first, last = offsets[:-1], offsets[1:] - 1
        codes = coded.indices.to_numpy().astype(np.int64)
        begins = np.array([x[:1].isspace() for x in unlike])[codes]
        ends = np.array([not x or x[-1].isspace() for x in unlike])[codes]
        begins[first] = False
        ends[last] = False
        ends[first] &= np.array([bool(x) for x in unlike])[codes[first]]
        uneven = np.add.reduceat(begins | ends, first) > 0 if self.cut_at_spaces else np.ones(len(texts), bool)
        starts, codes[first] = np.unique(codes[first], return_inverse=True)
        led = np.ones(len(codes), bool)
        led[first] = False
        codes[led] += len(starts)
        if uneven.all():
            made = [(b"", b"")] * (len(starts) + len(unlike))
        else:
            made = self.of_chunks([unlike[k] for k in starts] + [" " + x for x in unlike])
        columns = []
        for side in (0, 1):
            whole = pa.array([m[side] for m in made], pa.large_binary()).take(pa.array(codes))
            columns.append((np.frombuffer(whole.buffers()[1], "<i8", len(whole) + 1)[offsets].tolist(), whole.buffers()[2] or b""))
        (id_ends, ids), (text_ends, text) = columns
        out = []
        for k, odd in enumerate(uneven.tolist()):
            if odd:
                out.append(self.digest(*self.chunk(texts[k].as_py())))
            else:
                out.append(self.digest(bytes(ids[id_ends[k] : id_ends[k + 1]]), bytes(text[text_ends[k] : text_ends[k + 1]])))
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(read_ranks(path), pattern)


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for run in sized_runs(batches, 1):
        found = codec(path, pattern).digests(pc.fill_null(run.column(1), ""))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([run.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded whole.

    A null text counts as empty: no ids. Repeated rows give repeated results, an empty table an empty one;
    other columns aren't read. Special tokens are not known: their text is ordinary text.
    """
    d = plain(docs, doc_id=doc_id, text=text)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return d.mapInArrow(partial(_digests, path=path, pattern=pattern), schema).withColumnRenamed("doc_id", doc_id)
