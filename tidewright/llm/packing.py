"""Packing of token sequences: linear grouping of the large lengths, few-size configurations, best fit for the rest.

Lengths are whole numbers up to the capacity, so how many pieces have each length (a table of at most
``capacity`` rows, whatever the data) is all that planning needs. The plan is made once from that table:

1. Pieces longer than ``large`` are sorted and cut into ``groups`` of equal cardinality; each length is
   rounded up to the longest of its group.
2. For the few rounded sizes a linear program over configurations (what fits into one sequence) is solved
   by column generation; configurations are used as often as the whole part of the solution says.
3. Actual lengths take the places of their group, in order, which leaves them some room to spare.
4. What is left, and all small lengths, go in by best fit, longest first.

Sequences that are filled alike are one class with a count, so a plan stays small at any size. Pieces are
then numbered within their length by counting per length and slice of a hash, and each one finds its
sequence and offset from its number. Only the plan and the table of lengths are outside Spark's partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialise, shuffle_partitions
from .batches import sized_runs
from .text import plain
from .word_ids import word_ids

CAPACITY = 4096
#: Each of these numbers of groups is planned; the plan with the fewest sequences is used.
GROUPS = (24, 128, 256)
#: Pieces above capacity / LARGE are large.
LARGE = 3


def _cut(batches: Iterable[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    last = np.array([end], "<u4").tobytes()
    for part in sized_runs(batches, 1):
        rows, pieces, starts, lengths, sums = [], [], [], [], []
        for row, ids in enumerate(word_ids(path).encode(part.column(1))):
            ids += last
            for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                piece = ids[start : start + 4 * capacity]
                rows.append(row)
                pieces.append(k)
                starts.append(start // 4)
                lengths.append(len(piece) // 4)
                sums.append(zlib.crc32(piece))
        columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])


def cut(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every text: its ids and the end id, cut only if longer than the capacity."""
    d = plain(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(partial(_cut, path=path, end=end, capacity=capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: dynamic program over its number of items."""
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        better, choice = value.copy(), np.full(capacity + 1, -1)
        for k, size in enumerate(sizes):
            with_k = np.full(capacity + 1, -1.0)
            with_k[size:] = value[:-size] + worth[k]
            win = with_k > better + 1e-12
            better[win], choice[win] = with_k[win], k
        choices.append(choice)
        value = better
    used, room = np.zeros(len(sizes), int), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            used[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used: the whole part of a solution of the linear program.

    Column generation from one-size configurations; a pivot keeps all amounts at or above zero, so the
    solution holds even if it ends before the optimum.
    """
    basis = np.diag(capacity // sizes).astype(float)
    amount = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        amount = np.maximum(amount - ratio[leave] * direction, 0)
        amount[leave] = ratio[leave]
    return [(basis[:, k].astype(int), int(amount[k] + 1e-9)) for k in range(len(sizes)) if amount[k] >= 1 - 1e-9]


def grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs ``[length, count]`` of each group, longest first; groups hold equally many pieces but for rounding."""
    total = sum(counts.values())
    share, out, room = -(-total // groups) if total else 0, [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            n = min(left, room)
            out[-1].append([length, n])
            left, room = left - n, room - n
    return out


class Plan:
    """Classes of sequences filled alike: ``[count, ((length, times), ...)]``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0], large: int = LARGE):
        self.capacity = capacity
        self.classes: list[list] = []
        self.rooms: list[int] = []  # distinct room left, sorted
        self.by_room: dict[int, list[int]] = {}
        if counts and not 1 <= min(counts) <= max(counts) <= capacity:
            raise ValueError("lengths must be from 1 to the capacity")
        rest = {n: c for n, c in counts.items() if c}
        if whole := rest.pop(capacity, 0):
            self.add(whole, ((capacity, 1),))
        self.pack_large(rest, groups, capacity // large)
        for length in sorted(rest, reverse=True):
            self.best_fit(length, rest[length])

    def add(self, count: int, items: tuple) -> None:
        room = self.capacity - sum(length * times for length, times in items)
        self.classes.append([count, items])
        if room:
            if room not in self.by_room:
                insort(self.rooms, room)
            self.by_room.setdefault(room, []).append(len(self.classes) - 1)

    def pack_large(self, rest: dict[int, int], groups: int, above: int) -> None:
        """Steps 1 to 3; takes what it places out of ``rest``."""
        queues = grouped({n: c for n, c in rest.items() if n > above}, groups)
        if not queues:
            return
        merged: dict[int, list[list[int]]] = {}
        for queue in queues:
            merged.setdefault(queue[0][0], []).extend(queue)
        sizes = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(c for _, c in merged[s]) for s in sizes], float)
        for times, count in configurations(sizes, demand, self.capacity):
            slots = [merged[s] for s, n in zip(sizes, times, strict=True) for _ in range(n)]
            while count:
                # Every place of the configuration takes the next length of its group.
                wanted: dict[int, int] = {}
                for queue in slots:
                    wanted[id(queue)] = wanted.get(id(queue), 0) + 1
                alike = min(count, *(max(1, q[0][1] // wanted[id(q)]) for q in slots))
                taken: dict[int, int] = {}
                for queue in slots:
                    need = alike
                    if queue[0][1] < need:
                        need = alike = 1
                    length = queue[0][0]
                    taken[length] = taken.get(length, 0) + 1
                    queue[0][1] -= need
                    rest[length] -= need
                    if not queue[0][1]:
                        queue.pop(0)
                self.add(alike, tuple(taken.items()))
                count -= alike
        for length in [n for n, c in rest.items() if not c]:
            del rest[length]

    def best_fit(self, length: int, n: int) -> None:
        """Puts ``n`` pieces where the least room that suffices is left; a sequence takes them while it is the tightest."""
        while n:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                times = self.capacity // length
                if n >= times:
                    self.add(n // times, ((length, times),))
                if n % times:
                    self.add(1, ((length, n % times),))
                return
            room = self.rooms[k]
            number = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[k]
            count, items = self.classes[number]
            times = room // length
            full = min(count, n // times)
            self.classes[number] = [0, ()]
            if full:
                self.add(full, (*items, (length, times)))
            n -= full * times
            count -= full
            if n and count:  # fewer left than one sequence takes
                self.add(1, (*items, (length, n)))
                n, count = 0, count - 1
            if count:
                self.add(count, items)

    def slots(self) -> np.ndarray:
        """Rows ``length, first number, times, first sequence, offset``, by length and number."""
        rows, placed, sequence = [], {}, 0
        for count, items in self.classes:
            offset = 0
            for length, times in items:
                first = placed.get(length, 0)
                rows.append((length, first, times, sequence, offset))
                placed[length] = first + count * times
                offset += length * times
            sequence += count
        return np.array(sorted(rows), np.int64).reshape(-1, 5)

    @property
    def sequences(self) -> int:
        return sum(count for count, _ in self.classes)


def numbered(pieces: DataFrame, slices: int) -> DataFrame:
    """Adds ``number``, from 0 within each length.

    Pieces of a length are dealt out to slices by hash; a slice is numbered by itself after those before
    it. A length that very many pieces have, such as that of a large group of copies, is many slices.
    """
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    sizes = dealt.groupBy("length", "slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("own", own).join(sizes, ["length", "slice"]).withColumn("number", F.col("ahead") + F.col("own")).drop("slice", "own", "ahead")


def _place(batches: Iterable[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (slots[:, 0] << 48) | slots[:, 1]
    for batch in batches:
        length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
        at = slots[np.searchsorted(keys, (length << 48) | number, "right") - 1]
        turn = number - at[:, 1]
        made = {"sequence_id": at[:, 3] + turn // at[:, 2], "offset": at[:, 4] + turn % at[:, 2] * length}
        kept = [n for n in batch.schema.names if n != "number"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), *map(pa.array, made.values())], names=[*kept, *made])


def lengths(pieces: DataFrame) -> dict[int, int]:
    """How many pieces have each length: at most ``capacity`` rows."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text counts as empty and is one piece with the end id alone. Repeated rows are packed as often
    as they occur; which of two equal ones comes first is open. An empty table gives an empty result.
    """
    pieces = materialise(cut(docs, path, doc_id, text, end, capacity))
    counts = lengths(pieces)
    plan = min((Plan(counts, capacity, n) for n in groups), key=lambda p: p.sequences)
    rows = numbered(pieces, shuffle_partitions(docs.sparkSession))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "number"]).add("sequence_id", "long").add("offset", "long")
    placed = rows.mapInArrow(partial(_place, slots=plan.slots()), schema)
    return placed.select(F.col("doc_id").alias(doc_id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
