"""Token ids in files with directly addressable codes: any token is read without decoding a block.

An id is cut into chunks, the lowest bits first. The first chunks of all ids stand in a row (level 1); an id
with more bits has a set bit in the level's continuation bitmap, and its next chunk stands in level 2 at the
place that is the number of set bits before it, and so on. A rank directory holds the number of set bits
before every 512th bit, so that number is one lookup and a count over at most 64 bytes. The widths of the
levels are those that make the file smallest, found from the file's own counts of id lengths in bits.

A file is, in this order, with little-endian numbers:

* ``DAC1``
* for each level its chunks, bit-packed; then, for all but the last level, its bitmap and the rank directory
  (unsigned 64-bit numbers)
* the documents as an Arrow stream ``doc_id, n_tokens``, in the order of their ids in the file
* a JSON object with the number of tokens and the widths, counts, offsets and sizes of all parts, its length
  as an unsigned 32-bit number, and ``DAC1`` again

``_files.json`` beside the files lists those of finished writes in ascending order of their documents. A task
writes files under names of its own and only the driver's commit adds them, so attempts that failed or ran
twice leave at most files that no reader looks at.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ensure_checkpoint_dir
from .batches import sized_runs
from .text import plain
from .word_ids import word_ids

MAGIC = b"DAC1"
LISTING = "_files.json"
#: A file is closed once it has so many ids; a document is never split.
TOKENS_PER_FILE = 1 << 24
RANK_EVERY = 512
#: Ids handled at once while packing; a multiple of 8, so every block ends on a byte.
BLOCK = 1 << 18


def best_widths(lengths: np.ndarray) -> list[int]:
    """Level widths with the fewest bits in all. ``lengths[b]`` is how many ids need ``b`` bits (at least 1).

    A level of width w from bit b on costs w bits, and one more for the bitmap unless it is the last, for each
    id longer than b bits. Dynamic program over b, from the longest id down.
    """
    longest = max([1, *np.flatnonzero(lengths).tolist()])
    longer = [int(lengths[b + 1 :].sum()) if b else int(lengths.sum()) for b in range(longest + 1)]
    cost, width = [0] * (longest + 1), [0] * (longest + 1)
    for b in range(longest - 1, -1, -1):
        cost[b], width[b] = min((longer[b] * (w + (b + w < longest)) + cost[b + w], w) for w in range(1, longest - b + 1))
    out, b = [], 0
    while b < longest:
        out.append(width[b])
        b += width[b]
    return out


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many of the unsigned 32-bit ids need 1 to 32 bits, at their number of bits; zero needs one."""
    return np.bincount(np.maximum(np.frexp(ids.astype(float))[1], 1), minlength=33)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """``width`` low bits of each value, one after the other, lowest bit first."""
    out = []
    for start in range(0, len(values), BLOCK):
        block = np.ascontiguousarray(values[start : start + BLOCK], "<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(block, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(data: memoryview, width: int, start: int, stop: int) -> np.ndarray:
    """Values ``start`` to ``stop`` of ``pack_bits``."""
    first = start * width
    raw = np.frombuffer(data[first // 8 : -(-stop * width // 8)], np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + (stop - start) * width].reshape(-1, width)
    wide = np.zeros((len(bits), 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def encode(ids: np.ndarray) -> tuple[dict, list[bytes]]:
    """The header and the parts of the ids of a file."""
    lengths = sum((bit_lengths(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)), np.zeros(33, np.int64))
    levels, parts, offset, rest = [], [], len(MAGIC), ids
    widths = best_widths(lengths)

    def put(part: bytes) -> tuple[int, int]:
        nonlocal offset
        parts.append(part)
        offset += len(part)
        return offset - len(part), len(part)

    for k, width in enumerate(widths):
        level = {"width": width, "count": len(rest), "chunks": put(pack_bits(rest, width))}
        if k + 1 < len(widths):
            more = rest >> width
            goes_on = more > 0
            bitmap = np.packbits(goes_on, bitorder="little")
            each = np.bitwise_count(np.pad(bitmap, (0, -len(bitmap) % (RANK_EVERY // 8))).reshape(-1, RANK_EVERY // 8)).sum(axis=1, dtype="<u8")
            level |= {"bitmap": put(bitmap.tobytes()), "ranks": put((np.cumsum(each) - each).astype("<u8").tobytes())}
            rest = more[goes_on]
        levels.append(level)
    return {"tokens": len(ids), "levels": levels}, parts


def write_file(out, ids: np.ndarray, documents: pa.RecordBatch) -> None:
    header, parts = encode(ids)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as stream:
        stream.write_batch(documents)
    listed = sink.getvalue()
    header |= {"documents": (len(MAGIC) + sum(map(len, parts)), listed.size)}
    said = json.dumps(header).encode()
    for part in (MAGIC, *parts, listed, said, len(said).to_bytes(4, "little"), MAGIC):
        out.write(part)


class TokenFile:
    """Reads ids of one file from its bytes or a memory map; only what is asked for is touched."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:4]) != MAGIC or bytes(self.data[-4:]) != MAGIC:
            raise ValueError("not a token file, or cut short")
        size = int.from_bytes(self.data[-8:-4], "little")
        self.header = json.loads(bytes(self.data[-8 - size : -8]))
        self.levels = self.header["levels"]
        self.ranks = [np.frombuffer(self.part(level["ranks"]), "<u8") if "ranks" in level else None for level in self.levels]

    def part(self, place: list[int]) -> memoryview:
        return self.data[place[0] : place[0] + place[1]]

    def __len__(self) -> int:
        return self.header["tokens"]

    def rank(self, level: int, place: int) -> int:
        """Set bits of a level's bitmap before ``place``."""
        if place == self.levels[level]["count"]:
            return self.levels[level + 1]["count"]
        block, bits = divmod(place, RANK_EVERY)
        start = self.levels[level]["bitmap"][0] + block * RANK_EVERY // 8
        own = int.from_bytes(self.data[start : start + -(-bits // 8)], "little") & ((1 << bits) - 1)
        return int(self.ranks[level][block]) + own.bit_count()

    def __getitem__(self, place: int) -> int:
        """The id at a place: one chunk, one bit and one rank for each level it has."""
        if not 0 <= place < len(self):
            raise IndexError(place)
        value = shift = 0
        for k, level in enumerate(self.levels):
            bit, width = place * level["width"], level["width"]
            start = level["chunks"][0] + bit // 8
            chunk = int.from_bytes(self.data[start : start + 5], "little") >> bit % 8 & ((1 << width) - 1)
            value |= chunk << shift
            shift += width
            if "bitmap" not in level or not self.data[level["bitmap"][0] + place // 8] >> place % 8 & 1:
                break
            place = self.rank(k, place)
        return value

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: on each level a stretch, whose ends come from the rank directory."""
        if not 0 <= start <= stop <= len(self):
            raise IndexError((start, stop))
        out = np.zeros(stop - start, np.uint32)
        at, shift = slice(None), 0
        for k, level in enumerate(self.levels):
            chunks = unpack_bits(self.part(level["chunks"]), level["width"], start, stop)
            out[at] |= chunks << np.uint32(shift)
            shift += level["width"]
            if "bitmap" not in level:
                break
            bitmap = np.frombuffer(self.part(level["bitmap"])[start // 8 : -(-stop // 8)], np.uint8)
            goes_on = np.unpackbits(bitmap, bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            at = np.flatnonzero(goes_on) if isinstance(at, slice) else at[goes_on]
            if not len(at):
                break
            start = self.rank(k, start)
            stop = start + len(at)
        return out

    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(pa.py_buffer(self.part(self.header["documents"]))).read_all()


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder: a local or mounted path, or any address that Arrow opens."""
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


def listing(folder: str) -> list[dict]:
    fs, path = store(folder)
    place = f"{path}/{LISTING}"
    if fs.get_file_info(place).type == pafs.FileType.NotFound:
        return []
    with fs.open_input_file(place) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class TokenWriter(DataSourceArrowWriter):
    """Writes sorted rows ``doc_id, text`` of each task as files of encoded ids."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.tokenizer = options["path"], options["tokenizer"]
        self.end, self.per_file = int(options.get("end", 1)), int(options.get("tokensperfile", TOKENS_PER_FILE))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = store(self.folder)
        fs.create_dir(path, recursive=True)
        last, files = np.array([self.end], "<u4").tobytes(), []
        keys: list[pa.Array] = []
        parts: list[bytes] = []
        counts: list[int] = []

        def close() -> None:
            name = f"part-{TaskContext.get().partitionId():06d}-{len(files):05d}-{uuid.uuid4().hex}.dac"
            documents = pa.record_batch({"doc_id": pa.concat_arrays(keys), "n_tokens": pa.array(counts, pa.int64())})
            with fs.open_output_stream(f"{path}/{name}") as out:
                write_file(out, np.frombuffer(b"".join(parts), "<u4"), documents)
            files.append({"name": name, "partition": TaskContext.get().partitionId(), "tokens": sum(counts), "documents": len(counts)})
            keys.clear(), parts.clear(), counts.clear()

        held = 0
        for run in sized_runs(iterator, 1):
            first = 0
            for row, ids in enumerate(word_ids(self.tokenizer).encode(run.column(1))):
                parts += (ids, last)
                counts.append(len(ids) // 4 + 1)
                held += counts[-1]
                if held >= self.per_file:
                    keys.append(run.column(0).slice(first, row + 1 - first))
                    close()
                    first, held = row + 1, 0
            if first < run.num_rows:
                keys.append(run.column(0).slice(first))
        if counts:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the files of all tasks in the order of their rows; after those written before, unless they are replaced."""
        new = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        before = [] if self.overwrite else listing(self.folder)
        fs, path = store(self.folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{LISTING}.new") as out:
            out.write(json.dumps(before + new).encode())
        fs.move(f"{path}/{LISTING}.new", f"{path}/{LISTING}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = store(self.folder)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{path}/{f['name']}")


class OneFile(InputPartition):
    def __init__(self, path: str, start: int):
        super().__init__((path, start))


class TokenReader(DataSourceReader):
    """One task for each listed file: ``doc_id, start, n_tokens, ids_crc32``, and the ids if they are asked for."""

    def __init__(self, options: dict, with_ids: bool):
        self.folder, self.with_ids = options["path"], with_ids

    def partitions(self) -> list[OneFile]:
        out, start = [], 0
        for f in listing(self.folder):
            out.append(OneFile(f["name"], start))
            start += f["tokens"]
        return out or [OneFile("", 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        name, start = partition.value
        if not name:
            return
        fs, path = store(self.folder)
        with fs.open_input_file(f"{path}/{name}") as f:
            file = TokenFile(f.read_buffer())
        done = 0
        for batch in file.documents().to_batches(max_chunksize=1024):
            starts, sums, ids = [], [], []
            for n in batch.column(1).to_pylist():
                own = file.ids(done, done + n).astype("<u4", copy=False)
                starts.append(start + done)
                sums.append(zlib.crc32(own))
                if self.with_ids:
                    ids.append(own.astype(np.int64))
                done += n
            columns = {"doc_id": batch.column(0), "start": pa.array(starts, pa.int64()), "n_tokens": batch.column(1), "ids_crc32": pa.array(sums, pa.int64())}
            yield pa.record_batch(columns | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if self.with_ids else {}))


class TokenFiles(DataSource):
    """``spark.read.format("tokens")`` and ``df.write.format("tokens")``. Options: ``path``; to write ``tokenizer``,
    ``end`` and ``tokensPerFile``; to read ``ids`` (true: with the ids themselves) and ``key``, the type of ``doc_id``."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def wants_ids(self) -> bool:
        return str(self.options.get("ids", "false")).lower() == "true"

    def schema(self) -> str:
        ids = ", ids array<long>" if self.wants_ids() else ""
        return f"doc_id {self.options.get('key', 'long')}, start long, n_tokens long, ids_crc32 long{ids}"

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), overwrite)

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options), self.wants_ids())


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, tokens_per_file: int = TOKENS_PER_FILE) -> None:
    """Writes the ids of all texts and an end id after each, in ascending order of ``doc_id``; replaces what the folder lists.

    A null text counts as empty and is the end id alone. A null id comes first. Rows of one id follow each other
    in an order that doesn't depend on the run; many of them are dealt to several files, as the order goes on
    with a hash of the text and the input's partition. An empty table gives a folder that lists no file.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    d = plain(docs, doc_id=doc_id, text=text)
    order = d.withColumns({"_digest": F.xxhash64("text"), "_part": F.spark_partition_id()})
    by = [F.col("doc_id").asc_nulls_first(), "_digest", "_part"]
    rows = order.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    options = {"path": folder, "tokenizer": tokenizer, "end": end, "tokensPerFile": tokens_per_file}
    rows.write.format("tokens").options(**options).mode("overwrite").save()


def read(spark: SparkSession, folder: str, key: str = "long", ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("tokens").options(path=folder, key=key, ids=str(ids).lower()).load()


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Writes the ids to a new folder below ``spark.checkpoint.dir`` and reads them back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer, doc_id, text, **options)
    return read(spark, folder, docs.schema[doc_id].dataType.simpleString()).withColumnRenamed("doc_id", doc_id)
