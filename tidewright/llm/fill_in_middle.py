"""Fill-in-the-middle: a text is cut at two of its tokens' ends and put together in another order.

One full match of ``(unit)*`` by a library whose groups keep every repetition gives the ends of all units at
once: their number is the number of tokens, and the two cuts are two of them. The units are possessive, so a
match of any length needs no backtracking state. What decides about a document is a hash of its id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import runs
from .text import plain, text_of

#: Units: a run of ASCII letters, or any other code point.
UNITS = r"([A-Za-z]++|[^A-Za-z])*+"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are cut, and so many of those have the suffix first.
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def meet(x: str, y: str) -> bool:
    """Whether ``x`` lies in another marker ``y`` or ends as ``y`` begins."""
    return not x or (x != y and x in y) or any(x.endswith(y[:k]) for k in range(1, len(y)))


def _cut(batches: Iterator[pa.RecordBatch], markers: Sequence[str], cut_percent: int, suffix_first_percent: int) -> Iterator[pa.RecordBatch]:
    units, (p, s, m) = regex.compile(UNITS), markers
    for part in runs(batches):
        own = part.num_columns - 5
        texts, *numbers = (part.column(k).to_pylist() for k in range(own, part.num_columns))
        made: list[tuple] = []
        for text, h1, h2, h3, h4 in zip(texts, *numbers, strict=True):
            ends = units.fullmatch(text).ends(1)
            n = len(ends)
            if not n or h3 % 100 >= cut_percent or any(x in text for x in markers):
                made.append((text, n, "plain", None, None))
                continue
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (ends[k - 1] if k else 0 for k in (first, second))
            form = "spm" if h4 % 100 < suffix_first_percent else "psm"
            out = f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if form == "spm" else f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
            made.append((out, n, form, a, b - a))
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([row[k] for row in made], kind) for k, kind in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*part.columns[:own], *columns], names=[*part.schema.names[:own], "output", "n", "form", "prefix_chars", "middle_chars"])


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, markers: Sequence[str] = MARKERS,
    cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``doc_id, output, n, form, prefix_chars, middle_chars`` of every row.

    The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: the text as it
    is, with null lengths, if it is empty or null, holds a marker or isn't drawn. A null id counts as an empty
    one. Equal ids draw the same numbers, so repeated rows give equal rows; an empty table an empty result.
    No marker may hold another or end as one begins, so that none can arise where a piece meets a marker.
    """
    if len({*markers}) != 3 or any(meet(x, y) for x in markers for y in markers):
        raise ValueError("three markers of which none holds another or ends as one begins")
    numbers = {f"h{k + 1}": h for k, h in enumerate(draws(F.col("doc_id"), seed))}
    d = plain(docs, doc_id=doc_id, text=text).withColumn("text", text_of("text")).withColumns(numbers)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, output string, n long, form string, prefix_chars long, middle_chars long"
    work = partial(_cut, markers=tuple(markers), cut_percent=cut_percent, suffix_first_percent=suffix_first_percent)
    return d.mapInArrow(work, schema).withColumnRenamed("doc_id", doc_id)


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made of. A cut text holds no marker, so the markers part it into its three pieces."""
    pieces = F.split(output, "|".join(map(re.escape, markers)), 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).otherwise(F.concat(pieces[2], pieces[3], pieces[1]))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the SHA-256 of the output and of the text restored from it."""
    out = transform(docs, doc_id, text)
    restored = restore(F.col("output"), F.col("form"))
    return out.select(
        doc_id, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )
