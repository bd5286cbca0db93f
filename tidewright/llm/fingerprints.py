"""Document fingerprints: every five-word shingle whose hash lies below a fixed fraction of all hashes.

A shingle is kept or not by its own hash alone, so sketches of texts of any size hold a fair sample of
the same shingles: the sketch of a union is the union of sketches, and the share of one sketch found
in another estimates how much of the text the other contains, however unequal they are. A text with
no hash below the fraction keeps its smallest one, so only a text without words has an empty sketch;
``merged`` keeps to that rule as well. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise, shuffle_partitions
from .text import SHINGLE, plain, text_of, windows, words

#: One in so many shingles is kept.
SCALE = 5
DIGITS = 16


def limit(scale: int) -> str:
    """Hashes, as lower-case hex, are kept if they are below this one."""
    return f"{16**DIGITS // scale:0{DIGITS}x}"


def with_sketch(rows: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """Adds ``name``: the sorted distinct kept hashes of a text, each 16 hex digits."""
    w, n, s = f"{name}_w", f"{name}_n", f"{name}_s"
    rows = rows.withColumn(w, words(F.col(text))).withColumn(n, F.size(w))
    digest = lambda x: F.substring(F.md5(x.cast("binary")), 1, DIGITS)
    shingle = lambda i: digest(F.concat_ws(" ", *(F.get(w, i + k) for k in range(SHINGLE))))
    short = F.when(F.col(n) > 0, F.array(digest(F.array_join(w, " ")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(s, F.when(F.col(n) < SHINGLE, short).otherwise(windows(F.col(n), SHINGLE, shingle, "string"))).drop(w, n)
    return rows.withColumn(name, kept(F.col(s), scale)).drop(s)


def kept(hashes: Column, scale: int) -> Column:
    """The sketch of a set of hashes."""
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit(scale))))
    least = F.when(F.array_min(hashes).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.array_min(hashes)))
    return F.when(F.exists(hashes, lambda h: h < limit(scale)), low).otherwise(least)


def merged(sketches: DataFrame, by: str, sketch: str = "sketch", scale: int = SCALE) -> DataFrame:
    """The sketch of the union of all texts of a group, from their sketches alone."""
    each = sketches.select(F.col(by), F.explode(sketch).alias("h")).distinct()
    whole = each.groupBy(by).agg(F.collect_list("h").alias("h"))
    return whole.select(by, kept(F.col("h"), scale).alias(sketch))


def containment(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` found in ``outer``; of two empty sketches 1, of one empty sketch 0."""
    n = F.size(inner)
    return F.when(n > 0, F.size(F.array_intersect(inner, outer)) / n).when(F.size(outer) > 0, F.lit(0.0)).otherwise(F.lit(1.0))


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def followers(ids: DataFrame) -> DataFrame:
    """``doc_id, n, next`` of distinct ``doc_id, n``: the id that follows in descending order; after the last comes the first.

    Only ids and lengths are sorted: they are dealt out by range, each range is ordered by itself, and
    one row per range carries the step to the next range. No task sees more than a range.
    """
    n = shuffle_partitions(ids.sparkSession)
    dealt = ids.repartitionByRange(n, F.desc("doc_id")).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt)  # the ranges are drawn once
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    # One row for each range: at most the number of shuffle partitions.
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    top = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), top).alias("after"))
    inside = dealt.withColumn("lower", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    return inside.join(F.broadcast(heads), "part").select("doc_id", "n", F.coalesce("lower", "after").alias("next"))


def unpacked(packed: Column) -> Column:
    """The sketch from the bytes of its hashes."""
    size = DIGITS // 2
    one = lambda i: F.lower(F.hex(F.substring(packed, i * size + 1, F.lit(size))))
    return windows((F.length(packed) / size).cast("int"), 1, one, "string")


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per document: fingerprint, that of the edited text, and likenesses.

    In the edited text the last half of the code points makes way for as many of the next document's.
    ``near_edited`` and ``near_next`` are the share of the document's fingerprint found in that of the
    edited text and of the next document; ``jaccard_edited`` and ``jaccard_next`` are symmetric. A null text
    counts as empty. Rows with a null id are left out, since they have no place in the order; of a repeated
    id the row with the smallest md5 of its text stays. A single document follows itself. An empty table
    gives an empty result.

    Texts and sketches move once to be sorted by id, then the part of a text that goes into its
    predecessor's edited text moves there, with the sketch.
    """
    d = plain(docs, doc_id=doc_id, text=text).where(F.col("doc_id").isNotNull()).select("doc_id", text_of("text").alias("text"))
    d = d.withColumn("digest", F.md5(F.col("text").cast("binary")))
    ids = d.groupBy("doc_id").agg(F.min(F.struct("digest", F.char_length("text").alias("n"))).alias("m")).select("doc_id", "m.n")
    links = followers(ids)
    d = with_sketch(d, "text", "sketch", scale).withColumn("sketch", F.unhex(F.array_join("sketch", "")))
    before = F.lag("doc_id").over(Window.partitionBy("doc_id").orderBy("digest"))
    whole = d.withColumn("before", before).where(F.col("before").isNull()).drop("before", "digest")
    half = F.floor(F.col("n") / 2).cast("int")
    sent = whole.join(links.withColumnsRenamed({"doc_id": "to", "next": "doc_id"}), "doc_id")
    sent = sent.select(F.col("to").alias("doc_id"), "n", F.substring("text", F.lit(1), half).alias("tail"), F.col("sketch").alias("next_sketch"))
    pairs = whole.join(sent, "doc_id")
    pairs = pairs.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("n") - half), "tail")).drop("text", "tail")
    pairs = with_sketch(pairs, "edited_text", "changed", scale)
    pairs = pairs.withColumns({"own": unpacked(F.col("sketch")), "after": unpacked(F.col("next_sketch"))})
    own, changed, after = F.col("own"), F.col("changed"), F.col("after")
    return pairs.select(
        F.col("doc_id").alias(doc_id),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        F.array_join(own, "").alias("fingerprint"),
        F.array_join(changed, "").alias("edited_fingerprint"),
        containment(own, changed).alias("near_edited"),
        containment(own, after).alias("near_next"),
        resemblance(own, changed).alias("jaccard_edited"),
        resemblance(own, after).alias("jaccard_next"),
    )
