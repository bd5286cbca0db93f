"""Quality rules: counts within a text, and how often its lines occur across the documents of a host.

Lines are normalised (lower case, runs of white space as one space, and runs of digits as 0 where letters
outnumber digits, so rows of numbers stay different) and hashed. For every host the distinct documents with
a line are counted; copies of one text count once. A line above the limit is removed, and a document that
would lose too many words is rejected. But every frequent line has one holder, the text with the smallest
digest, and a document that would be depleted loses only the lines that others hold: of a group of near
copies one stays. All of it is DataFrame functions. Documents are first reduced to hashes of lines, one array per distinct text of a
host, with partial aggregation; the count of a line combines map-side too. What is joined back are
hashes, never texts, and Spark splits a join key that is very common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, plain, text_of, windows, words


@dataclass(frozen=True)
class Limits:
    """``max_documents``: a line that is in more distinct documents of its host is removed.
    ``share_percent``: if given, only lines in more than this share of the host's documents are. ``min_words`` and ``repeat_percent``: the base rule. ``depleted_percent``: a
    document is rejected if more than this share of its words is in removed lines."""

    max_documents: int = 10
    share_percent: int | None = None
    min_words: int = 50
    repeat_percent: int = 50
    depleted_percent: int = 50


def normal_line(line: Column) -> Column:
    digits = F.char_length(F.regexp_replace(line, "[^0-9]", ""))
    worded = F.char_length(F.regexp_replace(line, "[^\\p{L}]", "")) > digits
    folded = F.when(line.rlike("[0-9]") & worded, F.regexp_replace(F.lower(line), "[0-9]+", "0")).otherwise(F.lower(line))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def holder(digest: str | Column) -> Column:
    """The number by which one text of a host is chosen to keep a frequent line."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def statistics(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    d = docs.select(*keep, text_of(text).alias("t")).withColumn("w", words(F.col("t")))
    d = d.withColumn("n", F.size("w")).withColumn("lines", F.filter(F.split("t", "\n"), has_word))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # Hash and place of every three-word window, equal ones side by side.
    at = lambda i: F.struct(F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("g"), i.alias("i"))
    d = d.withColumn("win", F.sort_array(windows(F.col("n"), 3, at, "struct<g:bigint,i:int>")))
    same = lambda k, g: F.coalesce(F.get("win", k)["g"] == g, F.lit(False))
    starts = F.transform("win", lambda x, k: F.when(((k > 0) & same(F.greatest(k - 1, F.lit(0)), x["g"])) | same(k + 1, x["g"]), x["i"]))
    d = d.withColumn("starts", F.sort_array(F.filter(starts, lambda x: x.isNotNull())))
    # A window covers three words, or fewer if the next one begins before its end.
    covered = F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3))))
    return d.select(
        *keep,
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def text_lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """``host, digest, lines``: hash and number of words of each line with a word, once for each distinct text of a host."""
    d = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_of(text).alias("t"))
    line = lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words(x)).alias("w"))
    d = d.select("host", F.md5(F.col("t").cast("binary")).alias("digest"), F.transform(F.filter(F.split("t", "\n"), has_word), line).alias("lines"))
    return d.groupBy("host", "digest").agg(F.first("lines").alias("lines"))


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """``host, h, holder`` of the lines above the limits, with the text that keeps the line."""
    each = lines.select("host", holder("digest").alias("holder"), F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    counted = each.groupBy("host", "h").agg(F.count("*").alias("n_documents"), F.min("holder").alias("holder")).where(F.col("n_documents") > limits.max_documents)
    if limits.share_percent is not None:
        hosts = lines.groupBy("host").agg(F.count("*").alias("n_host"))
        counted = counted.join(hosts, "host").where(F.col("n_documents") * 100 > F.col("n_host") * limits.share_percent)
    return counted.select("host", "h", "holder")


def removals(docs: DataFrame, host: str, text: str, limits: Limits) -> DataFrame:
    """For each text with frequent lines ``host, digest`` and the words and hashes of all of them (``all_words, all_lines``)
    and of those that others hold (``foreign_words, foreign_lines``)."""
    lines = text_lines(docs, host, text)
    each = lines.select("host", "digest", F.explode("lines").alias("line")).select("host", "digest", "line.h", "line.w")
    hit = each.join(frequent_lines(lines, limits), ["host", "h"])
    foreign = holder("digest") != F.col("holder")
    return hit.groupBy("host", "digest").agg(
        F.sum("w").alias("all_words"), F.collect_set("h").alias("all_lines"),
        F.sum(F.when(foreign, F.col("w")).otherwise(0)).alias("foreign_words"), F.collect_set(F.when(foreign, F.col("h"))).alias("foreign_lines"),
    )


def with_removals(docs: DataFrame, host: str, text: str, limits: Limits) -> DataFrame:
    """The documents with the columns of ``removals`` (null without a frequent line), joined on host and text."""
    found = removals(docs, host, text, limits)
    keyed = docs.withColumns({"_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_digest": F.md5(text_of(text).cast("binary"))})
    found = found.withColumnsRenamed({"host": "_host", "digest": "_digest"})
    return keyed.join(found, ["_host", "_digest"], "left").drop("_host", "_digest")


def depleting(limits: Limits) -> Column:
    """Whether a document would lose too many words with all its frequent lines."""
    return F.coalesce(F.col("all_words") * 100 > F.col("n_words") * limits.depleted_percent, F.lit(False))


def removed_words(limits: Limits) -> Column:
    return F.coalesce(F.when(depleting(limits), F.col("foreign_words")).otherwise(F.col("all_words")), F.lit(0)).cast("long")


def verdict(limits: Limits) -> tuple[Column, Column]:
    """Of rows with the counts and ``removed_words``: whether the base rule fails, and whether the document is kept."""
    n = F.col("n_words")
    failed = (n < limits.min_words) | (F.col("n_repeat_words") * 100 > n * limits.repeat_percent)
    depleted = F.col("removed_words") * 100 > n * limits.depleted_percent
    return failed, ~failed & ~depleted


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row per document: its counts, ``removed_words``, ``base_failed`` and ``kept``.

    A null text counts as empty (no words: fails), a null host as the empty host. Repeated rows and
    copies of a text get equal results; copies are one document when lines are counted. An empty
    table gives an empty result. Only the three named columns are read.
    """
    d = plain(docs, doc_id=doc_id, text=text, host=host)
    d = d.withColumn("digest", F.md5(text_of("text").cast("binary"))).withColumn("host_key", F.coalesce(F.col("host").cast("string"), F.lit("")))
    counts = statistics(d, "text", "doc_id", "host_key", "digest")
    found = removals(plain(docs, text=text, host=host), "host", "text", limits)
    joined = counts.join(found.select(F.col("host").alias("host_key"), "digest", "all_words", "foreign_words"), ["host_key", "digest"], "left")
    joined = joined.withColumn("removed_words", removed_words(limits))
    failed, kept = verdict(limits)
    return joined.select(
        F.col("doc_id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", failed.alias("base_failed"), kept.alias("kept")
    )


def clean(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits(), length: str | None = "n_chars") -> DataFrame:
    """The documents that stay, without their frequent lines; other columns as they are, ``length`` counted anew.

    The rules are those of ``judge``. The row itself is joined on host and text, so repeated rows and
    null ids are no special case.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text}`").alias("t"), F.col(f"`{host}`").alias("hst"))
    marked = with_removals(packed, "hst", "t", limits)
    counted = statistics(marked, "t", "row", "all_words", "all_lines", "foreign_words", "foreign_lines").withColumns(
        {"removed_words": removed_words(limits), "removed": F.when(depleting(limits), F.col("foreign_lines")).otherwise(F.col("all_lines"))}
    )
    # The partition number keeps the optimizer from copying the counts into a filter on the scan, once for each use.
    stay = counted.withColumn("stay", verdict(limits)[1] & (F.spark_partition_id() >= 0)).where("stay")
    left = F.filter(F.split(F.col("row")[text], "\n"), lambda x: ~(has_word(x) & F.array_contains("removed", F.xxhash64(normal_line(x)))))
    shorter = F.when(F.col("removed").isNull(), F.col("row")[text]).otherwise(F.array_join(left, "\n"))
    out = stay.select("row", shorter.alias("shorter"))
    made = {text: F.col("shorter")} | ({length: F.char_length("shorter").cast(docs.schema[length].dataType)} if length in columns else {})
    return out.select(*(made.get(c, F.col("row")[c]).alias(c) for c in columns))
