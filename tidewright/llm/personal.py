"""Personal data: patterns propose spans, check digits confirm them, words nearby raise or lower the score.

The base kinds (email, ip, card, phone) follow fixed patterns and tests and are always reported. Further
kinds are reported if their score reaches ``threshold``: a pattern gives a first score, a passed check sum
adds to it, a failed one removes the span, and words of the kind's context within ``CONTEXT`` characters
before the span (or half as many after it) add to it once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import per_text
from .text import plain

CONTEXT = 40
THRESHOLD = 0.8


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled; the sum of all digits is a multiple of ten."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def mod97(code: str) -> bool:
    """The account number check: first four characters to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def only_digits(span: str) -> str:
    return "".join(c for c in span if c in "0123456789")


def is_ip(span: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in span.split("."))


def is_card(span: str) -> bool:
    digits = only_digits(span)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(span: str) -> bool:
    return 9 <= len(only_digits(span)) <= 15


def is_account(span: str) -> bool:
    code = span.replace(" ", "")
    return 15 <= len(code) <= 34 and mod97(code)


def is_social(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    """A kind of span: what a text must hold for it, its pattern, its test, and for further kinds the
    first score, what a passed test adds, and the words that add 0.3."""

    name: str
    needs: str
    pattern: str
    test: Callable[[str], bool]
    score: float = 1.0
    passed: float = 0.0
    context: tuple[str, ...] = ()


# Patterns and order of the base kinds.
BASE = (
    Kind("email", "@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda span: True),
    Kind("ip", ".", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", is_ip),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])+", is_card),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone),
)
FURTHER = (
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", is_account, 0.4, 0.5, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", is_social, 0.4, 0.2, ("ssn", "social", "security", "taxpayer")),
)
KINDS = BASE + FURTHER
#: Only ASCII digits count as such; a text without them can have nothing but emails.
DIGIT = re.compile("[0-9]")
#: An email is looked for in runs without other characters, so a long run without @ is passed once.
PATTERNS = {k.name: re.compile(k.pattern) for k in KINDS}
#: The same matches as the pattern of addresses gives: they begin where a run of digits begins and take whole runs.
PATTERNS["ip"] = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
WORD = re.compile(r"[^\W\d_]+")


def near(text: str, start: int, end: int, words: tuple[str, ...]) -> bool:
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT // 2]
    return not set(words).isdisjoint(WORD.findall(around.lower()))


EMAIL_BODY = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
NAME_END = re.compile(r"[^A-Za-z0-9._%+-]")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the email pattern, found from their @; the same as a search from the left, in linear time."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and not NAME_END.match(text[start - 1]):
            start -= 1
        body = EMAIL_BODY.match(text, at) if start < at else None
        if body:
            found.append((start, body.end()))
            after = body.end()
        at = text.find("@", max(at + 1, after))
    return found


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """``start, end, kind, score`` of all spans, by start, then in the order of the kinds."""
    found: list[tuple[int, int, int, float]] = []
    digits = DIGIT.search(text) is not None
    for number, kind in enumerate(KINDS):
        if kind.name == "email":
            found.extend((a, b, number, 1.0) for a, b in emails(text))
            continue
        if not digits or kind.needs not in text:
            continue
        for m in PATTERNS[kind.name].finditer(text):
            start, end = m.span()
            if not kind.test(m[0]):
                # A word after an account number may look like its last group.
                end = text.rfind(" ", start, end) if kind.name == "iban" else -1
                if end < 0 or not kind.test(text[start:end]):
                    continue
            score = kind.score + kind.passed
            if kind.context:
                score += 0.3 * near(text, start, end, kind.context)
            if number < len(BASE) or score >= threshold:
                found.append((start, end, number, min(score, 1.0)))
    return [(a, b, KINDS[n].name, s) for a, b, n, s in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def joined(found: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in found)


def _report(threshold: float):
    names = [k.name for k in BASE]

    def work(text: str) -> tuple:
        found = spans(text, threshold)
        base = [x for x in found if x[2] in names]
        counts = [sum(x[2] == n for x in base) for n in names]
        return (*counts, sha256(joined(base).encode()).hexdigest(), joined(found), min((x[3] for x in found), default=None))

    return work


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, all spans, the lowest score.

    Places are code points, the end exclusive. A null text counts as empty: no spans, and a null score.
    Repeated rows give repeated results, an empty table an empty one; other columns aren't read.
    """
    columns = {"n_email": "int64", "n_ip": "int64", "n_card": "int64", "n_phone": "int64", "base_sha256": "string", "spans": "string", "lowest_score": "double"}
    return per_text(plain(docs, doc_id=doc_id, text=text), partial(_report, threshold), columns).withColumnRenamed("doc_id", doc_id)


def masked(text: str, threshold: float = THRESHOLD) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    parts, at, open_kind = [], 0, ""
    for a, b, kind, _ in spans(text, threshold):
        if open_kind and a < at:
            at = max(at, b)
            continue
        if open_kind:
            parts.append(f"<{open_kind}>")
        parts.append(text[at:a])
        at, open_kind = b, kind
    return "".join([*parts, f"<{open_kind}>" if open_kind else "", text[at:]])


def mask(docs: DataFrame, text: str = "text", length: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, personal data in the text replaced; a null text stays null, ``length`` is counted anew."""

    @F.pandas_udf("string")
    def change(texts):
        return texts.map(lambda t: None if t is None else masked(t, threshold))

    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), change(F.col(f"`{text}`")).alias("masked"))
    made: dict[str, Column] = {text: F.col("masked")}
    if length in columns:
        made[length] = F.char_length("masked").cast(docs.schema[length].dataType)
    return packed.select(*(made.get(c, F.col("row")[c]).alias(c) for c in columns))
