"""Scalar text functions: normal forms, tokens, spans, cleaners."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends (all of Unicode's, not blanks alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def alnum(c: Column) -> Column:
    """Letters and digits of the folded text."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}]", "")


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct ASCII words of the folded text of at least so many characters."""
    return F.array_distinct(F.filter(F.split(folded(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def cut(text: Column, start: Column, end: Column) -> Column:
    """The code points [start, end)."""
    return F.substring(text, start + 1, end - start)


def find_ignoring_case(text: Column, term: Column) -> tuple[Column, Column]:
    """Span of the first occurrence; without one, [0, length of the term)."""
    at = F.call_function("locate", F.lower(term), F.lower(text))
    start = F.when(at > 0, at - 1).otherwise(0)
    return start, start + F.length(term)


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence (between . ! ?) that holds a span, stripped."""
    head = F.regexp_extract(F.substring(text, F.lit(1), start), r"([^.!?]*)$", 1)
    tail = F.regexp_extract(F.substring(text, start + 1, F.length(text)), r"^([^.!?]*[.!?]?)", 1)
    return strip(F.concat(head, tail))


def _chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


#: The cleaners' rules, in their order.
LABEL_RULES = [(" +", " "), (" ([.,;:!?)])", "$1"), (r"(\() ", "$1"), (" +\n", "\n"), ("\n+", "\n")]
NOTE_RULES = [
    ("_{3,}", ""), (r"(?U)\b___\b", ""), (r"(?U)\b__\b", ""), (r"(?U)\b_\b", ""), (r"[ \t]+", " "), (" +\n", "\n"), ("\n{3,}", "\n\n"), (" +([.,;:!?)])", "$1"),
    (r"(\() +", "$1"), (r" +(\))", "$1"), (r"(?U)(\w) +:", "$1:"), (" +- +", " - "), (" +/ +", "/"), ("  +", " "), ("\n +", "\n"), (" +\n", "\n"),
]
REPORT_RULES = [(r"[ \t]+", " "), (" +\n", "\n"), ("\n+", "\n"), (" +([.,;:!?)])", "$1"), (r"(\() +", "$1"), ("_{3,}", "___")]


def clean_label(c: Column) -> Column:
    """Drug-label text: blanks, blanks at marks and brackets, ends of lines, empty lines. Not stripped."""
    return _chain(c, LABEL_RULES)


def clean_note(c: Column) -> Column:
    """Clinical notes: redactions go, then blanks, lines, marks, colons, dashes and slashes."""
    return strip(_chain(c, NOTE_RULES))


def clean_report(c: Column) -> Column:
    """Reports: without a first line that holds a header's bars, then blanks, lines and marks; long redactions are shortened."""
    first = F.substring_index(c, "\n", 1)
    body = F.when(first.contains("||||"), F.substring(c, F.length(first) + 2, F.length(c))).otherwise(c)
    return strip(_chain(body, REPORT_RULES))


def offset_map(before: Column, after: Column, look: int = 10) -> Column:
    """Of each place of a text the place it comes to in its cleaned form, as an array.

    A greedy walk: equal symbols go together; otherwise the nearer of the next places, up
    to `look` ahead in the original, that meets the cleaned text's symbol is taken. What was removed
    gets the place where the cleaned text stands. A null text gives null.
    """

    @F.pandas_udf("array<int>")
    def walked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _walk(a, b, look) for a, b in zip(x, y, strict=True)])

    return walked(before, after)


def _walk(before: str, after: str, look: int) -> list[int]:
    out, at, k = [], 0, 0
    while k < len(before):
        if at < len(after) and before[k] != after[at]:
            ahead = before.find(after[at], k + 1, k + 1 + look)
            skip = ahead - k if ahead > 0 else 1
            out += [at] * skip
            k += skip
            continue
        out.append(min(at, len(after)))
        at, k = min(at + 1, len(after)), k + 1
    return out


def moved_offset(text: Column, offset: Column, cleaner) -> Column:
    """Where an offset of a text comes to lie after cleaning: the length of what stands before it, cleaned."""
    return F.length(cleaner(F.substring(text, F.lit(1), offset)))


def relocated(clean: Column, mention: Column, guess: Column, near: int = 50) -> Column:
    """Start of a mention in a cleaned text: within `near` of a guess, else anywhere, else -1."""
    low = F.greatest(guess - near, F.lit(0))
    window = F.substring(clean, low + 1, F.length(mention) + 2 * near)
    at = F.call_function("locate", mention, window)
    anywhere = F.call_function("locate", mention, clean)
    return F.when(at > 0, low + at - 1).when(anywhere > 0, anywhere - 1).otherwise(-1)


def offset_parts(starts: Column, lengths: Column) -> Column:
    """Parts (start, length) of a discontinuous mention from two comma lists."""
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))
    return F.transform(F.arrays_zip(numbers(starts).alias("s"), numbers(lengths).alias("l")), lambda p: F.struct(p["s"].alias("start"), p["l"].alias("length")))


def join_parts(text: Column, parts: Column, between: str = "") -> Column:
    """The text of a mention's parts."""
    return F.array_join(F.transform(parts, lambda p: F.substring(text, p["start"] + 1, p["length"])), between)


def uri_tail(c: Column) -> Column:
    """The last segment of a URI, without query and closing slash."""
    return F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]+)/?$", 1)
