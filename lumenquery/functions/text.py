"""Text as Column expressions: normalisers, grams, occurrence counts, overlaps, masks (FN-*, SET-06/07)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs that a normalised text keeps: Han characters, or ASCII letters and digits.
RUNS = "([一-鿿]+|[a-z0-9]+)"


def runs(c: Column) -> Column:
    """Lower-cased runs of Han characters or ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(RUNS), F.lit(1))


def norm(c: Column) -> Column:
    """FN-01: the runs, joined without a space: all other characters taken out."""
    return F.regexp_replace(F.lower(c), "[^一-鿿a-z0-9]+", "")


def norm_spaces(c: Column) -> Column:
    """FN-02: white space collapsed, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def norm_compact(c: Column) -> Column:
    """FN-02: no white space or punctuation, lower case."""
    return F.lower(F.regexp_replace(c, r"[\s.,;:!?()|\"'-]+", ""))


def grams(c: Column, k: int) -> Column:
    """FN-04: sorted distinct character k-grams; an empty look-ahead match at every place, so the text is passed through once."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))))


def gram_hash(c: Column) -> Column:
    """A 48-bit hash as 12 hexadecimal digits."""
    return F.substring(F.md5(c.cast("binary")), 1, 12)


def occurrences(c: Column, needle: str, cap: int | None = None) -> Column:
    """FN-06: non-overlapping occurrences, capped."""
    n = ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
    return n if cap is None else F.least(n, F.lit(cap))


def jaccard(a: Column, b: Column) -> Column:
    """SET-06: 0 when either is empty."""
    i = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(i / F.size(F.array_union(a, b)))


def coverage(needle: Column, hay: Column, needle_grams: Column, hay_grams: Column) -> Column:
    """SET-07: 1 on containment, else the share of the needle's grams that the other text has."""
    i = F.size(F.array_intersect(needle_grams, hay_grams))
    return F.when(F.contains(hay, needle) & (needle != ""), 1.0).otherwise(i / F.greatest(F.lit(1), F.size(needle_grams)))


def class_ratio(c: Column, chars: str) -> Column:
    """FN-11: characters of a class over those that aren't white space; 0 for none."""
    solid = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(solid == 0, 0.0).otherwise(F.length(F.regexp_replace(c, f"[^{chars}]", "")) / solid)


def first_line(c: Column) -> Column:
    return F.split(c, "\n", 2)[0]


def clean_title(c: Column) -> Column:
    """FN-08: without hashtags and mentions, a leading count, and runs of spaces."""
    c = F.regexp_replace(c, r"[#@][^ ]*", " ")
    c = F.regexp_replace(c, r"^[0-9]+ *", "")
    return F.trim(F.regexp_replace(c, r" +", " "))


def redact_urls(c: Column) -> Column:
    """FN-25."""
    return F.regexp_replace(c, r"https?://[^ \"'<>)]+", "[url]")


def shorten(c: Column, n: int) -> Column:
    """FN-25: at most n characters, the last an ellipsis if any were cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def replace_longest_first(c: Column, table: dict[str, str]) -> Column:
    """FN-09: dictionary replacements, longer keys first, then by key."""
    for key in sorted(table, key=lambda k: (-len(k), k)):
        c = F.replace(c, F.lit(key), F.lit(table[key]))
    return c


def clock(seconds: Column) -> Column:
    """FN-13: MM:SS."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


def srt_clock(millis: Column) -> Column:
    """FN-13: HH:MM:SS,mmm."""
    s = F.floor(millis / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"), (millis % 1000).cast("int"))


def short_id(prefix: str, c: Column, n: int = 16) -> Column:
    """FN-24: a prefix and n digits of a SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c.cast("binary"), 256), 1, n))


def contains_any(c: Column, terms: list[str]) -> Column:
    """FLT-02."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def keyword_hits(c: Column, terms: list[str]) -> Column:
    """FLT-02: sum of non-overlapping occurrences."""
    out = F.lit(0)
    for t in terms:
        out = out + occurrences(c, t)
    return out


def set_digest(row: Column) -> Column:
    """AGG-17: an aggregate that tells a multiset of rows, whatever their order: the SHA-256 of two sums over 60 bits of each row's MD5.

    Sums are added up before the shuffle, so a group moves as one row a task, however large it is.
    """
    part = lambda at: F.sum(F.conv(F.substring(F.md5(row.cast("binary")), at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(":", part(1), part(16)).cast("binary"), 256)


def set_digest_sql(row: str) -> str:
    part = lambda at: f"CAST(sum(CAST(CAST('0x' || substr(md5({row}), {at}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
    return f"sha256({part(1)} || ':' || {part(16)})"
