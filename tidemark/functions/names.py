"""Index names: wildcards, system names, date suffixes and per-index settings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name prefixes of tables that belong to the store itself.
SYSTEM_PREFIXES = (".", "security-auditlog-", "top_queries-")
WILDCARD_CHARS = "*?[]"
DATE_SUFFIX = r"([0-9]{4})[.\-]([0-9]{2})[.\-]([0-9]{2})\z"

# One wildcard token: an escaped character, a bracket class, or any other single character.
_CLASS_CHAR = r"(?:\\[\s\S]|[^\\\-\]])"
_CLASS_ITEM = rf"{_CLASS_CHAR}(?:-{_CLASS_CHAR})?"
_TOKEN = rf"\\[\s\S]|\[\^?(?:{_CLASS_ITEM})+\]|[^\\\[]"
NEVER = r"[^\s\S]"
ANYTHING = r"[\s\S]"


def has_wildcard(name: str) -> bool:
    return any(c in name for c in WILDCARD_CHARS)


def _class_regex(token: str) -> str:
    negated = token.startswith("[^")
    items = []
    for item in re.findall(_CLASS_ITEM, token[2:-1] if negated else token[1:-1]):
        ends = re.findall(_CLASS_CHAR, item)
        low, high = ends[0][-1], ends[-1][-1]
        if len(ends) == 2 and low > high:
            continue  # an empty range matches nothing
        items.append("-".join(f"\\x{{{ord(c):x}}}" for c in ([low, high] if len(ends) == 2 else [low])))
    if not items:
        return ANYTHING if negated else NEVER
    return "[" + ("^" if negated else "") + "".join(items) + "]"


def wildcard_regex(pattern: str) -> str:
    """Anchored Java regular expression of a wildcard; a malformed wildcard matches nothing."""
    tokens = re.findall(_TOKEN, pattern)
    if "".join(tokens) != pattern:
        return NEVER
    out = []
    for token in tokens:
        if token == "*":
            out.append("[^/]*")
        elif token == "?":
            out.append("[^/]")
        elif token.startswith("["):
            out.append(_class_regex(token))
        else:
            out.append(f"\\x{{{ord(token[-1]):x}}}")
    return r"\A" + "".join(out) + r"\z"


def matches_wildcard(name: Column, pattern: str) -> Column:
    return F.rlike(name, F.lit(wildcard_regex(pattern)))


def wildcard_regex_column(pattern: Column) -> Column:
    """``wildcard_regex`` for patterns that are data, as column expressions."""
    tokens = F.regexp_extract_all(pattern, F.lit(f"({_TOKEN})"), 1)

    def code(char: Column) -> Column:
        return F.concat(F.lit("\\x{"), F.lower(F.hex(_code_point(char))), F.lit("}"))

    def class_item(item: Column) -> Column:
        ends = F.transform(
            F.regexp_extract_all(item, F.lit(f"({_CLASS_CHAR})"), 1), lambda end: F.right(end, F.lit(1))
        )
        low, high = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when(F.size(ends) == 1, code(low)).when(
            _code_point(low) <= _code_point(high), F.concat(code(low), F.lit("-"), code(high))
        )

    def class_regex(token: Column) -> Column:
        negated = token.startswith("[^")
        inner = F.regexp_replace(token, r"^\[\^?|\]$", "")
        items = F.filter(
            F.transform(F.regexp_extract_all(inner, F.lit(f"({_CLASS_ITEM})"), 1), class_item), lambda x: x.isNotNull()
        )
        body = F.array_join(items, "")
        return (
            F.when((F.size(items) == 0) & negated, F.lit(ANYTHING))
            .when(F.size(items) == 0, F.lit(NEVER))
            .otherwise(F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), body, F.lit("]")))
        )

    def piece(token: Column) -> Column:
        return (
            F.when(token == "*", F.lit("[^/]*"))
            .when(token == "?", F.lit("[^/]"))
            .when(token.startswith("[") & (F.length(token) > 1), class_regex(token))
            .otherwise(code(F.right(token, F.lit(1))))
        )

    whole = F.concat(F.lit(r"\A"), F.array_join(F.transform(tokens, piece), ""), F.lit(r"\z"))
    return F.when(F.array_join(tokens, "") == pattern, whole).otherwise(F.lit(NEVER))


def _code_point(char: Column) -> Column:
    """Unicode code point; the UTF-32 form of one character is its four-byte code."""
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("bigint")


def is_wildcard_column(name: Column) -> Column:
    return F.rlike(name, F.lit(r"[*?\[\]]"))


def literal_prefix(pattern: Column) -> Column:
    """Text before the first wildcard or escape character."""
    return F.regexp_extract(pattern, r"\A[^*?\[\]\\]*", 0)


def is_system_name(name: Column) -> Column:
    """Tables of the store itself, which a wildcard never selects in the hot tier."""
    hit = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        hit = hit | name.startswith(prefix)
    return hit


def select_names(name: Column, patterns: Sequence[str], hide_system: bool = False) -> Column:
    """Predicate for a list of names and wildcards, on the partition column a partition filter."""
    cleaned = [p.strip() for p in patterns if p.strip()]
    plain = [p for p in cleaned if not has_wildcard(p)]
    test = name.isin(plain) if plain else F.lit(False)
    for pattern in (p for p in cleaned if has_wildcard(p)):
        match = matches_wildcard(name, pattern)
        test = test | (match & ~is_system_name(name) if hide_system else match)
    return test


def split_names(text: str) -> list[str]:
    """Comma list of names, trimmed, blanks dropped."""
    return [p.strip() for p in text.split(",") if p.strip()]


def split_names_column(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda n: F.trim(n)), lambda n: n != "")


def index_date(name: Column) -> Column:
    """Date at the end of a name (``logs-2026.02.08``), null when absent or not a date."""
    year, month, day = (F.regexp_extract(name, DATE_SUFFIX, g) for g in (1, 2, 3))
    return F.concat_ws("-", year, month, day).try_cast("date")


def daily_name(prefix: str, ts: Column) -> Column:
    """Name of the daily table a row belongs to."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyy.MM.dd"))


def ripe_name(name: Column, now: datetime, migrate_after_days: int) -> Column:
    """Keep names whose date is before the cutoff day, or that carry no date."""
    cutoff_day = (now - timedelta(days=migrate_after_days)).date()
    day = index_date(name)
    return day.isNull() | (day < F.lit(cutoff_day))


def per_index(name: Column, exact: Mapping[str, object], default: object) -> Column:
    """Exact-name override with a default."""
    if not exact:
        return F.lit(default)
    entries = [F.lit(x) for pair in exact.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), name), F.lit(default))


def cold_days(name: Column, rules: Mapping[str, int], default: int) -> Column:
    """Days a table is kept in the cold tier: exact name, else the longest matching wildcard, else the default.

    Zero means for ever. Of equally long wildcards the first by name wins.
    """
    chain = None
    for pattern in sorted((p for p in rules if has_wildcard(p)), key=lambda p: (-len(p), p)):
        test, days = matches_wildcard(name, pattern), F.lit(rules[pattern])
        chain = F.when(test, days) if chain is None else chain.when(test, days)
    fallback = F.lit(default) if chain is None else chain.otherwise(F.lit(default))
    exact = [F.lit(x) for pair in rules.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*exact), name), fallback) if exact else fallback
