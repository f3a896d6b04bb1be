"""Personal data by patterns, checksums and context, in DataFrame functions only.

A pattern proposes spans; a checksum (Luhn for cards, mod 97 for bank accounts) confirms or drops them; words
just before a span add to its score. Base kinds always stay; the others need a score.

Patterns are written so that the regular-expression engine never goes back over a run: runs are
possessive, and a match begins where a run begins or where the match before ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a span in which context words count.
CONTEXT = 40
MIN_SCORE = 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score
    needs: str  # a cheap pattern or text without which there is no match
    base: bool = True


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass Luhn's check."""
    digits = F.reverse(_digits(value))
    each = F.transform(
        F.split(digits, "(?<=.)(?=.)"),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, is 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        number = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number) % 97

    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(_digits(value)).between(low, high)


def _octets(value: Column) -> Column:
    """Four parts of at most 255, however many zeros they begin with."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), 0.9, "mail|contact|write", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.7, "ip|host|server|address", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", lambda v: F.length(_digits(v)).between(13, 19) & luhn(v), 0.8, "card|visa|credit|payment", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _between(9, 15), 0.7, "phone|tel|call|mobile|fax", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod97, 0.9, "iban|account|bank|konto|compte|cuenta", "", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), 0.4, "ssn|social|security", "-", False),
    Kind("local_phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", lambda v: F.lit(True), 0.4, "phone|tel|call|mobile|fax", "", False),
)


def _positions(hits: Column, gaps: Column) -> Column:
    """(start, end, value) of each hit, from the lengths of the texts between and of the hits."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(F.get(hits, i))
        span = F.struct(begin.alias("start"), end.alias("end"), F.get(hits, i).alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda acc: acc["out"])


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_personal(docs: DataFrame, *, doc_id="doc_id", text="text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, text, counts by kind, ``found`` (kind, start, end, score) of every whole text, by kind, then start.

    Positions are code points, ends exclusive. A null text is an empty one and has no spans. Repeated
    rows each get their result; other columns are dropped.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    none = F.array().cast("array<string>")

    def proposed(kind: Kind) -> Column:
        hits = F.regexp_extract_all("_t", F.lit(kind.pattern), F.lit(0))
        return F.when(F.contains("_t", F.lit(kind.needs)), hits).otherwise(none) if kind.needs else hits

    hits = rows.select("*", *[proposed(k).alias(f"_h_{k.name}") for k in KINDS])
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def confirmed(kind: Kind) -> Callable[[Column], Column]:
        return lambda span: kind.valid(span["value"])

    placed = hits.select(
        "doc_id", "text", "_t",
        *[
            F.when(
                F.size(f"_h_{k.name}") > 0,
                F.filter(_positions(F.col(f"_h_{k.name}"), F.split("_t", k.pattern, -1)), confirmed(k)),
            ).otherwise(empty).alias(f"_p_{k.name}")
            for k in KINDS
        ],
    )

    def scored(kind: Kind) -> Column:
        def one(span: Column) -> Column:
            before = F.substring(
                F.col("_t"), F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))
            )
            near = F.lower(before).rlike(rf"\b({kind.context})")
            score = F.least(F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0), F.lit(1.0))
            return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), score.alias("score"))

        spans = F.transform(F.col(f"_p_{kind.name}"), one)
        spans = spans if kind.base else F.filter(spans, lambda s: s["score"] >= min_score)
        return F.when(F.size(f"_p_{kind.name}") > 0, spans).otherwise(F.array().cast(_SPAN))

    spans = placed.select("doc_id", "text", *[scored(k).alias(f"_s_{k.name}") for k in KINDS])
    return spans.select(
        "doc_id", "text", *[F.size(f"_s_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.concat(*[f"_s_{k.name}" for k in KINDS]).alias("found"),
    )


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*[k.name for k in KINDS if k.base]))
