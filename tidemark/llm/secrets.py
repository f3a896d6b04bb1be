"""Secrets by patterns, and by automata whose grammar is inferred from the ones found.

The values that patterns find are labelled credentials. For each kind a prefix tree of a bounded sample of
them is built over classes of characters; states with statistically compatible futures are
merged (ALERGIA, by Hoeffding's bound), which leaves a small probabilistic automaton. Every other
long token of every text is then scored: its likelihood under the best automaton against that
under a model of ordinary tokens. Tokens well above are spans of the kind ``format``.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import documents, packed, slices, unpacked

#: The base patterns.
ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_DIGIT = re.compile(r"[0-9]")

#: Labelled credentials of each kind, and ordinary tokens, that the models are fitted on at most.
SAMPLE = 1500
#: Characters of a sampled value that are learned from.
LEARNED_LENGTH = 256
#: Nats by which the best automaton has to beat ordinary text: in all, and for each character.
MIN_GAIN, MIN_MEAN_GAIN = 12.0, 0.5
ALPHA = 0.05

_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
SYMBOL = {c: name for name, chars in _CLASSES.items() for c in chars} | {c: c for c in "+/_.=-"}
#: Log probability of a character within its class.
WITHIN = {c: -math.log(len(_CLASSES.get(s, s))) for c, s in SYMBOL.items()}
END = "$"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) by start; kinds do not see each other."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def value_of(text: str, span: tuple[int, int, int]) -> str:
    """The credential of a span: what is assigned, or all of it."""
    start, kind, end = span
    if kind == 0:
        match = ASSIGN.match(text, start)
        return match[1] if match else ""
    return text[start:end]


def other_tokens(text: str, taken: list[tuple[int, int, int]]):
    """Long tokens with a digit that touch no base span."""
    spans, at = sorted((s, e) for s, _, e in taken), 0
    reach = 0
    for m in TOKEN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start() and _DIGIT.search(m[0]):
            yield m


@dataclass
class Automaton:
    """Deterministic, with counts: of visits, of endings, and of each symbol taken."""

    visits: list[int] = field(default_factory=lambda: [0])
    edges: list[dict[str, tuple[int, int]]] = field(default_factory=lambda: [{}])  # symbol: (target, count)
    final: list[int] = field(default_factory=lambda: [0])

    def add(self, word: list[str]) -> None:
        state = 0
        self.visits[0] += 1
        for symbol in word:
            target, count = self.edges[state].get(symbol, (len(self.edges), 0))
            if not count:
                self.edges.append({})
                self.visits.append(0)
                self.final.append(0)
            self.edges[state][symbol] = (target, count + 1)
            state = target
            self.visits[state] += 1
        self.final[state] += 1

    def score(self, word: str) -> float:
        """Log likelihood of a token and its end; unseen steps keep a small share."""
        state, total = 0, 0.0
        for c in word:
            symbol = SYMBOL[c]
            target, count = self.edges[state].get(symbol, (0, 0))
            total += math.log((count + 0.05) / (self.visits[state] + 0.6)) + WITHIN[c]
            state = target
        return total + math.log((self.final[state] + 0.05) / (self.visits[state] + 0.6))


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(a: Automaton, one: int, two: int, bound: float) -> bool:
    """No step of the two states, nor of the states reached by the same steps, differs."""
    stack = [(one, two)]
    seen = set()
    while stack:
        p, q = stack.pop()
        if (p, q) in seen or not a.visits[p] or not a.visits[q]:
            continue
        seen.add((p, q))
        n1, n2 = a.visits[p], a.visits[q]
        if _differ(a.final[p], n1, a.final[q], n2, bound):
            return False
        for symbol in {*a.edges[p], *a.edges[q]}:
            t1, c1 = a.edges[p].get(symbol, (-1, 0))
            t2, c2 = a.edges[q].get(symbol, (-1, 0))
            if _differ(c1, n1, c2, n2, bound):
                return False
            if c1 and c2:
                stack.append((t1, t2))
    return True


def _fold(a: Automaton, red: int, blue: int) -> None:
    """Add the tree below ``blue`` to ``red`` and what it reaches."""
    stack = [(red, blue)]
    while stack:
        p, q = stack.pop()
        a.visits[p] += a.visits[q]
        a.final[p] += a.final[q]
        for symbol, (t2, c2) in a.edges[q].items():
            t1, c1 = a.edges[p].get(symbol, (t2, 0))
            a.edges[p][symbol] = (t1, c1 + c2)
            if c1:
                stack.append((t1, t2))


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """A probabilistic automaton of these words, merged from their prefix tree."""
    a = Automaton()
    for word in words:
        a.add([SYMBOL[c] for c in word])
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    reds = [0]
    while True:
        known = set(reds)
        blues = {t: (r, s) for r in reds for s, (t, _) in a.edges[r].items() if t not in known}
        if not blues:
            return _compact(a, reds)
        # The most visited first: it has the most evidence.
        blue = max(blues, key=lambda t: (a.visits[t], -t))
        parent, symbol = blues[blue]
        for red in reds:
            if _compatible(a, red, blue, bound):
                a.edges[parent][symbol] = (red, a.edges[parent][symbol][1])
                _fold(a, red, blue)
                break
        else:
            reds.append(blue)


def _compact(a: Automaton, reds: list[int]) -> Automaton:
    number = {state: i for i, state in enumerate(reds)}
    return Automaton(
        [a.visits[r] for r in reds],
        [{s: (number[t], c) for s, (t, c) in a.edges[r].items()} for r in reds],
        [a.final[r] for r in reds],
    )


@dataclass
class Ordinary:
    """Characters of ordinary tokens, each given the one before."""

    counts: dict[tuple[str, str], int] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)

    def add(self, word: str) -> None:
        for before, c in zip(END + word, word + END):
            self.counts[before, c] = self.counts.get((before, c), 0) + 1
            self.totals[before] = self.totals.get(before, 0) + 1

    def score(self, word: str) -> float:
        alphabet = len(SYMBOL) + 1
        return sum(
            math.log((self.counts.get((b, c), 0) + 0.5) / (self.totals.get(b, 0) + 0.5 * alphabet))
            for b, c in zip(END + word, word + END)
        )


@dataclass
class FormatModel:
    automata: list[Automaton]
    ordinary: Ordinary

    def gain(self, word: str) -> float:
        """Nats by which the best automaton beats ordinary text; minus infinity without automata."""
        if not self.automata:
            return -math.inf
        return max(a.score(word) for a in self.automata) - self.ordinary.score(word)

    def is_secret(self, word: str) -> bool:
        gain = self.gain(word)
        return gain >= MIN_GAIN and gain >= MIN_MEAN_GAIN * len(word)


def _labelled(sample: int):
    """Each task's smallest values by hash, of each kind; kind 3 are ordinary tokens."""

    def labelled(batches):
        least: dict[int, set] = {}

        def trim():
            for kind, values in least.items():
                if len(values) > sample:
                    least[kind] = set(heapq.nsmallest(sample, values))

        for part in slices(batches):
            for text in part.column("text").to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for span in spans:
                    value = value_of(text, span)[:LEARNED_LENGTH]
                    least.setdefault(span[1], set()).add((zlib.crc32(value.encode()), value))
                for m in other_tokens(text, spans):
                    value = m[0][:LEARNED_LENGTH]
                    least.setdefault(3, set()).add((zlib.crc32(value.encode()), value))
            trim()
        rows = [(kind, h, v) for kind, values in least.items() for h, v in values]
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([r[0] for r in rows], pa.int32()), "hash": pa.array([r[1] for r in rows], pa.int64()),
            "value": pa.array([r[2] for r in rows], pa.string()),
        })

    return labelled


def learn(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> FormatModel:
    """Automata of the credentials in all texts, from ``sample`` distinct values of each kind at most.

    The sample is the values with the smallest hashes, so it does not depend on how rows are dealt.
    """
    rows = documents(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text"))).select("text")
    values = rows.mapInArrow(_labelled(sample), "kind int, hash long, value string").distinct()
    chosen: dict[int, list[str]] = {}
    for kind in range(4):
        least = values.where(F.col("kind") == kind).orderBy("hash", "value").limit(sample)
        chosen[kind] = [r["value"] for r in least.select("value").collect()]  # at most ``sample`` short strings
    ordinary = Ordinary()
    for word in chosen[3]:
        ordinary.add(word)
    return FormatModel([infer(chosen[k]) for k in range(3) if chosen[k]], ordinary)


def _scan(model: FormatModel):
    def scan(batches):
        for part in slices(batches):
            spans = []
            for text in part.column("text").to_pylist():
                text = text or ""
                found = base_spans(text)
                found += [(m.start(), 3, m.end()) for m in other_tokens(text, found) if model.is_secret(m[0])]
                spans.append(sorted(found))
            columns = {name: part.column(name) for name in part.rows.schema.names}
            for number, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(s[1] == number for s in found) for found in spans], pa.int64())
            named = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in found] for found in spans]
            base = [",".join(n for n, s in zip(names, found) if s[1] < 3) for names, found in zip(named, spans)]
            columns["base_sha256"] = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
            columns["spans"] = pa.array([",".join(names) for names in named], pa.string())
            columns["redacted"] = pa.array(
                [_redact(t, found) for t, found in zip(part.column("text").to_pylist(), spans)], pa.string()
            )
            yield pa.RecordBatch.from_pydict(columns)

    return scan


MARK = "[SECRET]"


def _redact(text: str | None, spans) -> str | None:
    """The text with each maximal secret run replaced, null where nothing is."""
    if not spans:
        return None
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(
    docs: DataFrame, model: FormatModel | None = None, *, doc_id="doc_id", text="text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Spans of secrets of every whole text: counts by kind, base_sha256, spans, and redacted text.

    Positions are code points. A null text is an empty one and has no spans; ``redacted`` is null where there are
    none. Repeated rows each get their result. Without labelled credentials nothing is added to the
    base spans. Columns in ``keep`` are passed through, others dropped.
    """
    model = model or learn(docs, text=text)
    rows = documents(docs, *keep, doc_id=doc_id, text=text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return rows.mapInArrow(_scan(model), f"{fields}, {counts}, base_sha256 string, spans string, redacted string")


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """All documents and columns; secrets are replaced by a mark, ``n_chars`` set to the new length."""
    found = find_secrets(packed(docs, text=text), learn(docs, text=text), keep=("row",))
    left = found.withColumn("text", F.coalesce("redacted", "text"))
    changed = {}
    if n_chars:
        before = F.col("row").getField(n_chars)
        changed[n_chars] = F.when(F.col("redacted").isNull(), before).otherwise(F.length("text")).cast(docs.schema[n_chars].dataType)
    return unpacked(left, docs.columns, text=text, **changed)
