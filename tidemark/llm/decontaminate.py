"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over word numbers of the normalised items. Training words are
streamed through it with the length of the longest match that ends at each word; a word
that no item has resets it, so only runs of known words have to be walked, each of which
is found with array operations.

Items are taken in blocks of a bounded number of words. Each block is one automaton, sent to
the executors, and one step in a single pass over the documents; the text is neither
shuffled nor read again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import documents, lower_ascii, merged_spans, packed, slices, unpacked, word_hashes, words

WINDOW = 10
#: Words of items in one automaton, which bounds what is collected and broadcast at a time.
BLOCK_WORDS = 1_000_000

#: Bytes of words: digits, letters in lower case, and all bytes of characters beyond ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def item_words(text: str | None) -> list[bytes]:
    data = lower_ascii(np.frombuffer((text or "").encode(), dtype=np.uint8))
    begin, end, _ = words(data, np.zeros(1, np.int64), np.array([len(data)]), WORD_BYTES)
    raw = data.tobytes()
    return [raw[b:e] for b, e in zip(begin.tolist(), end.tolist())]


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with the windows each state ends."""

    window: int
    vocabulary: np.ndarray = None  # sorted hashes; the number of a word is its place
    edges: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    shortest: int = 0
    #: By state: (length of the window, its items) for windows that are in this state.
    ends: dict[int, list[tuple[int, tuple]]] = field(default_factory=dict)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state for the words of p and then this one, cut from its longer state if need be."""
        q = self.edges[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = clone
        while p >= 0 and self.edges[p].get(word) == q:
            self.edges[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, last: int, word: int) -> int:
        """The state after one more word of an item."""
        if word in self.edges[last]:
            return self._split(last, word)
        state, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.edges[p]:
            self.edges[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word)
        return state

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """Longest suffix of what was read that occurs in an item, and its length."""
        while state and word not in self.edges[state]:
            state = self.link[state]
            matched = self.length[state]
        if word in self.edges[state]:
            return self.edges[state][word], matched + 1
        return 0, 0


def build_automaton(items: list[tuple[object, str | None]], window: int = WINDOW) -> Automaton:
    """Items that share an item_id count as one item; items without words have no window."""
    split = [(item, item_words(text)) for item, text in items]
    distinct = sorted({w for _, found in split for w in found})
    raw = np.frombuffer(b"".join(distinct), dtype=np.uint8)
    end = np.cumsum(np.array([len(w) for w in distinct], dtype=np.int64))
    begin = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
    hashes = word_hashes(raw, begin, end)
    machine = Automaton(window, np.sort(hashes))
    number = dict(zip(distinct, np.searchsorted(machine.vocabulary, hashes).tolist()))
    coded = [(item, [number[w] for w in found]) for item, found in split if found]
    for _, found in coded:
        state = 0
        for word in found:
            state = machine.add(state, word)
    owners: dict[tuple[int, int], set] = {}
    for item, found in coded:
        size, state, matched = min(window, len(found)), 0, 0
        for i, word in enumerate(found):
            state, matched = machine.step(state, matched, word)
            if i + 1 < size:
                continue
            at = state
            while machine.length[machine.link[at]] >= size:
                at = machine.link[at]
            owners.setdefault((at, size), set()).add(item)
    for (state, size), owned in owners.items():
        machine.ends.setdefault(state, []).append((size, tuple(owned)))
    machine.shortest = min((size for _, size in owners), default=0)
    return machine


def stream_words(machine: Automaton, numbers: list[int], spans: list[int], items: set) -> None:
    """Walk a run of known words; add the windows found, as (first, one past last) word."""
    state = matched = 0
    edges, length, link, ends = machine.edges, machine.length, machine.link, machine.ends
    for i, word in enumerate(numbers):
        state, matched = machine.step(state, matched, word)
        at, cap = state, matched
        while at > 0 and cap >= machine.shortest:
            for size, owned in ends.get(at, ()):
                if size <= cap:
                    spans.extend((i + 1 - size, i + 1))
                    items.update(owned)
            at = link[at]
            cap = length[at]


def _scan(machine: Automaton, last: bool):
    """One block's step: words hit and items found are added to those of earlier blocks."""

    def scan(batches):
        for part in slices(batches):
            data = lower_ascii(part.data)
            begin, end, doc = words(data, part.starts, part.ends, WORD_BYTES)
            hashed = word_hashes(data, begin, end)
            place = np.searchsorted(machine.vocabulary, hashed)
            place[place == len(machine.vocabulary)] = 0
            known = machine.vocabulary[place] == hashed if len(machine.vocabulary) else np.zeros(len(hashed), bool)
            count = len(part.starts)
            n_words = np.bincount(doc, minlength=count)
            first_word = np.cumsum(n_words) - n_words
            # Runs of known words in one document, long enough to hold a window.
            broken = np.ones(len(known) + 1, dtype=bool)
            broken[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(broken)
            run, until = at[:-1], at[1:]
            good = known[run] & (until - run >= max(1, machine.shortest)) if len(run) else np.zeros(0, bool)
            if not machine.shortest:
                good[:] = False
            found: dict[int, tuple[list, set]] = {}
            for b, e in zip(run[good].tolist(), until[good].tolist()):
                d = int(doc[b])
                spans, items = found.setdefault(d, ([], set()))
                offset, near = b - int(first_word[d]), []
                stream_words(machine, place[b:e].tolist(), near, items)
                spans.extend(x + offset for x in near)
            spans, items = part.column("hit_spans").to_pylist(), part.column("hit_items").to_pylist()
            for d, (near, owned) in found.items():
                if near:
                    b, e = np.array(spans[d][0::2] + near[0::2]), np.array(spans[d][1::2] + near[1::2])
                    spans[d] = np.stack(merged_spans(b, e), 1).ravel().tolist()
                    items[d] = sorted({*items[d], *owned})
            columns = {name: part.column(name) for name in part.rows.schema.names}
            columns["n_words"] = pa.array(n_words, pa.int64())
            columns["hit_spans"] = pa.array(spans, pa.list_(pa.int64()))
            columns["hit_items"] = pa.array(items, pa.list_(columns["hit_items"].type.value_type))
            if last:
                columns["removed"] = pa.array(
                    [_removal(data, part, begin, first_word, n_words, d, s) for d, s in enumerate(spans)],
                    pa.list_(pa.int64()),
                )
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def _removal(data, part, begin, first_word, n_words, d, spans) -> list[int]:
    """Hit words as spans of code points of the text, each up to the next word that stays."""
    if not spans:
        return []
    lead = np.cumsum((data[part.starts[d] : part.ends[d]] & 0xC0) != 0x80)
    place = np.concatenate([[0], lead])
    out = []
    for b, e in zip(spans[0::2], spans[1::2]):
        start = begin[first_word[d] + b] - part.starts[d]
        stop = begin[first_word[d] + e] - part.starts[d] if e < n_words[d] else part.ends[d] - part.starts[d]
        out += [int(place[start]), int(place[stop])]
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """Items by blocks of a bounded number of words; an item stays in one block."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    size = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # A word and its separator are two characters at least.
    blocks = max(1, -(-int(size) // (2 * block_words)))
    for block in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in chosen.toLocalIterator()]


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: n_words, hit_spans (word numbers), hit_items, removed (code points), and text.

    A null or empty text, or one without words, has no words and no hits. Repeated rows each get
    their result. Items without words (null too) have no window; an empty benchmark hits nothing.
    Null item_ids are items like any other, but are left out of ``hit_items``. Columns named in
    ``keep`` are passed through; other columns are dropped.
    """
    kind = benchmark.schema[item_id].dataType.simpleString()
    found = documents(docs, *keep, doc_id=doc_id, text=text).select(
        "*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hit_spans"),
        F.array().cast(f"array<{kind}>").alias("hit_items"),
    )
    machines = [build_automaton(items, window) for items in item_blocks(benchmark, item_id, item_text, block_words)]
    for k, machine in enumerate(machines):
        for owned in machine.ends.values():
            owned[:] = [(size, tuple(i for i in who if i is not None)) for size, who in owned]
        last = k + 1 == len(machines)
        extra = ", removed array<long>" if last else ""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        found = found.mapInArrow(_scan(machine, last), f"{fields}{extra}")
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, max_words: int = 0, max_coverage: float = 1.0,
    window: int = WINDOW, text: str = "text", n_chars: str | None = None,
) -> DataFrame:
    """Cut hit spans out of the texts; documents with too much of them go.

    A document goes if more than ``max_coverage`` of its words are hit, or, with
    ``max_words`` over 0, a hit span is longer than that. Others keep all their columns and lose the hit
    spans; ``n_chars`` names a column to be set to the new length. Texts without hits stay byte for byte.
    """
    found = contaminated_spans(packed(docs, text=text), benchmark, window=window, keep=("row",))
    pairs = F.transform(F.sequence(F.lit(0), F.size("hit_spans") / 2 - 1).cast("array<int>"), lambda i: i)
    longest = F.when(F.size("hit_spans") == 0, 0).otherwise(
        F.array_max(F.transform(pairs, lambda i: F.get("hit_spans", 2 * i + 1) - F.get("hit_spans", 2 * i)))
    )
    hits = n_hit()
    bad = (F.col("n_words") > 0) & (hits > F.col("n_words") * F.lit(max_coverage))
    if max_words:
        bad = bad | (longest > max_words)
    # The text between two removed spans, and before the first and after the last.
    gaps = F.concat(F.array(F.lit(0).cast("long")), F.col("removed"), F.array(F.length("text").cast("long")))
    cut = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.size("removed"), F.lit(2)),
            lambda i: F.col("text").substr((F.get(gaps, i) + 1).cast("int"), (F.get(gaps, i + 1) - F.get(gaps, i)).cast("int")),
        ),
        "",
    )
    kept_rows = found.where(~bad).withColumn("text", F.when(F.size("removed") == 0, F.col("text")).otherwise(cut))
    changed = {}
    if n_chars:
        before = F.col("row").getField(n_chars)
        length = F.when(F.size("removed") == 0, before).otherwise(F.length("text"))
        changed[n_chars] = length.cast(docs.schema[n_chars].dataType)
    return unpacked(kept_rows, docs.columns, text=text, **changed)


def n_hit():
    """Number of hit words, from the merged spans."""
    return F.aggregate(
        F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def items_digest():
    ids = F.array_sort(F.array_distinct(F.transform("hit_items", lambda x: x.cast("string"))))
    return F.sha2(F.array_join(ids, ","), 256)


def reference_hits(texts: list[str | None], items: list[tuple[object, str | None]], window: int = WINDOW):
    """Brute force for tests: per text its number of words, hit words and items."""
    out = []
    grams = [(i, item_words(t)) for i, t in items]
    for text in texts:
        own, hit, found = item_words(text), set(), set()
        for item, ws in grams:
            size = min(window, len(ws))
            if not size:
                continue
            wanted = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)}
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in wanted:
                    hit.update(range(k, k + size))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((len(own), len(hit), len(found), digest))
    return out
