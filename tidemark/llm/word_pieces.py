"""Token counts by greedy longest match, in time linear in the text, without building pieces.

A trie of the vocabulary gets failure links: where a node has no edge for the next symbol, the pieces
that longest match would have cut so far are known, so only their number is added and matching goes
on from the link. A word's last byte is a symbol of its own, as pieces that end a word are
entries of their own in the vocabulary.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import Memo, documents, slices

WORD_END = "</w>"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies print for each byte: printable ones are themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary_symbols(path: str) -> list[tuple[int, ...]]:
    """Vocabulary entries as symbols: bytes, and 256 more for a byte that ends a word."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"] for token in content.get("added_tokens", [])}
    out = []
    for entry in content["model"]["vocab"]:
        if entry in special:
            continue
        ends = entry.endswith(WORD_END)
        codes = [letters[c] for c in (entry.removesuffix(WORD_END) if ends else entry)]
        if codes:
            out.append((*codes[:-1], codes[-1] + 256 * ends))
    return out


class LongestMatch:
    """The automaton: edges, failure link and number of popped pieces of each trie node."""

    def __init__(self, entries: list[tuple[int, ...]]):
        self.edges: list[dict[int, int]] = [{}]
        token = {0: False}
        for entry in entries:
            node = 0
            for symbol in entry:
                if symbol not in self.edges[node]:
                    self.edges[node][symbol] = len(self.edges)
                    self.edges.append({})
                node = self.edges[node][symbol]
            token[node] = True
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        level = [(0, symbol, node) for symbol, node in self.edges[0].items()]
        while level:
            deeper = []
            for parent, symbol, node in level:
                if token.get(node):
                    self.fail[node], self.popped[node] = 0, 1
                else:
                    at, popped = self.fail[parent], self.popped[parent]
                    while at >= 0 and symbol not in self.edges[at]:
                        at, popped = self.fail[at], popped + self.popped[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.edges[at][symbol], popped
                deeper += [(node, s, child) for s, child in self.edges[node].items()]
            level = deeper
        self.counts = Memo(self.count)

    def count(self, word: str) -> int:
        """Pieces of a word; a word that cannot be cut into pieces counts as one unknown piece."""
        symbols = word.encode("utf-8", "surrogatepass")
        edges, fail, popped = self.edges, self.fail, self.popped
        node = pieces = 0
        last = len(symbols) - 1
        for i, symbol in enumerate(symbols):
            if i == last:
                symbol += 256
            while symbol not in edges[node]:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = edges[node][symbol]
        while node > 0:
            pieces += popped[node]
            node = fail[node]
        return pieces if node == 0 else 1


@lru_cache(maxsize=2)
def longest_match(path: str) -> LongestMatch:
    return LongestMatch(vocabulary_symbols(path))


def _count(path: str):
    def count(batches):
        counts = longest_match(path).counts
        for part in slices(batches):
            pieces, n_words = [], []
            for text in part.column("text").to_pylist():
                found = text.lower().split() if text else []
                n_words.append(len(found))
                pieces.append(sum(map(counts.__getitem__, found)))
            columns = {name: part.column(name) for name in part.rows.schema.names if name != "text"}
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_tokens": pa.array(pieces, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)
        counts.clear()  # workers are used again for other things

    return count


def token_counts(docs: DataFrame, vocabulary: str, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text, in lower case and cut at white space.

    Null, empty and blank texts count 0. Repeated rows each get a row; other columns are dropped.
    """
    rows = documents(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(vocabulary), f"doc_id {kind}, n_words long, n_tokens long")


def total_tokens(counted: DataFrame) -> DataFrame:
    """Sums over the corpus, in one row."""
    return counted.agg(F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
