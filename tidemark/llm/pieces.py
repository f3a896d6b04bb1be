"""SentencePiece encoding by an Aho-Corasick automaton and one Viterbi pass, and decoding.

The automaton runs over the characters once; at each position its output links name all pieces that
end there, longest first, and each relaxes the best score. Pieces hold a space
mark only at their front, and no line feed, so a text falls into words (with the spaces before
them) that can be solved one by one: the best path of the text is made of theirs.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.texts import Memo, documents, slices

SPACE = "▁"
#: Score of a character without a piece, below the worst piece.
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(r"\n| *[^ \n]+| +")


class PieceModel:
    """Pieces, scores and byte pieces of a model file; needs byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.byte_ids = [-1] * 256
        self.output: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.output.append(bytes([value]))
            elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                self.output.append(b"")
            else:
                self.pieces[piece] = (model.get_score(i), i)
                self.output.append(piece.replace(SPACE, " ").encode())
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte pieces to fall back on")
        for piece in self.pieces:
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece goes across a space or a line feed")
        self.unknown = min(score for score, _ in self.pieces.values()) - UNKNOWN_PENALTY
        self._automaton()
        self.words = Memo(self._ids)

    def _automaton(self) -> None:
        edges: list[dict[str, int]] = [{}]
        ends: list[tuple[int, float, int] | None] = [None]
        for piece, (score, number) in self.pieces.items():
            node = 0
            for c in piece:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    ends.append(None)
                node = edges[node][c]
            ends[node] = (len(piece), score, number)
        fail, out = [0] * len(edges), [-1] * len(edges)
        queue = deque(edges[0].values())
        while queue:
            node = queue.popleft()
            for c, child in edges[node].items():
                at = fail[node]
                while at and c not in edges[at]:
                    at = fail[at]
                fail[child] = edges[at].get(c, 0)
                out[child] = fail[child] if ends[fail[child]] else out[fail[child]]
                queue.append(child)
        self.edges, self.ends, self.fail, self.out = edges, ends, fail, out

    def best_path(self, word: str) -> tuple[float, list[int]]:
        """Score and ids of the best segmentation; of equal ones the longer last piece wins.

        Leading plain spaces are space marks; a mark that the text itself holds is not one, and is
        written as bytes.
        """
        edges, ends, fail, out = self.edges, self.ends, self.fail, self.out
        lead = len(word) - len(word.lstrip(" "))
        best: list[float] = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]  # where the last piece begins, its id
        node = 0
        for i, c in enumerate(word):
            if i < lead:
                c = SPACE
            elif c == SPACE:
                c = ""  # no piece has it
            while node and c not in edges[node]:
                node = fail[node]
            node = edges[node].get(c, 0)
            top, origin, piece = None, i, -1
            at = node if ends[node] else out[node]
            while at > 0:
                length, score, number = ends[at]
                score += best[i + 1 - length]
                if top is None or score > top:
                    top, origin, piece = score, i + 1 - length, number
                at = out[at]
            fallback = best[i] + self.unknown
            if top is None or fallback > top:
                top, origin, piece = fallback, i, -1
            best.append(top)
            back.append((origin, piece))
        ids: list[int] = []
        end = len(word)
        while end:
            origin, piece = back[end]
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(word[origin:end].encode())]
            end = origin
        ids.reverse()
        return best[-1], ids

    def _ids(self, word: str) -> bytes:
        return np.array(self.best_path(word)[1], dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers; a text begins with a space mark that decoding drops."""
        return b"".join(map(self.words.__getitem__, _WORDS.findall(" " + text))) if text else b""

    def decode(self, ids: bytes | None) -> str | None:
        """The text of encoded ids; of other ids too, bytes that are no character replaced."""
        if ids is None:
            return None
        raw = b"".join(map(self.output.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _encode(path: str):
    def encode(batches):
        model = piece_model(path)
        for part in slices(batches):
            ids = [None if t is None else model.encode(t) for t in part.column("text").to_pylist()]
            columns = {name: part.column(name) for name in part.rows.schema.names}
            columns["ids"] = pa.array(ids, pa.binary())
            columns["n_pieces"] = pa.array([len(x or b"") // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)
        model.words.clear()  # workers are used again for other things

    return encode


def _decode(path: str):
    def decode(batches):
        model = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [model.decode(x) for x in rows.column(rows.schema.get_field_index("ids")).to_pylist()]
                columns = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
                columns["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return decode


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, model: str, *, doc_id="doc_id", text="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns in ``keep``, ids (binary, 32-bit little-endian) and n_pieces of every whole text.

    A null text has null ids, an empty one none; both have 0 pieces. Repeated rows each get a row.
    """
    rows = documents(docs, *keep, doc_id=doc_id, text=text)
    return rows.mapInArrow(_encode(model), f"{_fields(rows)}, ids binary, n_pieces long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``decoded``, the text of the column ``ids``; null for null."""
    return encoded.mapInArrow(_decode(model), f"{_fields(encoded)}, decoded string")
