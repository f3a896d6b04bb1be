"""Prefix tries, periodic runs and passages against brute force, on nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tidemark.llm import periods, queries, recompress, tries  # noqa: E402

BLANKS = b" \t\n\r\x0b\x0c"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def with_clashes(df, names):
    return df.select("*", *[F.lit("x").alias(n) for n in names])


# --- prefix tries


def rebuilt_by_hand(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def nodes_by_hand(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * words
    found = Counter()
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        found[(min(who), len(p), parent, len(who), children[p], leaves[p], saved[p], sha(ends.encode()))] += 1
    return found


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 130), -7, -40, *range(2001, 2012)]:
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), f"said {rng.randint(0, 1)} and more"))
    for c in range(400, 440):  # one conversation, many times
        rows += [(c, t, "user", f"copy {t}") for t in range(5)]
    rows += [(50, t, None, None if t % 2 else "") for t in range(60)]  # long, with ties against empty turns
    rows += [(51, None, "user", "first of all"), (51, None, "user", "first of all"), (51, 0, "x", "y"), (51, 0, "x", "z")]
    rows += [(None, 1, "user", "of no conversation"), (60, 3, "us", "er\x0bé\x1c b"), (61, 3, "use", "r\x0bé\x1c b")]
    return rows


@pytest.mark.parametrize("shard", [1, 7, 100_000])
def test_prefix_trie(spark, shard):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = tries.paths(with_clashes(frame, ["id", "words", "turns", "node", "t"]))
    conv = F.col("conv_id")
    head = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    nodes = tries.prefix_trie(tries.spliced(found, conv - conv % 20, head, most=3), shard_turns=shard)
    convs = rebuilt_by_hand(rows)
    assert any(not turns for turns in convs.values())  # a conversation without turns
    assert Counter(tuple(r) for r in nodes.collect()) == nodes_by_hand(convs)


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert tries.prefix_trie(tries.paths(empty)).count() == 0
    assert tries.prefix_trie(tries.paths(empty.limit(0))).count() == 0


def test_double_array():
    rng = random.Random(2)
    for _ in range(50):
        paths = sorted({tuple(rng.randint(0, 9) for _ in range(rng.randint(0, 5))) for _ in range(60)})
        trie = tries.DoubleArray([list(p) for p in paths])
        prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
        slots = {p: trie.walk(list(p)) for p in prefixes}
        assert all(len(slots[p]) == len(p) + 1 for p in prefixes)
        assert len({s[-1] for s in slots.values()}) == len(prefixes)
        for _ in range(60):
            p = tuple(rng.randint(0, 9) for _ in range(rng.randint(1, 5)))
            assert (len(trie.walk(list(p))) == len(p) + 1) == (p in prefixes)


# --- periodic runs


def runs_by_hand(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            run = w[i : i + length]
            if length >= max(6, 4 * q) and not any(run[:-p] == run[p:] for p in range(1, q)):
                found.append((i, q, length))
            i = max(j, i + 1)
    return sorted(found)


def described(doc_id, text):
    words = queries.repeated_tail(doc_id, (text or "").encode().split())
    runs = runs_by_hand(words)
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    shape = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *shape, sha(listed.encode()), sha(kept))


def periodic_texts():
    rng = random.Random(8)
    texts = [None, "", "  \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x " * 3000, "\x1ca \x1ca\x0b\x1ca\f\x1ca\r\x1ca\n\x1ca　"]
    for _ in range(150):
        words = []
        while rng.random() < 0.85:
            root = [rng.choice("abcdefé") for _ in range(rng.choice([1, 2, 3, 5, 8, 31, 64]))]
            words += (root * 9)[: rng.randint(1, 9 * len(root))] + [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 9))]
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate(texts)] + [(7, "x " * 3000), (None, "b b b b b b b"), (None, None)]


def test_periodic_runs(spark):
    rows = periodic_texts()
    frame = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["row", "period", "runs", "body", "n"])
    found = periods.find_runs(frame, rewrite=queries.repeated_tail)
    got = found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = Counter(described(*r) for r in rows)
    assert sum(w[1] for w in want) > 50
    assert Counter(tuple(r) for r in got.collect()) == want
    assert periods.find_runs(frame.limit(0)).count() == 0


def test_runs_are_told_in_full(spark):
    docs = spark.createDataFrame([("k", "go a b a b a b a b a stop")], "name string, said string")
    (row,) = periods.find_runs(docs, doc_id="name", text="said").collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 9, 2)] and row["collapsed"] == b"go a b stop" and row["doc_id"] == "k"


def test_z_function():
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))]
        want = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert periods.z_function(x) == want


# --- passages


def passages_by_hand(rows, width):
    """Of rows (order, doc_id, text): what stays of each."""
    distinct = sorted({r[0] for r in rows})
    words = {r[0]: (r[2] or "").encode().split() for r in rows}
    seen, cover = set(), defaultdict(set)
    for key in distinct:
        w = words[key]
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                cover[key].update(range(i, i + width))
            seen.add(window)
    return Counter(
        (r[1], len(words[r[0]]), len(cover[r[0]]), sha(b" ".join(x for i, x in enumerate(words[r[0]]) if i not in cover[r[0]])))
        for r in rows
    )


def shared_texts():
    rng = random.Random(5)
    blocks = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randint(0, 3)) for _ in range(rng.randint(5, 60))) for _ in range(9)]
    texts = [" ".join(rng.choice(blocks) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts += ["y " * 100, "y " * 19, "p q r " * 40, "p q r " * 41, blocks[0], blocks[0], None, "", "  \t", "one two\x1c three"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + rows[3:5] + [(2, texts[9]), (None, texts[4]), (None, texts[4]), (None, texts[5]), (None, None)]


@pytest.mark.parametrize("width", [20, 3, 1])
def test_passages(spark, width):
    frame = spark.createDataFrame(shared_texts(), "doc_id long, text string").repartition(4)
    keyed = frame.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    rows = [((r["doc_id"] is not None, r["doc_id"] or 0, r["h"]), r["doc_id"], r["text"]) for r in keyed]
    found = recompress.remove_passages(with_clashes(frame, ["row_key", "key", "low", "span", "spans", "kept"]), width=width)
    assert Counter(tuple(r)[:4] for r in found.collect()) == passages_by_hand(rows, width)
    assert recompress.remove_passages(frame.limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(30):
        passage = rng.integers(0, rng.choice([2, 5, 1000]), 60).astype(np.uint64)
        sides = [rng.integers(0, 5, n).astype(np.uint64) for n in rng.integers(0, 30, 4)]
        told = []
        for before, after in (sides[:2], sides[2:]):
            names = recompress.mix(np.concatenate([before, passage, after]) + np.uint64(9))
            key, first = recompress.anchors(names, np.arange(len(before), len(before) + 41))
            told.append((key.tolist(), (first - len(before)).tolist()))
        assert told[0] == told[1]


def test_long_texts_are_held_whole(spark):
    text = " ".join(f"n{i * 7919 % 30011}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "in front " + text)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in recompress.remove_passages(docs).collect()}
    again = 60_000 - 30_011
    assert got == {1: (60_000, again), 2: (60_002, 60_000)}
