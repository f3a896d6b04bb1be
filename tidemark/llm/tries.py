"""Prefix tries of conversations: double arrays per shard, shared upper nodes merged globally.

A turn is known by 128 bits of the SHA-256 of its role and text, a conversation by the path of its turns. Paths are
dealt by range, so a shard holds neighbours in the order of paths, and a prefix that very many conversations
have is cut into several shards. Each shard numbers its turns densely, packs its paths into BASE and CHECK arrays
(from node s the turn c leads to t = BASE[s] + c if CHECK[t] = s) and walks every conversation through them.

Only nodes on the first and the last path of a shard can also lie in another one. They are *open*: their
aggregates are partial and are merged by the SHA-256 of their path. All other nodes are final where they are. Open nodes are
few (two paths a shard); sums over their subtrees take a round for each doubling of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import kept, ship

#: Turns of the conversations that go into one pair of arrays; a longer conversation has its own.
SHARD_TURNS = 100_000
_FREE = -1


class DoubleArray:
    """A trie over sorted paths of dense ids; node 0 is the root."""

    def __init__(self, paths: list[list[int]]):
        self.base, self.check = [0], [0]
        self._low = 1  # no slot below is free
        stack = [(0, 0, len(paths), 0)]
        while stack:
            node, first, end, depth = stack.pop()
            while first < end and len(paths[first]) == depth:
                first += 1  # these end here
            begins, codes = [], []
            for i in range(first, end):
                code = paths[i][depth]
                if not codes or codes[-1] != code:
                    codes.append(code)
                    begins.append(i)
            if codes:
                base = self.base[node] = self._place(codes)
                for code, a, b in zip(codes, begins, [*begins[1:], end]):
                    self.check[base + code] = node
                    stack.append((base + code, a, b, depth + 1))

    def _place(self, codes: list[int]) -> int:
        """The least base under which the slots of all codes are free."""
        check = self.check
        while self._low < len(check) and check[self._low] != _FREE:
            self._low += 1
        slot = self._low
        while True:
            if slot >= len(check) or check[slot] == _FREE:
                base = slot - codes[0]
                if all(base + c >= len(check) or check[base + c] == _FREE for c in codes):
                    short = base + codes[-1] + 1 - len(check)
                    check += [_FREE] * short
                    self.base += [0] * short
                    return base
            slot += 1

    def child(self, node: int, code: int) -> int:
        """The node after one more turn, -1 if there is none."""
        at = self.base[node] + code
        return at if 0 < at < len(self.check) and self.check[at] == node else -1

    def walk(self, path: list[int]) -> list[int]:
        """The nodes of a path from the root, as far as there are any."""
        nodes = [0]
        for code in path:
            at = self.child(nodes[-1], code)
            if at < 0:
                break
            nodes.append(at)
        return nodes


_SCHEMA = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("depth", pa.int64()), ("words", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.string()),
])
_FIELDS = (
    "node binary, parent binary, conv_id long, parent_conv_id long, depth long, words long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string"
)


def path_digests(ids: list[bytes]) -> list[bytes]:
    """SHA-256 of the first 0, 1, .. turns of a path."""
    state, found = hashlib.sha256(), []
    found.append(state.digest())
    for i in ids:
        state.update(i)
        found.append(state.digest())
    return found


def shard_nodes(convs: list[tuple[int, list[bytes], list[int]]]) -> pa.RecordBatch:
    """Nodes of sorted conversations (conv_id, turn ids, words of each turn).

    Three kinds of rows: final nodes (``node`` is null; ``parent`` only if that is open), partial open nodes, and
    for the ends of open nodes the conv_ids in ``ends``, the smallest of them in ``conv_id`` (``depth`` is null).
    """
    dense = {turn: i for i, turn in enumerate(sorted({t for _, ids, _ in convs for t in ids}))}
    paths = [[dense[t] for t in ids] for _, ids, _ in convs]
    trie = DoubleArray(paths)
    size = len(trie.check)
    smallest, count, depth, words = [None] * size, [0] * size, [0] * size, [0] * size
    enders: dict[int, list[int]] = {}
    order: list[int] = []
    for (conv, _, tokens), path in zip(convs, paths):
        nodes = trie.walk(path)
        for d, node in enumerate(nodes):
            if not count[node]:
                order.append(node)  # parents come before their children
                depth[node] = d
                words[node] = tokens[d - 1] if d else 0
            count[node] += 1
            if smallest[node] is None or conv < smallest[node]:
                smallest[node] = conv
        enders.setdefault(nodes[-1], []).append(conv)
    open_nodes: dict[int, bytes] = {}
    above: dict[int, bytes | None] = {}
    for edge in (0, -1):
        digests = path_digests(convs[edge][1])
        for d, node in enumerate(trie.walk(paths[edge])):
            open_nodes[node] = digests[d]
            above[node] = digests[d - 1] if d else None
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    rows: dict[str, list] = {f.name: [] for f in _SCHEMA}

    def add(**values) -> None:
        for name, column in rows.items():
            column.append(values.get(name))

    for node in reversed(order):
        parent, closed = trie.check[node], node not in open_nodes
        if closed:
            leaves[node] = leaves[node] or 1
            saved[node] += (count[node] - 1) * words[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        ends = ",".join(map(str, sorted(enders.get(node, []))))
        common = dict(
            conv_id=smallest[node], depth=depth[node], n_convs=count[node], n_children=children[node],
            n_leaves=leaves[node], saved_tokens=saved[node],
        )
        if closed:
            known = parent not in open_nodes
            add(
                **common, parent=None if known else open_nodes[parent], parent_conv_id=smallest[parent] if known else None,
                ends_sha256=hashlib.sha256(ends.encode()).hexdigest(),
            )
        else:
            add(**common, node=open_nodes[node], parent=above[node], words=words[node])
            if ends:
                add(node=open_nodes[node], conv_id=min(enders[node]), ends=ends)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _shards(limit: int):
    def shards(batches):
        convs, turns = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                convs.append((row["conv_id"], row["ids"], row["words"]))
                turns += len(row["ids"]) + 1
                if turns >= limit:
                    yield shard_nodes(convs)
                    convs, turns = [], 0
        if convs:
            yield shard_nodes(convs)

    return shards


def _join_ends(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ends of each node, whose rows come together and in order; a state is all that is held."""
    node, state, found = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["node"] != node:
                if state is not None:
                    found.append((node, state.hexdigest()))
                node, state = row["node"], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["ends"].encode())
    if state is not None:
        found.append((node, state.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in found], pa.binary()), pa.array([h for _, h in found], pa.string())], ["node", "ends_sha256"]
    )


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn's role and text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def paths(conversations: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id and turns (id, words) of each conversation, in order of turn, null first.

    Turns of one number are put in order of their id, so repeated rows are turns that follow one another. A null role or
    text is an empty one. Rows without conv_id belong to no conversation. Texts are reduced to 20 bytes before
    the shuffle; a conversation is one row.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.array_remove(F.split(said, r"[\x20\x09-\x0D]+"), ""))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), turn_id(F.coalesce(F.col(role), F.lit("")), said).alias("id"), words.alias("words")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def spliced(found: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Each conversation with its first ``head`` turns replaced by those of the conversation ``base``.

    All of them, if that has fewer; none, if there is no such conversation. ``head`` is at most ``most``.
    """
    wanted = found.withColumn("_base", base).withColumn("_head", head)
    fronts = found.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_front"))
    front = F.slice("_front", F.lit(1), F.col("_head"))
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("_head") + 1, F.greatest(F.size("turns") - F.col("_head"), F.lit(0)))
    return wanted.join(fronts, "_base", "left").select("conv_id", F.concat(F.coalesce(front, none), own).alias("turns"))


def prefix_trie(found: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turns), a row each.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over
    the subtree: members but one, times the words of the last turn) and ends_sha256. conv_ids are distinct. A conversation without
    turns is a member of the root only; without any conversation there is no node.
    """
    spark = found.sparkSession
    ship(spark)
    table = kept(found.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")), "paths")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = kept(dealt.mapInArrow(_shards(shard_turns), _FIELDS), "nodes")

    partial = nodes.where("node IS NOT NULL AND depth IS NOT NULL").groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.min("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    partial = kept(partial, "open")
    open_children = partial.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("more"))
    merged = partial.join(open_children.withColumnRenamed("parent", "node"), "node", "left")
    n_children = F.col("n_children") + F.coalesce("more", F.lit(0))
    merged = kept(
        merged.select(
            "node", "parent", "conv_id", "depth", "n_convs", n_children.alias("n_children"),
            (F.col("n_leaves") + F.when(n_children == 0, 1).otherwise(0)).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        "open",
    )
    totals = subtree_sums(merged.select("node", "parent", "n_leaves", "saved_tokens"))

    ends = nodes.where("ends IS NOT NULL").select("node", "conv_id", "ends")
    ends = ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_join_ends, "node binary, ends_sha256 string")
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = (
        merged.drop("n_leaves", "saved_tokens").join(totals, "node").join(parents, "parent", "left").join(ends, "node", "left")
        .withColumn("parent_conv_id", F.col("_parent_conv_id"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    )
    lower = nodes.where("node IS NULL").join(parents, "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_parent_conv_id")
    )
    return lower.select(*columns).unionByName(upper.select(*columns))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """node, n_leaves and saved_tokens summed over the subtree of each node (node, parent, n_leaves, saved_tokens).

    Each round adds what hangs 1, 2, 4, .. levels lower to a node and doubles the reach.
    """
    state = nodes
    while not state.where("parent IS NOT NULL").isEmpty():
        lower = state.where("parent IS NOT NULL").groupBy("parent").agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
        )
        higher = state.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        state = kept(
            state.join(lower.withColumnRenamed("parent", "node"), "node", "left").join(higher, "parent", "left").select(
                "node", F.col("_next").alias("parent"), (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
            ),
            "sums",
        )
    return state.select("node", "n_leaves", "saved_tokens")
