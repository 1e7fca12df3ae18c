"""Conversation prefix trie by ternary search trees over dictionary-encoded turns, a tree for each range shard.

Distinct turns get numbers in the order of (role, text). Conversations become arrays of such numbers, are dealt by range of (array, conv_id)
into shards, so that copies of one conversation, or all that begin alike, spread over as many shards as their number asks for. In
a shard, distinct sequences are inserted into a ternary search tree, medians first, which keeps it balanced; a node of the tree is a node
of the trie. One pass over the nodes, last made first, adds members, leaves and savings up to their parents without recursion.

Only nodes on a shard's first or last path, no deeper than what that path has in common with its neighbour's, lie in several shards. Each
shard is told these two depths. A node counts as its parent's child, and as a place where tokens are spent once, in its first shard; a childless node
counts as a leaf in its last. All figures of a shared node are then sums over its shards, joined by a digest of its path.

Bounds: a shard holds the numbers of its conversations, some 200,000 turns; a single conversation is one array (8 bytes a turn). A digest of
ends is SHA-256 over ids in order, which only one task can work out; it gets the ids in pieces and keeps none of them.

Cases: a null role or text is empty; turns with equal number, or none, are ordered by role and text, null numbers first; repeated rows are turns of
their own; rows with a null conv_id take no part; conversations without turns are members of the root; an empty table gives an empty result;
columns beyond conv_id, turn, role and text are ignored; very long texts are turns like others, as only their numbers travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.llm.common import hinted, save, words

#: Turns that a shard holds on average, at most.
SHARD_TURNS = 200_000
#: Characters of a text by which distinct turns are dealt out; within a part they are sorted whole.
DEALT_BY = 1000
_NODE = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, parent_key binary, first_end bigint, end_ids string"
_NAMES = [x.split()[0] for x in _NODE.split(", ")]
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (id, n_words) in order, for conversations (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))).alias("key")
    distinct = said.select("role", "text").distinct().repartitionByRange(_parts(said), "role", F.substring("text", 1, DEALT_BY)).sortWithinPartitions("role", "text")
    dictionary = save(distinct.select(F.monotonically_increasing_id().alias("id"), key, F.size(words(F.col("text"))).alias("n_words")))
    numbered = said.select("conv_id", "turn", key).join(dictionary, "key")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id", "n_words")))
    return numbered.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["n_words"].alias("n_words"))).alias("turns"))


def rebuilt(found: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Sequences of which each takes its first h turns from the conversation whose number is a multiple of ``every``; h is a checksum of its own number, below ``most``."""
    heads = found.select(F.col("conv_id").alias("from"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    led = found.withColumns({"from": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "from", "left")
    none = F.slice("turns", 1, 0)
    return led.select("conv_id", F.concat(F.slice(F.coalesce("head", none), 1, F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """Length of what two arrays have in common at their start; -1 if one is null."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(same, F.lit(False))
    return F.when(a.isNull() | b.isNull(), -1).when(differ == 0, F.size(same)).otherwise(differ - 1).cast("int")


class Tree:
    """A ternary search tree. A node is by its number: its turn, the siblings below and above, the first of its children, and what it counts."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.below, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]
        self.n, self.least, self.words, self.ends = [0], [-1], [0], [()]

    def _new(self, turn: int, words: int, parent: int) -> int:
        for column, value in ((self.turn, turn), (self.low, -1), (self.high, -1), (self.below, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.n, 0), (self.least, -1), (self.words, words), (self.ends, ())):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], words: list[int], convs: list[int]) -> None:
        """A sequence and its conversations, in ascending order."""
        at, path = 0, [0]
        for x, w in zip(turns, words, strict=True):
            t = self.below[at]
            if t < 0:
                t = self.below[at] = self._new(x, w, at)
            while self.turn[t] != x:
                side = self.low if x < self.turn[t] else self.high
                if side[t] < 0:
                    side[t] = self._new(x, w, at)
                t = side[t]
            at = t
            path.append(at)
        self.ends[at] = convs
        for v in path:
            self.n[v] += len(convs)
            self.least[v] = convs[0] if self.least[v] < 0 else min(self.least[v], convs[0])

    def path(self, turns: list[int], depth: int) -> list[int]:
        """The nodes of a sequence that is in the tree, from the root to ``depth``."""
        out = [0] if depth >= 0 else []
        for x in turns[: max(depth, 0)]:
            t = self.below[out[-1]]
            while self.turn[t] != x:
                t = (self.low if x < self.turn[t] else self.high)[t]
            out.append(t)
        return out


def medians(n: int) -> Iterator[int]:
    """0 to n - 1: the middle first, then the middles of both halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(m + 1, b), (a, m)]


def shard_nodes(rows: list[tuple[list[int], int, list[int]]], before: int, after: int) -> dict[str, list]:
    """The nodes of a shard with rows (turn ids, conv_id, words of the turns); ``before`` and ``after`` are the depths that its first and last path share with the
    neighbouring shards (-1: none). Columns as in ``_NODE``; key is given for shared nodes, parent_key for those below one."""
    rows = sorted(rows, key=lambda r: r[:2])
    groups: list[tuple[list[int], list[int], list[int]]] = []
    for ids, conv, counts in rows:
        if not groups or groups[-1][0] != ids:
            groups.append((ids, counts, []))
        groups[-1][2].append(conv)
    tree = Tree()
    for m in medians(len(groups)):
        tree.insert(*groups[m])
    keys: dict[int, bytes] = {}
    earlier, later = set(tree.path(rows[0][0], before)), set(tree.path(rows[-1][0], after))
    for ids, depth in ((rows[0][0], before), (rows[-1][0], after)):
        digest = hashlib.blake2b(digest_size=16)
        for v in tree.path(ids, depth):
            if v:
                digest.update(tree.turn[v].to_bytes(8, "little"))
            keys[v] = digest.copy().digest()
    size = len(tree.turn)
    children, leaves, saved, below = [0] * size, [0] * size, [0] * size, [0] * size
    for v in range(size - 1, -1, -1):  # children are made after their parents
        if not below[v] and v not in later:
            leaves[v] = 1
        saved[v] += (tree.n[v] - (v not in earlier)) * tree.words[v]
        if v:
            p = tree.parent[v]
            below[p] += 1
            children[p] += v not in earlier
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    out: dict[str, list] = {name: [] for name in _NAMES}
    for v in range(size):
        p, ids = tree.parent[v], ",".join(map(str, tree.ends[v]))
        shared, under = v in keys, p in keys
        parent = None if not v or under else tree.least[p]
        row = (tree.depth[v], tree.least[v], parent, tree.n[v], children[v], leaves[v], saved[v], None if shared else hashlib.sha256(ids.encode()).hexdigest(), keys.get(v), keys.get(p), tree.ends[v][0] if shared and ids else None, ids if shared else None)
        for name, x in zip(_NAMES, row, strict=True):
            out[name].append(x)
    return out


def _digests(pieces: Iterator[tuple[bytes, str]]) -> Iterator[tuple[bytes, str]]:
    """key and digest of the ids of pieces (key, ids), which come in order."""
    at, digest = None, hashlib.sha256()
    for key, ids in pieces:
        if key != at:
            if at is not None:
                yield at, digest.hexdigest()
            at, digest = key, hashlib.sha256()
        else:
            digest.update(b",")
        digest.update(ids.encode())
    if at is not None:
        yield at, digest.hexdigest()


def prefix_trie(found: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node, for sequences (conv_id, turns), a row a conversation."""
    found = save(found)
    turns = found.agg(F.sum(F.size("turns"))).first()[0]
    if turns is None:
        turns = 0
    shards = max(_parts(found), turns // SHARD_TURNS + 1)
    split = found.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.n_words").alias("counts")).repartitionByRange(shards, "ids", "conv_id")
    dealt = save(split.withColumn("shard", F.spark_partition_id()))
    ends = dealt.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    order = Window.orderBy("shard")  # a row a shard
    depths = ends.select("shard", _common(F.col("first"), F.lag("last").over(order)).alias("before"), _common(F.col("last"), F.lead("first").over(order)).alias("after"))

    def work(table: pa.Table) -> pa.Table:
        rows = list(zip(table["ids"].to_pylist(), table["conv_id"].to_pylist(), table["counts"].to_pylist(), strict=True))
        return pa.table(shard_nodes(rows, table["before"][0].as_py(), table["after"][0].as_py()), schema=pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _NODE.split(", "))]))

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    nodes = save(dealt.join(F.broadcast(depths), "shard").groupBy("shard").applyInArrow(work, _NODE))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, digest in _digests((k.as_py(), i.as_py()) for b in batches for k, i in zip(b.column("key"), b.column("end_ids"), strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest])], ["key", "ends"])

    shared = nodes.where("key IS NOT NULL")
    pieces = shared.where("first_end IS NOT NULL").select("key", "first_end", "end_ids").repartition("key").sortWithinPartitions("key", "first_end")
    digests = pieces.select("key", "end_ids").mapInArrow(stream, "key binary, ends string")
    sums = shared.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in _SUMS))
    merged = save(sums.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256))).drop("ends").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    both = nodes.where("key IS NULL").select(*columns, "parent_key").unionByName(merged.select(*columns, "parent_key"))
    parents = hinted(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")), merged.count())
    return both.join(parents, "parent_key", "left").select(*(F.coalesce("parent_conv_id", "above").alias(c) if c == "parent_conv_id" else F.col(c) for c in columns))
