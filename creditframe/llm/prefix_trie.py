"""Conversation prefix trie from ternary search trees, one per range shard.

Turns are dictionary-encoded: distinct (role, text) pairs get numbers in their
sorted order.  A conversation is then a sequence of numbers.  Distinct
sequences are sorted and cut into range shards; each shard inserts its
sequences into a ternary search tree by medians (the middle one first, then
the middles of both halves), walks it with a stack and adds up members,
childless nodes and savings from the bottom.  In sorted order only prefixes of
a shard's first or last sequence can continue in a neighbour; these boundary
nodes, at most two paths a shard, are summed over shards afterwards.

Scale: conversations that are alike collapse to one sequence with a count
before they are sorted.  Turns are numbered within their conversation by
range partitions and offsets, so a conversation that holds a third of all rows
is spread over tasks.  Sequences go through in segments of ``SEGMENT`` turns:
the node that ends a segment is the root of the next round, and what only one
conversation continues is a chain that needs no tree.  The number of shards
follows the number of turns.  The SHA-256 of a node's finished conversations is
a stream: shards write their ids in pieces, and one pass over the pieces of a
node hashes them in order, one piece in memory.

Nodes are identified by an MD5 chain over the numbers of their path (128 bits;
two paths of one table that meet by accident are not told apart).

Edge cases: null role or text is empty; turns order by turn (null first), ties
by role and text, repeated rows follow each other; rows without a conversation
id belong to no conversation; a conversation without turns is a member of the
root only; an empty table has no nodes; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SEGMENT = 256
SHARD_TURNS = 1 << 20
#: Conversation ids in one piece of a node's list.
PIECE = 1 << 16
ROOT = "0" * 32
NOTHING = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------ turns to numbers
def _shards(df: DataFrame, rows: int, per_shard: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows / per_shard))


def encode(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv, pos, tid, size): the place of every turn in its conversation, the
    number of its (role, text) and the code points of its text."""
    rows = turns.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).filter("conv is not null")
    # repeated rows are one row with a count until their places are known
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("times"))
    rows = written(rows.withColumn("h", F.xxhash64("role", "text")), "trie-turns")
    sayings = (rows.groupBy("role", "text", "h").agg(F.count("*").alias("n")).repartitionByRange("role", "text")
               .sortWithinPartitions("role", "text"))
    sayings = written(sayings.select("role", "text", "h", F.char_length("text").alias("size"),
                                     F.monotonically_increasing_id().alias("tid")), "trie-sayings")
    coded = rows.join(sayings, ["h", "role", "text"]).select("conv", "turn", "tid", "size", "times")
    return _numbered(coded)


def _numbered(coded: DataFrame) -> DataFrame:
    """Places of turns by running sums within range partitions plus offsets."""
    turn_type = coded.schema["turn"].dataType.simpleString()

    def number(batches):
        part, conv_before, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv, times = b.column(0).to_numpy(), b.column(4).to_numpy()
            if not len(conv):
                continue
            before = np.cumsum(times) - times
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            origin = before[starts]
            if conv[0] == conv_before:
                origin[0] -= at
            pos = before - np.repeat(origin, np.diff(np.r_[starts, len(conv)]))
            conv_before, at = conv[-1], int(pos[-1] + times[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pos), pa.array(np.full(len(conv), part, np.int32))],
                ["conv", "turn", "tid", "size", "times", "pos", "part"])

    dealt = coded.repartitionByRange("conv", "turn", "tid").sortWithinPartitions("conv", "turn", "tid")
    placed = written(dealt.mapInArrow(
        number, f"conv long, turn {turn_type}, tid long, size int, times long, pos long, part int"), "trie-places")
    # conversations that go on in a later partition: at most one a partition
    parts = placed.groupBy("conv", "part").agg(F.sum("times").alias("n"))
    spread = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("p")).filter(F.size("p") > 1)
    offsets = spread.select("conv", F.posexplode("p").alias("i", "x"), "p").filter("i > 0").select(
        "conv", F.col("x.part").alias("part"),
        F.aggregate(F.slice("p", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("off"))
    whole = placed.join(offsets, ["conv", "part"], "left")
    first = F.col("pos") + F.coalesce("off", F.lit(0))
    repeats = F.explode(F.sequence(first, first + F.col("times") - 1))
    return written(whole.select("conv", repeats.alias("pos"), "tid", "size"), "trie-numbered")


# ----------------------------------------------------------- one shard's tree
class _Tree:
    """A ternary search tree; node 0 holds the roots of the shard."""

    def __init__(self):
        self.key, self.low, self.equal, self.high = [0], [0], [0], [0]
        self.up, self.size, self.depth = [0], [0], [0]

    def _add(self, x: int, size: int, up: int) -> int:
        for column, value in ((self.key, x), (self.low, 0), (self.equal, 0), (self.high, 0), (self.up, up),
                              (self.size, size), (self.depth, self.depth[up] + 1)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids, sizes) -> int:
        """The node where the sequence ends."""
        node = 0
        for x, size in zip(ids, sizes):
            i = self.equal[node]
            if not i:
                i = self.equal[node] = self._add(x, size, node)
            while self.key[i] != x:
                side = self.low if x < self.key[i] else self.high
                if not side[i]:
                    side[i] = self._add(x, size, node)
                i = side[i]
            node = i
        return node

    def walk(self) -> list[int]:
        """All nodes but 0, each after the node above it."""
        out, stack = [], [self.equal[0]]
        while stack:
            i = stack.pop()
            if i:
                out.append(i)
                stack += (self.high[i], self.low[i], self.equal[i])
        return out


def medians(n: int):
    """0..n-1, the middle first, then the middles of the halves."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            m = (a + b) // 2
            yield m
            spans += ((a, m), (m + 1, b))


def _shard(rows: list[dict], shard: int) -> dict[str, list]:
    """Nodes of the sorted distinct sequences of one shard."""
    roots = sorted({r["root"] for r in rows})
    number = {r: i for i, r in enumerate(roots)}
    tree = _Tree()
    end = [0] * len(rows)
    for j in medians(len(rows)):
        r = rows[j]
        end[j] = tree.insert([number[r["root"]], *r["ids"]], [0, *r["sizes"]])
    n = len(tree.key)
    members, first = [0] * n, [None] * n
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for j, i in enumerate(end):
        r = rows[j]
        members[i], first[i] = r["n"], r["first"]
        children[i], leaves[i], saved[i] = r["children"], r["leaves"], r["saved"]
    edge = [False] * n
    for i in (end[0], end[-1]):
        while i:
            edge[i] = True
            i = tree.up[i]
    order = tree.walk()
    digest = [""] * n
    for i in order:
        digest[i] = (hashlib.md5(f"{digest[tree.up[i]]},{tree.key[i]}".encode()).hexdigest()
                     if tree.up[i] else roots[tree.key[i]])
    for i in reversed(order):
        up = tree.up[i]
        members[up] += members[i]
        first[up] = first[i] if first[up] is None else min(first[up], first[i])
        if not edge[i]:
            leaves[i] += not children[i]
            saved[i] += (members[i] - 1) * tree.size[i]
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]

    def path(i: int) -> list[str]:
        out = []
        while i:
            out.append(digest[i])
            i = tree.up[i]
        return out

    up = [tree.up[i] for i in order]
    return {"shard": [shard] * len(order), "key": [digest[i] for i in order],
            "above": [digest[u] or None for u in up], "depth": [tree.depth[i] - 1 for i in order],
            "conv": [first[i] for i in order],
            "parent": [None if not u or edge[u] else first[u] for u in up],
            "n_convs": [members[i] for i in order], "n_children": [children[i] for i in order],
            "n_leaves": [leaves[i] for i in order], "saved": [saved[i] for i in order],
            "size": [tree.size[i] for i in order], "edge": [edge[i] for i in order],
            "path": [path(i) if edge[i] else None for i in order]}


_NODE = ("shard int, key string, above string, depth long, conv long, parent long, n_convs long, n_children long, "
         "n_leaves long, saved long, size long, edge boolean, path array<string>")
_NODE_ARROW = pa.schema([
    ("shard", pa.int32()), ("key", pa.string()), ("above", pa.string()),
    *[(c, pa.int64()) for c in ("depth", "conv", "parent", "n_convs", "n_children", "n_leaves", "saved", "size")],
    ("edge", pa.bool_()), ("path", pa.list_(pa.string()))])


def _sub_tries(sequences: DataFrame, shards: int) -> DataFrame:
    """(key, above, depth, conv, parent, n_convs, n_children, n_leaves, saved)
    of the tries below all roots; ``depth`` counts from the root, which is 0.

    ``sequences``: root, ids, sizes, n, first, children, leaves, saved; one row
    a distinct (root, ids).
    """
    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            out = _shard(rows, TaskContext.get().partitionId())
            yield from pa.Table.from_pydict(out, _NODE_ARROW).to_batches(max_chunksize=20_000)

    sorted_in = sequences.repartitionByRange(shards, "root", "ids").sortWithinPartitions("root", "ids")
    parts = written(sorted_in.mapInArrow(run, _NODE), "trie-parts")
    inner, edge = parts.filter("not edge"), parts.filter("edge")
    met = edge.groupBy("key").agg(
        F.first("above").alias("above"), F.first("depth").alias("depth"), F.min("conv").alias("conv"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.first("size").alias("size"),
        F.first("path").alias("path"))
    met = written(met, "trie-boundary")
    below = met.filter("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("edge_children"))
    met = met.join(below, "key", "left").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("edge_children", F.lit(0)))
    own_leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    own_saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("size")
    up = met.select(F.explode("path").alias("key"), own_leaves.alias("l"), own_saved.alias("s"))
    sums = up.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved"))
    met = written(met.drop("n_leaves", "saved").join(sums, "key"), "trie-boundary-sums")
    parents = met.select(F.col("key").alias("above"), F.col("conv").alias("parent"))
    cols = ["key", "above", "depth", "conv", "parent", "n_convs", "n_children", "n_leaves", "saved"]
    # nodes below a boundary node look it up in their own shard, so no key is hot
    here = edge.select("shard", F.col("key").alias("above")).join(parents, "above")
    inner = inner.withColumnRenamed("parent", "known").join(here, ["shard", "above"], "left").withColumn(
        "parent", F.coalesce("known", "parent"))
    return inner.select(*cols).unionByName(met.join(parents, "above", "left").select(*cols))


# ------------------------------------------------------------ finished members
def _ends(last: DataFrame, shards: int) -> DataFrame:
    """(key, ends_sha256) from (key, conv): ids in ascending order, hashed as a
    stream of pieces."""
    def pieces(batches):
        held_key, held, first = None, [], None

        def flush():
            return pa.RecordBatch.from_pydict({"key": [held_key], "first": pa.array([first], pa.int64()),
                                               "ids": [",".join(map(str, held)).encode()]})

        for b in batches:
            for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != held_key or len(held) >= PIECE:
                    if held:
                        yield flush()
                    held_key, held, first = key, [], conv
                held.append(conv)
        if held:
            yield flush()

    def digests(batches):
        key, sha = None, None
        done_keys, done = [], []
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if sha is not None:
                        done_keys.append(key)
                        done.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
        if sha is not None:
            done_keys.append(key)
            done.append(sha.hexdigest())
        yield pa.RecordBatch.from_pydict({"key": pa.array(done_keys, pa.string()),
                                          "ends_sha256": pa.array(done, pa.string())})

    parts = last.repartitionByRange(shards, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(
        pieces, "key string, first long, ids binary")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(
        digests, "key string, ends_sha256 string")


# -------------------------------------------------------------------- the trie
def _sequences(rows: DataFrame, lengths: DataFrame, start: int, segment: int) -> DataFrame:
    """(conv, root, n, ids, sizes) of the segment from ``start`` of every
    conversation of ``lengths`` (conv, root, n turns)."""
    inside = rows.filter((F.col("pos") >= start) & (F.col("pos") < start + segment))
    lists = inside.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("t"))
    none = F.array().cast("array<struct<pos:long,tid:long,size:int>>")
    return lengths.join(lists, "conv", "left").withColumn("t", F.coalesce("t", none)).select(
        "conv", "root", "n", F.transform("t", lambda x: x["tid"]).alias("ids"),
        F.transform("t", lambda x: x["size"]).alias("sizes"))


def _last_key(root, ids):
    return F.aggregate(ids, root, lambda a, x: F.md5(F.concat(a, F.lit(","), x.cast("string")).cast("binary")))


def nodes(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS,
          shards: int | None = None) -> DataFrame:
    """All nodes of the trie over ``rows`` (conv, pos, tid, size; places from 0
    without gaps) of the conversations ``convs`` (conv).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    lengths = convs.select("conv").join(rows.groupBy("conv").agg(F.max("pos").alias("last")), "conv", "left").select(
        "conv", F.lit(ROOT).alias("root"), (F.coalesce("last", F.lit(-1)) + 1).alias("n"))
    lengths = written(lengths, "trie-lengths")
    turns = lengths.agg(F.sum("n")).first()[0] or 0
    shards = shards or _shards(rows, turns, shard_turns)
    rounds, chains, start = [], [], 0
    while True:
        seqs = written(_sequences(rows, lengths, start, segment).withColumn(
            "key", _last_key(F.col("root"), F.col("ids"))), "trie-segments")
        rounds.append((start, seqs))
        start += segment
        on = seqs.filter(F.col("n") > start).select("conv", F.col("key").alias("root"), "n")
        together = on.groupBy("root").agg(F.count("*").alias("together"))
        on = written(on.join(together, "root"), "trie-continued")
        chains.append((start, on.filter("together = 1").drop("together")))
        lengths = on.filter("together > 1").drop("together")
        if not lengths.head(1):
            break
    below = lower = None
    found = []
    for (start, seqs), (chain_start, chain) in zip(reversed(rounds), reversed(chains)):
        each = seqs.groupBy("root", "ids", "key").agg(
            F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("first"))
        # what hangs below the nodes that end this segment
        hanging = chain.select(F.col("root").alias("key"), F.lit(1).cast("long").alias("children"),
                               F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        hanging = hanging if below is None else hanging.unionByName(below)
        each = each.join(hanging, "key", "left").na.fill(0, ["children", "leaves", "saved"])
        made = written(_sub_tries(each.drop("key"), shards), "trie-round")
        tops = made.filter("depth = 0")
        below = tops.select("key", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), "saved")
        # members that end at a root of the round below are counted here only
        ending = made.filter(F.col("depth") == chain_start - start).select("key", "conv")
        if lower is not None:
            first = lower.filter("depth = 1").drop("parent").join(ending.toDF("above", "parent"), "above")
            found.append(first.withColumn("depth", F.lit(chain_start + 1).cast("long")))
        found.append(_chain_nodes(rows, chain, chain_start, ending))
        kept = made if start == 0 else made.filter("depth > 1")
        found.append(kept.withColumn("depth", F.col("depth") + start))
        lower = made
    trie = found[0]
    for f in found[1:]:
        trie = trie.unionByName(f.select(trie.columns))
    last = rounds[0][1].filter(F.col("n") <= segment).select("key", "conv")
    for start, seqs in rounds[1:]:
        last = last.unionByName(seqs.filter(F.col("n") <= start + segment).select("key", "conv"))
    ends = _ends(last, shards)
    for start, chain in chains:
        own = chain.select(F.concat_ws(":", "root", "n").alias("key"), F.sha2(F.col("conv").cast("string"), 256).alias("ends_sha256"))
        ends = ends.unionByName(own)
    return trie.join(ends, "key", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def _chain_nodes(rows: DataFrame, chain: DataFrame, start: int, tops: DataFrame) -> DataFrame:
    """Nodes that a single conversation passes from place ``start`` on."""
    tail = rows.filter(F.col("pos") >= start).join(chain.join(tops.toDF("root", "top"), "root"), "conv")
    return tail.select(
        F.concat_ws(":", "root", F.col("pos") + 1).alias("key"), F.lit(None).cast("string").alias("above"),
        (F.col("pos") + 1).alias("depth"), "conv",
        F.when(F.col("pos") == start, F.col("top")).otherwise(F.col("conv")).alias("parent"),
        F.lit(1).cast("long").alias("n_convs"), F.when(F.col("pos") + 1 < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))


# ------------------------------------------------------- conversations rebuilt
def with_shared_heads(rows: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) after every conversation c took over the first h turns of
    conversation c - c % ``every`` for its own first h; h = crc32(c) % ``most``."""
    convs = rows.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", (F.col("conv") - F.pmod("conv", F.lit(every))).alias("base"),
        F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).alias("h"))
    bases = convs.filter("conv = base").select("base", F.col("n").alias("n_base"))
    convs = written(convs.join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-heads")
    heads = rows.filter(F.col("pos") < most).join(convs.filter("conv = base").select("conv"), "conv", "left_semi").select(
        F.col("conv").alias("base"), "pos", "tid", "size")
    taken = convs.select("conv", "base", "taken").join(heads, "base").filter("pos < taken").select("conv", "pos", "tid", "size")
    own = rows.join(convs.select("conv", "h", "taken"), "conv").filter("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "size")
    return written(taken.unionByName(own), "trie-rebuilt"), convs.select("conv")
