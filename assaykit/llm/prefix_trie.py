"""A trie of conversation prefixes from ternary search trees over range shards.

Distinct turns (role and text) get ids from a dictionary, so a conversation is a sequence of numbers
and texts don't move. Sequences are dealt out by ranges of (sequence, conversation): a shard holds
neighbours, and a sequence that very many conversations share is split as well. Each shard inserts
its distinct sequences into a ternary search tree, the median first, so that the search trees of a
node's children are balanced; one pass over the nodes from the last to the first then adds up
members, leaves and savings.

Only the prefixes of a shard's first and last sequence can also occur in other shards. All other
nodes are finished in their shard. The boundary nodes are merged in rounds, ``FAN`` neighbours at a
time: of a merged range again only the first and last sequence stay open, so a task sees two paths a
shard, and the rounds grow with the logarithm of the shards.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, col, stored

SHARD_TURNS = 500_000   # turns and conversations of a shard, about
FAN = 64                # neighbours merged at a time
HOT_PARTS = 1000        # a turn with this part of all rows is hot: there are that many at most
SALTS = 256             # parts that a hot turn's rows are joined in
BATCH = 50_000          # nodes sent at a time
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): every conversation's turns in order as dictionary ids, and the bytes of their texts.

    Turns go by number, null first, those with equal numbers by the digest of role and text, so
    repeated rows stay side by side. A null role or text is empty. Rows without a conversation belong
    to none and are left out. A conversation is one row here: 12 bytes a turn.
    """
    digest = F.md5(F.concat(F.length(body(col(role))).cast("string"), F.lit(":"), body(col(role)), body(col(text))))
    turns = conversations.filter(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv_id"), col(turn).alias("turn"), digest.alias("digest"), F.octet_length(body(col(text))).alias("size"))
    counted = stored(turns.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "trie-turns")
    total = counted.agg(F.sum("n")).first()[0] or 0
    # the rows of a hot turn meet copies of its entry, each with a part of them
    hot = (F.col("n") >= SALTS) & (F.col("n") * HOT_PARTS >= total)
    marked = turns.join(F.broadcast(counted.filter(hot).select("digest", F.lit(True).alias("hot"))), "digest", "left")
    salted = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    entries = counted.select("digest", "id", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))).alias("salt"))
    coded = salted.join(entries, ["digest", "salt"]).select("conv_id", F.struct("turn", "digest", "id", "size").alias("t"))
    ordered = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: t["id"]).alias("ids"), F.transform("ts", lambda t: t["size"]).alias("sizes"))


def branched(seqs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c behind the first h turns of the first of its family, c - c % family, in place of its own; h = crc32(c) % most.

    All turns of that conversation if it has fewer, none if there is no such conversation. A family
    has ``family`` members at most, and only ``most`` - 1 turns of its first one move.
    """
    first = seqs.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("head"), F.slice("ids", 1, most - 1).alias("head_ids"), F.slice("sizes", 1, most - 1).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = seqs.withColumn("h", h).withColumn("head", F.col("conv_id") - F.col("conv_id") % family).join(first, "head", "left")

    def behind(own: str, head: str):
        start = F.coalesce(F.slice(F.col(head), F.lit(1), F.col("h")), F.slice(F.col(own), 1, 0))
        return F.concat(start, F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own), F.lit(1)))).alias(own)

    return joined.select("conv_id", behind("ids", "head_ids"), behind("sizes", "head_sizes"))


class TernaryTree:
    """A ternary search tree of sequences; node 0 is the empty prefix."""

    def __init__(self) -> None:
        self.value, self.size = array("q", [0]), array("q", [0])
        self.low, self.high, self.down, self.up, self.depth = (array("i", [v]) for v in (-1, -1, -1, -1, 0))
        self.end = array("i", [-1])  # number of the sequence that ends here

    def add(self, up: int, value: int, size: int) -> int:
        for column, v in ((self.value, value), (self.size, size), (self.low, -1), (self.high, -1), (self.down, -1),
                          (self.up, up), (self.depth, self.depth[up] + 1), (self.end, -1)):
            column.append(v)
        return len(self.value) - 1

    def insert(self, number: int, ids: list[int], sizes: list[int]) -> None:
        value, low, high, down = self.value, self.low, self.high, self.down
        node = 0
        for v, size in zip(ids, sizes):
            at = down[node]
            if at < 0:
                down[node] = fresh = self.add(node, v, size)
                node = fresh
                continue
            while v != value[at]:
                side = low if v < value[at] else high
                if side[at] < 0:
                    side[at] = self.add(node, v, size)
                at = side[at]
            node = at
        self.end[node] = number

    def path(self, ids: list[int]) -> list[int]:
        """Nodes of a sequence that is in the tree, the empty prefix first."""
        nodes = [0]
        for v in ids:
            at = self.down[nodes[-1]]
            while v != self.value[at]:
                at = self.low[at] if v < self.value[at] else self.high[at]
            nodes.append(at)
        return nodes


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    ranges = deque([(0, n)])
    while ranges:
        a, b = ranges.popleft()
        if a < b:
            yield (a + b) // 2
            ranges.extend([(a, (a + b) // 2), ((a + b) // 2 + 1, b)])


def grown(key: bytes, value: int) -> bytes:
    """Key of a prefix: a chain of digests over its turns."""
    return hashlib.blake2b(key + struct.pack("<q", value), digest_size=16).digest()


NODES = ("shard long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, ends string, size long, first boolean, last boolean")


def build_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard. A boundary node has a key, and its children, leaves and savings are those of finished children alone."""
    ids: list[list[int]] = []
    sizes: list[list[int]] = []
    convs: list[array] = []
    for batch in batches:
        for conv, own, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            if not ids or ids[-1] != own:
                ids.append(own)
                sizes.append(lengths)
                convs.append(array("q"))
            convs[-1].append(conv)
    if not ids:
        return
    tree, shard = TernaryTree(), TaskContext.get().partitionId()
    for i in medians(len(ids)):
        tree.insert(i, ids[i], sizes[i])

    n = len(tree.value)
    first, last = tree.path(ids[0]), tree.path(ids[-1])
    keys: dict[int, bytes] = {0: b""}
    for nodes in (first, last):
        for up, node in zip(nodes, nodes[1:]):
            keys[node] = grown(keys[up], tree.value[node])
    least, members, children, leaves, saved = (array("q", [v]) * n for v in (2 ** 63 - 1, 0, 0, 0, 0))
    for node in range(n - 1, -1, -1):  # a node comes after the one above it
        end, up = tree.end[node], tree.up[node]
        if end >= 0:
            members[node] += len(convs[end])
            least[node] = min(least[node], convs[end][0])
        if node not in keys:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * tree.size[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = min(least[up], least[node])
            if node not in keys:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]

    heads, tails = set(first), set(last)
    for a in range(0, n, BATCH):
        rows = range(a, min(a + BATCH, n))
        ends = [",".join(map(str, convs[tree.end[i]])) if tree.end[i] >= 0 else None for i in rows]
        inner_up = [tree.up[i] >= 0 and tree.up[i] not in keys for i in rows]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard] * len(rows), pa.int64()),
            "key": pa.array([keys.get(i) for i in rows], pa.binary()),
            "parent_key": pa.array([None if inner or i == 0 else keys[tree.up[i]] for i, inner in zip(rows, inner_up)], pa.binary()),
            "depth": pa.array([tree.depth[i] for i in rows], pa.int64()),
            "conv_id": pa.array([least[i] for i in rows], pa.int64()),
            "parent_conv_id": pa.array([least[tree.up[i]] if inner else None for i, inner in zip(rows, inner_up)], pa.int64()),
            "n_convs": pa.array([members[i] for i in rows], pa.int64()),
            "n_children": pa.array([children[i] for i in rows], pa.int64()),
            "n_leaves": pa.array([leaves[i] for i in rows], pa.int64()),
            "saved_tokens": pa.array([saved[i] for i in rows], pa.int64()),
            "ends_sha256": pa.array([None if i in keys else hashlib.sha256((e or "").encode()).hexdigest() for i, e in zip(rows, ends)], pa.string()),
            "ends": pa.array([e if i in keys else None for i, e in zip(rows, ends)], pa.string()),
            "size": pa.array([tree.size[i] for i in rows], pa.int64()),
            "first": pa.array([i in heads for i in rows]), "last": pa.array([i in tails for i in rows])})


BOUNDARY = ["shard", "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "first", "last"]
MERGED = ("shard long, key binary, parent_key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "size long, first boolean, last boolean, open boolean")


def merge_boundaries(fan: int, top: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Boundary nodes of neighbours as those of one range; nodes that no other range can have are closed, with final figures."""
        lowest, highest = rows["shard"].min(), rows["shard"].max()
        nodes: dict[bytes, dict] = {}
        for row in rows[BOUNDARY].to_dict("records"):
            row["first"] = row["first"] and row["shard"] == lowest
            row["last"] = row["last"] and row["shard"] == highest
            row["shard"] //= fan
            seen = nodes.setdefault(row["key"], row)
            if seen is not row:
                seen["conv_id"] = min(seen["conv_id"], row["conv_id"])
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    seen[name] += row[name]
                seen["first"], seen["last"] = seen["first"] or row["first"], seen["last"] or row["last"]
        for node in sorted(nodes.values(), key=lambda node: -node["depth"]):
            node["open"] = not top and (node["first"] or node["last"])
            if not node["open"]:
                node["n_leaves"] = node["n_leaves"] or 1
                node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
                if node["depth"]:
                    up = nodes[node["parent_key"]]
                    up["n_children"] += 1
                    up["n_leaves"] += node["n_leaves"]
                    up["saved_tokens"] += node["saved_tokens"]
        return pd.DataFrame(nodes.values())[[*BOUNDARY, "open"]]

    return run


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, joined by commas, as they come; nothing but the state of one hash is held."""
    key = state = None
    for batch in batches:
        keys, out = [], []
        for k, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if state:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "sha": pa.array(out, pa.string())})
    if state:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "sha": [state.hexdigest()]})


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, ids, sizes), the empty one included.

    conv_id is the smallest member (conversations are members of their prefixes, themselves included;
    one without turns of the empty prefix), parent_conv_id that of the prefix shorter by one (null for
    the empty one); depth, n_convs, n_children; n_leaves, prefixes in the subtree that none extends;
    saved_tokens, (n_convs - 1) times the size of the last turn, summed over the subtree; ends_sha256,
    digest of the ids of the conversations that end here, ascending, joined by commas. No sequences
    give no rows.
    """
    spark = seqs.sparkSession
    seqs = stored(seqs.select("conv_id", "ids", "sizes"), "trie-sequences")
    weight = seqs.agg(F.sum(F.size("ids") + F.lit(1).cast("long"))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (weight or 0) // SHARD_TURNS + 1)
    ranged = seqs.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = stored(ranged.mapInArrow(build_shard, NODES), "trie-nodes")

    boundary = nodes.filter("key is not null")
    level, done = boundary.select(BOUNDARY), []
    groups = (nodes.agg(F.max("shard")).first()[0] or 0) + 1
    while groups > 0:
        groups = -(-groups // FAN)
        merged = stored(level.groupBy(F.floor(F.col("shard") / FAN)).applyInPandas(merge_boundaries(FAN, groups == 1), MERGED), "trie-merged")
        done.append(merged.filter("not open").drop("open"))
        level = merged.filter("open").drop("open")
        if groups == 1:
            break
    closed = done[0]
    for more in done[1:]:
        closed = closed.union(more)

    named = closed.select("key", F.col("conv_id").alias("named"))
    ends = (boundary.filter("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
            .select("key", "ends").mapInArrow(hashed_ends, "key binary, sha string"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = (closed.join(ends, "key", "left").join(named.toDF("parent_key", "parent_conv_id"), "parent_key", "left")
            .withColumn("ends_sha256", F.coalesce("sha", F.lit(NOBODY))))
    # a shard's nodes get the names of its own boundary nodes: the children of the empty prefix are many
    local = boundary.select("shard", "key").join(named, "key").select("shard", F.col("key").alias("parent_key"), "named")
    inner = nodes.filter("key is null")
    below = inner.filter("parent_key is not null").drop("parent_conv_id").join(local, ["shard", "parent_key"]).withColumnRenamed("named", "parent_conv_id")
    return inner.filter("parent_key is null").select(out).union(below.select(out)).union(tops.select(out))
