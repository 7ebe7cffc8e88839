"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared by cosine within their label. Equal vectors are one node with a size. Each
label gets pivots (a bounded sample of its nodes) and each node joins the shards of its two nearest
pivots, so shards overlap; a shard that is too large is split into blocks by hash. On every block a
graph is built: near neighbours and some far ones, robustly pruned, with edges back, all reachable
from the block's medoid. A node's adjacency lists of all its blocks are united. Then every node is
searched in the shard of its nearest pivot, its home, and in those of all other pivots that can be the
home of a vector linked with it, as far as they are numbered below its own: of two linked nodes with
different homes the one with the higher home visits the other's, which counts for both. So routing
loses no link. A greedy search runs from the medoid and from the node's own list, and once it is in
range it expands from all that is in range until nothing new turns up. What was found is verified by
the exact cosine.

Each block counts the links to the nodes at home in it and gives a spanning star of the links found,
so a dense family yields rows in proportion to its members, not to its pairs. A task holds one block
and one slice of its visitors, whatever the sizes of labels and families. The search is approximate;
``recall`` audits it against brute force.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, pair_hash, stored
from .components import components

THRESHOLD = 0.98
SHARD = 8000        # nodes of a block, about; as many again come from overlap. Twice as many cost each node as much again
                    # to build, and spare it over a third of its visits
ROWS = 256          # nodes of a block that are compared with all of it at a time
VISITORS = 2000     # nodes that a task searches in a block, about
CHUNK = 8192        # nodes that a task compares with the pivots of their label, about; fewer with over PAIRED pivots
PAIRED = 1024
PIVOTS = 4096       # pivots of a label at most: the documented bound of the sample
HOMES = 2           # shards that a node is built into
DEGREE, NEAR, FAR, ALPHA = 24, 40, 16, 1.2
BEAM, SLACK = 12, 0.06
BROADCAST_LABELS = 10_000


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def robust_prune(near: np.ndarray, cand: np.ndarray, units: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbours chosen from candidates sorted by similarity ``near``; -1 where there is none.

    The nearest candidate is taken, and those that it is closer to (by the factor ALPHA) than the
    point itself are struck out; and so on.
    """
    out = np.full((len(cand), DEGREE), -1, np.int64)
    units, near = units.astype(np.float32), near.astype(np.float32)  # enough to choose edges
    for a in range(0, len(cand), 256):
        c = np.where(cand[a:a + 256] < 0, 0, cand[a:a + 256])
        vectors = units[c]
        apart = np.sqrt(np.maximum(0, 2 - 2 * vectors @ vectors.transpose(0, 2, 1)))
        away = np.sqrt(np.maximum(0, 2 - 2 * near[a:a + 256]))
        live = cand[a:a + 256] >= 0
        rows = np.arange(len(c))
        for step in range(DEGREE):
            pick = live.argmax(1)
            some = live[rows, pick]
            if not some.any():
                break
            out[a + rows[some], step] = c[rows[some], pick[some]]
            live &= ~(ALPHA * apart[rows, pick] <= away) & some[:, None]
            live[rows, pick] = False
    return out


def medoid(units: np.ndarray) -> int:
    return int((units @ units.mean(0)).argmax())


def build_graph(units: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency lists of one block; every node can be reached from the medoid."""
    n = len(units)
    if n == 1:
        return [np.zeros(0, np.int64)]
    k = min(NEAR, n - 1)
    light, closest = units.astype(np.float32), np.empty((n, k), np.int64)
    for a in range(0, n, ROWS):  # single precision chooses edges; links are verified in double
        near = light[a:a + ROWS] @ light.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        closest[a:a + ROWS] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    cand = np.concatenate([closest, far], 1)
    score = similarity(units, units, np.repeat(np.arange(n), cand.shape[1]), cand.ravel()).reshape(cand.shape)
    score[cand == np.arange(n)[:, None]] = -2  # the node itself
    order = np.argsort(-score, axis=1, kind="stable")
    cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
    cand[score < -1.5] = -1
    chosen = robust_prune(score, cand, units)
    src, dst = np.nonzero(chosen >= 0)[0], chosen[chosen >= 0]
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src]))  # edges back
    a, b = pairs // n, pairs % n
    # a node that drew too many edges is pruned again
    lists = np.split(b, np.searchsorted(a, np.arange(1, n)))
    full = [i for i, x in enumerate(lists) if len(x) > 2 * DEGREE]
    if full:
        width = max(len(lists[i]) for i in full)
        again, closer = np.full((len(full), width), -1, np.int64), np.full((len(full), width), -2.0)
        for j, i in enumerate(full):
            own = units[lists[i]] @ units[i]
            order = np.argsort(-own, kind="stable")
            again[j, :len(order)], closer[j, :len(order)] = lists[i][order], own[order]
        kept = robust_prune(closer, again, units)
        for j, i in enumerate(full):
            lists[i] = kept[j][kept[j] >= 0]
    # reach: nodes not reached from the medoid get an edge from their nearest reached node
    reached = np.zeros(n, bool)
    front = [medoid(units)]
    reached[front] = True
    while True:
        while len(front):
            following = np.unique(np.concatenate([lists[i] for i in front])) if len(front) else np.zeros(0, np.int64)
            front = following[~reached[following]]
            reached[front] = True
        if reached.all():
            return lists
        lost = int((~reached).argmax())
        gate = int(np.where(reached, units @ units[lost], -3).argmax())
        lists[gate] = np.append(lists[gate], lost)
        reached[lost] = True
        front = [lost]


def padded(lists: list[np.ndarray]) -> np.ndarray:
    table = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int64)
    for i, x in enumerate(lists):
        table[i, :len(x)] = x
    return table


def similarity(queries: np.ndarray, units: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for a in range(0, len(q), 65536):
        out[a:a + 65536] = np.einsum("ij,ij->i", queries[q[a:a + 65536]], units[x[a:a + 65536]])
    return out


def once(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The keys not seen before, each once; they are marked as seen."""
    keys = keys[~seen[keys]]
    seen[keys] = True
    return np.unique(keys)


def search(queries: np.ndarray, units: np.ndarray, lists: list[np.ndarray], start: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs that may be in range: greedy from the medoid and each query's own starts, then range-expanding."""
    table, n = padded(lists), len(units)
    seen = np.zeros(len(queries) * n, bool)
    first = np.concatenate([np.arange(len(queries)) * n + medoid(units)] + [q * n + s for q, s in enumerate(start) if len(s)])
    fresh = once(first, seen)
    beam = np.full((len(queries), BEAM), -1, np.int64)
    score, done = np.full((len(queries), BEAM), -3.0), np.ones((len(queries), BEAM), bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    wide = threshold - SLACK
    while True:
        q, x = fresh // n, fresh % n
        s = similarity(queries, units, q, x)
        found.append((q[s >= wide], x[s >= wide], s[s >= wide]))
        if len(q):
            # what is new goes into the beams of its queries
            order = np.lexsort((-s, q))
            q, x, s = q[order], x[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            near = place < BEAM
            more = np.full((len(queries), BEAM), -1, np.int64)
            gain = np.full((len(queries), BEAM), -3.0)
            more[q[near], place[near]], gain[q[near], place[near]] = x[near], s[near]
            ids, scores = np.concatenate([beam, more], 1), np.concatenate([score, gain], 1)
            flags = np.concatenate([done, more < 0], 1)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :BEAM]
            rows = np.arange(len(queries))[:, None]
            beam, score, done = ids[rows, best], scores[rows, best], flags[rows, best]
        todo = ~done
        active = np.nonzero(todo.any(1))[0]
        if not len(active):
            break
        at = todo[active].argmax(1)  # the best that is not expanded yet
        done[active, at] = True
        around = table[beam[active, at]]
        fresh = once((active[:, None] * n + around)[around >= 0], seen)
    # range expansion: all that is in range, or just outside, is expanded until nothing new is
    q, x, s = (np.concatenate(c) for c in zip(*found))
    inside = [(q[s >= threshold - 1e-9], x[s >= threshold - 1e-9])]
    front = (q, x)
    while len(front[0]):
        new = []
        for a in range(0, len(front[0]), 50_000):  # bounded slices of the frontier
            around = table[front[1][a:a + 50_000]]
            fresh = once((front[0][a:a + 50_000, None] * n + around)[around >= 0], seen)
            q, x = fresh // n, fresh % n
            s = similarity(queries, units, q, x)
            inside.append((q[s >= threshold - 1e-9], x[s >= threshold - 1e-9]))
            new.append((q[s >= wide], x[s >= wide]))
        front = tuple(np.concatenate(c) for c in zip(*new))
    q, x = (np.concatenate(c) for c in zip(*inside))
    return q, x


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the components of the links (a, b), one per node at most."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        np.minimum.at(root, before[u], low)
        np.minimum.at(root, before[v], low)
        root = root[root]
        if (root == before).all():
            break
    out = root != np.arange(len(nodes))
    return nodes[out], nodes[root[out]]


def build_block(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("node", ignore_index=True)
    ids = block["node"].to_numpy()
    lists = build_graph(unit(matrix(block["vec"])), int(ids[0]) & 0xFFFF)
    return pd.DataFrame({"node": ids, "near": [ids[x].tolist() for x in lists]})


def assign(threshold: float):
    # a link turns x by an angle a at most, which shifts p.x - q.x by sin(a) |p - q| at most before q can be nearer than p
    turn = np.sqrt(1 - threshold ** 2) if threshold > 0 else np.inf

    def run(nodes: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        """(node, shard, rank, home, visit): rank counts a node's pivots from the nearest, its home; visit tells where it is searched."""
        if nodes.empty or pivots.empty:
            return pd.DataFrame({"node": [], "shard": [], "rank": [], "home": []}).astype("int64").assign(visit=pd.Series(dtype=bool))
        pivots = pivots.sort_values("shard", ignore_index=True)
        shards, centres, ids, found = pivots["shard"].to_numpy(), unit(matrix(pivots["vec"])), nodes["node"].to_numpy(), []
        for a in range(0, len(nodes), 512):  # with all pivots of a label, 512 rows are 16 MB of cosines
            near = unit(matrix(nodes["vec"][a:a + 512])) @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            first = order[:, :1]
            apart = np.sqrt(np.maximum(0, 2 - 2 * centres[first[:, 0]] @ centres.T))
            behind = np.take_along_axis(near, first, 1) - near
            # pivots come by their numbers, so those of lower shards have lower places
            visit = np.take_along_axis((behind <= turn * apart + 1e-7) & (np.arange(near.shape[1]) <= first), order, 1)
            row, rank = np.nonzero(visit | (np.arange(near.shape[1]) < HOMES))
            found.append(pd.DataFrame({"node": ids[a + row], "shard": shards[order[row, rank]], "rank": rank, "home": shards[first[row, 0]], "visit": visit[row, rank]}))
        return pd.concat(found)

    return run


def search_block(threshold: float):
    def run(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        """Counts (a, a, links) and stars (a, b, 0); links are those to nodes at home here, and back from these to visitors that are not."""
        if members.empty or visitors.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        members = members.sort_values("node", ignore_index=True)
        ids, vectors = members["node"].to_numpy(), matrix(members["vec"])
        seekers, own = visitors["node"].to_numpy(), matrix(visitors["vec"])
        local = []
        for near in members["near"]:
            near = np.asarray(near, np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            local.append(at[ids[at] == near])
        at = np.minimum(np.searchsorted(ids, seekers), len(ids) - 1)
        start = [local[i] if ids[i] == s else np.zeros(0, np.int64) for i, s in zip(at, seekers)]
        q, x = search(unit(own), unit(vectors), local, start, threshold)
        exact = np.empty(len(q))  # verified: the cosine itself, in double precision
        for a in range(0, len(q), 65536):
            u, v = own[q[a:a + 65536]], vectors[x[a:a + 65536]]
            exact[a:a + 65536] = np.einsum("ij,ij->i", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
        ok = (exact >= threshold) & (seekers[q] != ids[x])
        q, x = q[ok], x[ok]
        weight = np.where(members["home"].to_numpy()[x], members["size"].to_numpy()[x], 0)
        links = np.bincount(q, weight, len(seekers)).astype(np.int64)
        back = (weight > 0) & (visitors["home"].to_numpy()[q] != visitors["shard"].to_numpy()[q])
        returned = np.bincount(x[back], visitors["size"].to_numpy()[q[back]], len(ids)).astype(np.int64)
        some, met = links > 0, returned > 0
        a, b = stars(seekers[q], ids[x])
        return pd.DataFrame({"a": np.concatenate([seekers[some], ids[met], a]), "b": np.concatenate([seekers[some], ids[met], b]),
                             "n": np.concatenate([links[some], returned[met], np.zeros(len(a), np.int64)])})

    return run


def renamed(df: DataFrame, *keys: str):
    """Grouped by the keys, all columns as new ones: a frame can then be grouped together with one it stems from."""
    fresh = df.select(*[F.col(c).alias(f"{c}2") for c in df.columns]).toDF(*df.columns)
    return fresh.groupBy(*keys)


def usable(vec: Column) -> Column:
    """Neither null nor zero, all components there and finite."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def drawn(nodes: DataFrame, groups: DataFrame, small) -> DataFrame:
    """(grp, node, shard, chunks): the k nodes with the smallest hashes of each label, numbered from 1.

    Only hashes up to about twice the k-th smallest are ranked, so the task that ranks a label holds
    a few thousand nodes of it, without their vectors.
    """
    hashed = nodes.join(small(groups), "grp").withColumn("h", F.xxhash64(F.lit(5), "node"))
    low = hashed.filter((F.col("h") / F.lit(2.0 ** 64) + 0.5) * F.col("n") <= 2 * F.col("k") + 64)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("h", "node"))
    return low.withColumn("shard", rank.cast("long")).filter("shard <= k").select("grp", "node", "shard", "chunks")


def near_vectors(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: id, label, n_links, component_id and kept.

    n_links counts the other vectors linked directly, copies included; component_id is the smallest
    id reachable, itself included; kept tells that it is the row's own. Vectors that are null, zero or
    hold null or non-finite components, and vectors without a label, link with nothing; they are
    their own component. Vectors of different lengths within a label do not link. Rows with equal
    vectors are linked, repeated rows too. A null id counts as a link but names no component; its
    kept is false, unless no other has a name, when component_id is null. An empty table gives an
    empty table.
    """
    named = vectors.select(col(id).alias("id"), col(label).alias("label"), col(vec).alias("vec"))
    good = F.coalesce(usable(F.col("vec")) & F.col("label").isNotNull(), F.lit(False))
    group = F.concat_ws(":", F.col("label").cast("string"), F.size("vec").cast("string"))  # vectors that can be compared
    h1, h2 = pair_hash(F.col("vec"))
    rows = stored(named.select("id", "label", F.when(good, group).alias("grp"), h1.alias("h1"), h2.alias("h2"), F.when(good, F.col("vec")).alias("vec")), "vectors")
    classes = (rows.filter("grp is not null").groupBy("grp", "h1", "h2")
               .agg(F.count("*").alias("size"), F.min("id").alias("least"), F.first("vec").alias("vec")))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")  # numbered once, then read

    groups = stored(nodes.groupBy("grp").agg(F.count("*").alias("n")).select(
        "grp", "n", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / SHARD)).alias("k"), F.ceil(F.col("n") / CHUNK * F.greatest(F.lit(1.0), F.least(F.lit(PIVOTS), F.ceil(F.col("n") / SHARD)) / PAIRED)).alias("chunks")), "vector-groups")
    small = F.broadcast if groups.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else (lambda df: df)
    lean = nodes.select("grp", "node", "vec")
    chunked = lean.join(small(groups), "grp").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    pivots = (lean.join(drawn(nodes.select("grp", "node"), groups, small), ["grp", "node"])
              .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))))
    routes = (chunked.select("grp", "chunk", "node", "vec").groupBy("grp", "chunk")
              .cogroup(renamed(pivots.select("grp", "chunk", "shard", "vec"), "grp", "chunk"))
              .applyInPandas(assign(threshold), "node long, shard long, rank long, home long, visit boolean"))
    routes = stored(routes, "vector-routes").join(nodes.select("grp", "node", "size", "vec"), "node")
    routes = stored(routes, "vector-routed")

    sizes = routes.groupBy("grp", "shard").agg(F.count_if(F.col("rank") < HOMES).alias("members"), F.count_if("visit").alias("visitors"))
    sizes = stored(sizes.select("grp", "shard", F.greatest(F.lit(1), F.ceil(F.col("members") / (HOMES * SHARD))).alias("blocks"),
                                F.greatest(F.lit(1), F.ceil(F.col("visitors") / VISITORS)).alias("slices")), "vector-shards")
    routed = routes.join(sizes, ["grp", "shard"])
    members = routed.filter(F.col("rank") < HOMES).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), "blocks"))
    graph = members.select("grp", "shard", "block", "node", "vec").groupBy("grp", "shard", "block").applyInPandas(build_block, "node long, near array<long>")
    graph = stored(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")

    places = (members.join(graph, "node").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
              .select("grp", "shard", "block", "slice", "node", "size", (F.col("rank") == 0).alias("home"), "vec", "near"))
    visits = (routed.filter("visit").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .withColumn("slice", F.pmod(F.xxhash64(F.lit(4), "node"), "slices")).select("grp", "shard", "block", "slice", "node", "size", "home", "vec"))
    keys = ["grp", "shard", "block", "slice"]
    found = stored(places.groupBy(*keys).cogroup(renamed(visits, *keys)).applyInPandas(search_block(threshold), "a long, b long, n long"), "vector-links")

    counts = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("a <> b").select("a", "b"))
    named = stored(nodes.select("grp", "h1", "h2", "node", "size", "least").join(roots, "node", "left").join(counts, "node", "left").select(
        "grp", "h1", "h2", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")), "vector-classes")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    by_class = named.join(least, "root").select(F.col("grp").alias("g"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), "links", "component")
    out = rows.drop("vec").join(by_class, (F.col("grp") == F.col("g")) & (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left")
    component = F.when(F.col("grp").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id), F.col("label").alias(label), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def recall(vectors: DataFrame, result: DataFrame, id: str = "vec_id", vec: str = "embedding", label: str = "label",
           threshold: float = THRESHOLD, every: int = 50) -> float:
    """Audit: the share of links found for the vectors whose id is divisible by ``every``, all rows being compared with them in blocks."""
    asked = vectors.filter((col(id) % every == 0) & usable(col(vec)) & col(label).isNotNull()).select(
        col(id).alias("id"), col(label).alias("label"), col(vec).alias("vec"))
    slices = max(1, asked.count() // VISITORS)
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    others = vectors.filter(usable(col(vec)) & col(label).isNotNull()).select(
        col(id).alias("id"), col(label).alias("label"), col(vec).alias("vec"), F.pmod(F.xxhash64(F.lit(9), col(id)), F.lit(max(1, vectors.count() // CHUNK))).alias("block"))
    others = others.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    blocks = others.select("block").distinct()
    asked = asked.crossJoin(F.broadcast(blocks))  # one row per block of CHUNK rows

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        hits = (unit(matrix(a["vec"])) @ unit(matrix(b["vec"])).T >= threshold) & (a["id"].to_numpy()[:, None] != b["id"].to_numpy())
        return pd.DataFrame({"id": a["id"].to_numpy(), "n": hits.sum(1)})

    keys = ["label", "slice", "block"]
    true = asked.groupBy(*keys).cogroup(renamed(others, *keys)).applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    both = true.join(result.select(col(id).alias("id"), "n_links"), "id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("found")).first()
    return both["found"] / both["n"] if both["n"] else 1.0
