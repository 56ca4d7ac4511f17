"""SimHash near-duplicate classes with vantage-point trees.

1. Every text gets a 64-bit fingerprint of its 4-word shingles (a worker function over Arrow batches).
   Only (doc_id, fingerprint) goes on, and equal fingerprints are grouped at once.
2. Distinct fingerprints are dealt to shards by vantage-point trees: a node holds a vantage point and
   a distance, and every fingerprint goes to its side of it. The trees are grown on a sample that
   follows the number of fingerprints (about ``SAMPLES`` for each ``SHARD`` of them, ``MOST_SAMPLES`` at most)
   and are always grown, whatever the size.
   In 64 nearly random bits a triangle bound of radius 4 leaves two of three points on both sides of a
   median boundary, so a tree over whole fingerprints would copy each point 1.3 times a level. Distances are
   therefore taken in projections first: of six blocks of 10 or 11 bits, two fingerprints at distance 4 or
   less agree wholly in two (pigeonhole), so for one of the 15 pairs of blocks their distance
   within these 21 or 22 bits is 0. A tree a pair, searched with radius 0, has no
   boundary that a neighbour could lie across: a fingerprint sits in 15 shards at any depth. Where a
   shard's points all agree in the projection, the tree goes on by the distance of whole fingerprints, and
   those within the radius of a boundary visit the shard beyond it as guests.
3. In a shard the tree is grown on, down to ``LEAF`` points, for all shards of a task at once; the branch on
   the other side of a boundary is pruned. Where the projection has nothing left to tell apart, a local tree over whole
   fingerprints is searched with radius 4, its branches pruned by the triangle bound. Only the
   links of spanning forests are emitted, never all pairs of a group. No candidate is capped or dropped.
4. Components of the forests' links are found by alternating large and small stars; joins on a node
   are salted, so the links of a hub are spread, and every step is cut by a checkpoint.

Null text and texts without words have fingerprint zero, which links like any other. A null doc_id
is never the smallest id unless all are null. Equal ids or texts and repeated rows come out each. A very long text
is hashed whole, in memory of its own size. Further columns are not read, whatever their names. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.llm.common import cut, map_texts

RADIUS, SHINGLE, SEED = 4, 4, 42
#: First bit and width of the blocks; a projection keeps two of them.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of a shard, as far as the sample tells; sampled ones for each of them, and in all; points of a leaf.
SHARD, SAMPLES, MOST_SAMPLES, LEAF = 1024, 8, 1 << 20, 8
#: Shares of rows and of links from which a fingerprint or node counts as hot; tasks that a node's links are dealt to.
HOT, SALTS = 4096, 16


def _mask(*blocks: tuple[int, int]) -> int:
    return sum(((1 << n) - 1) << at for at, n in blocks)


PROJECTIONS = np.array([_mask(*two) for two in combinations(BLOCKS, 2)], np.uint64)
WHOLE = np.uint64((1 << 64) - 1)


# -- fingerprints -------------------------------------------------------------
def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    h = xxhash.xxh64_intdigest
    if len(raw) <= size:
        return [h(b" ".join(raw), SEED)] if raw else []
    return [h(b" ".join(x), SEED) for x in zip(*[raw[k:] for k in range(size)], strict=False)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Unsigned fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        h = np.array(shingle_hashes(t), np.uint64)
        if len(h):
            ones = np.zeros(64, np.int64)
            for a in range(0, len(h), 8192):
                ones += np.unpackbits(h[a : a + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed bigint."""

    def make():
        return lambda texts: {out: pa.array(fingerprints(texts).view(np.int64))}

    return map_texts(docs, text_col, [T.StructField(out, T.LongType())], make)


# -- vantage-point trees ------------------------------------------------------
def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: np.ndarray | np.uint64 = WHOLE) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int64)


def boundary(d: np.ndarray) -> int | None:
    """The distance that comes nearest to halving ``d``: points up to it are inside; None if all are the same."""
    values, counts = np.unique(d, return_counts=True)
    if len(values) < 2:
        return None
    inside = np.cumsum(counts)[:-1]
    return int(values[np.abs(2 * inside - len(d)).argmin()])


@dataclass
class ShardTree:
    """Nodes of the trees of all projections as columns; ``left`` is 0 at a leaf. Node k < number of projections is a root."""

    vantage: np.ndarray
    mask: np.ndarray
    mu: np.ndarray
    reach: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, most: int = SAMPLES, radius: int = RADIUS) -> ShardTree:
        """Trees over ``sample``, split until a leaf has ``most`` of it, or a boundary's guests would undo the split."""
        nodes: list[list] = [[0, 0, 0, 0, 0, 0] for _ in PROJECTIONS]
        todo = [(k, sample) for k in range(len(PROJECTIONS))] if len(sample) else []
        forest = list(range(len(PROJECTIONS)))
        while todo:
            k, own = todo.pop()
            if len(own) <= most:
                continue
            v = own[len(own) // 2]
            mask, reach = PROJECTIONS[forest[k]], 0
            d = distance(own, v, mask)
            mu = boundary(d)
            if mu is None:  # alike in the projection: by whole fingerprints
                mask, reach = WHOLE, radius
                d = distance(own, v)
                mu = boundary(d)
                if mu is None or (d <= mu + reach).sum() > 0.9 * len(own):
                    continue
            left, right = len(nodes), len(nodes) + 1
            nodes[k] = [int(v), int(mask), mu, reach, left, right]
            nodes += [[0, 0, 0, 0, 0, 0] for _ in range(2)]
            forest += [forest[k]] * 2
            todo += [(left, own[d <= mu + reach]), (right, own[d > mu])]
        columns = list(zip(*nodes, strict=True))
        return cls(*[np.array(c, np.uint64) for c in columns[:2]], *[np.array(c, np.int64) for c in columns[2:]])

    def seats(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, shard, projection) of every home and visit."""
        n, k = len(points), len(PROJECTIONS)
        at, node, forest = np.tile(np.arange(n), k), np.repeat(np.arange(k), n), np.repeat(np.arange(k), n)
        done: list[tuple[np.ndarray, ...]] = []
        while len(at):
            leaf = self.left[node] == 0
            if leaf.any():
                done.append((at[leaf], node[leaf], forest[leaf]))
                at, node, forest = at[~leaf], node[~leaf], forest[~leaf]
            d = distance(points[at], self.vantage[node], self.mask[node])
            inner, outer = d <= self.mu[node] + self.reach[node], d > self.mu[node]
            node = np.concatenate([self.left[node[inner]], self.right[node[outer]]])
            at, forest = np.concatenate([at[inner], at[outer]]), np.concatenate([forest[inner], forest[outer]])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (none, none, none)  # type: ignore[return-value]


class Classes:
    """Classes of indexes that are merged as links come; keeps the links of a spanning forest."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] and b[i]; only one link for each two classes that meet is looked at."""
        x, y = self.of[a], self.of[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        _, first = np.unique(x * len(self.of) + y, return_index=True)
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = root.get(up, up)
                i = up
            return i

        for i in first.tolist():
            u, v = find(int(x[i])), find(int(y[i]))
            if u != v:
                root[max(u, v)] = min(u, v)
                self.links.append((int(a[apart[i]]), int(b[apart[i]])))
        old = np.fromiter(root, np.int64, len(root))
        new = np.arange(len(self.of))
        new[old] = [find(i) for i in old.tolist()]
        self.of = new[self.of]


class VantageTree:
    """Search tree over whole fingerprints, with counts of the nodes that searches visit and prune.

    ``points`` are put in the order of the tree, so that a node's points are those from ``first`` to ``end``.
    """

    def __init__(self, points: np.ndarray, leaf: int = 4 * LEAF):
        self.points = points.copy()
        self.nodes: list[list] = []  # [first, end] or [first, end, vantage, left, right, left's largest distance, right's smallest]
        self.visited = self.pruned = 0
        todo: list[tuple[int, int, tuple[int, int] | None]] = [(0, len(points), None)]
        while todo:
            first, end, up = todo.pop()
            k, own, mu = len(self.nodes), self.points[first:end], None
            if up is not None:
                self.nodes[up[0]][up[1]] = k
            if end - first > leaf:
                v = own[len(own) // 2]
                d = distance(own, v)
                mu = boundary(d)
            if mu is None:
                self.nodes.append([first, end])
                continue
            inner = d <= mu
            middle = first + int(inner.sum())
            self.points[first:end] = np.concatenate([own[inner], own[~inner]])
            self.nodes.append([first, end, v, 0, 0, int(d[inner].max()), int(d[~inner].min())])
            todo += [(middle, end, (k, 4)), (first, middle, (k, 3))]

    def leaves(self) -> Iterator[np.ndarray]:
        return (np.arange(n[0], n[1]) for n in self.nodes if len(n) == 2)

    def near(self, queries: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point), as indexes of points, at ``radius`` or less; a part is no larger than queries times a leaf.

        ``others``: how many of the first k points are worth finding; nodes without any are pruned too.
        """
        todo = [(0, queries)]
        while todo:
            k, q = todo.pop()
            node = self.nodes[k]
            if others[node[0]] == others[node[1]]:
                self.pruned += len(q)
                continue
            self.visited += len(q)
            if len(node) == 2:
                i, j = np.nonzero(distance(self.points[q][:, None], self.points[node[0] : node[1]][None, :]) <= radius)
                if len(i):
                    yield q[i], node[0] + j
                continue
            d = distance(self.points[q], node[2])
            for child, alive in ((node[3], d - radius <= node[5]), (node[4], d + radius >= node[6])):
                self.pruned += int((~alive).sum())
                if alive.any():
                    todo.append((child, q[alive]))


def forest(points: np.ndarray, radius: int = RADIUS, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the points within ``radius`` of each other, directly or in steps.

    Each leaf of the tree is searched for at once. While its points are of one class, points of that class are
    not looked for again, so a dense group costs little more than a scan for each leaf.
    """
    tree = VantageTree(points)
    classes = Classes(len(points))
    for own in tree.leaves():
        mine = classes.of[own]
        worth = classes.of != mine[0] if (mine == mine[0]).all() else np.ones(len(points), bool)
        for a, b in tree.near(own, np.append(0, np.cumsum(worth)), radius):
            classes.merge(a, b)
    if tally is not None:
        tally["visited"] = tally.get("visited", 0) + tree.visited
        tally["pruned"] = tally.get("pruned", 0) + tree.pruned
    links = np.array(classes.links, np.int64).reshape(-1, 2)
    return tree.points[links[:, 0]], tree.points[links[:, 1]]


def shard_links(points: np.ndarray, shard: np.ndarray, projection: np.ndarray, radius: int = RADIUS, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of spanning forests of every shard. ``tally`` gets counts of nodes visited and pruned.

    The trees of all shards grow by one level at a time: each group's vantage point is its middle one, its
    boundary the distance in the projection that halves it best. As linked points have distance 0 in
    one of the projections, a point looks for its links in the group on its side only.
    """
    order = np.lexsort((points, shard))
    p, g, m = points[order], shard[order], PROJECTIONS[projection[order]]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    seen = {"visited": 0, "pruned": 0}
    while len(p):
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(start, len(p)))
        small = size <= LEAF
        few = np.repeat(small, size)
        if few.any():
            a, b = _leaf_links(p[few], g[few], radius)
            left.append(a)
            right.append(b)
            p, g, m = p[~few], g[~few], m[~few]
            start, size = np.cumsum(np.append(0, size[~small]))[:-1], size[~small]
        if not len(p):
            break
        d = distance(p, np.repeat(p[start + size // 2], size), m)
        group = np.repeat(np.arange(len(start)), size)
        order = np.lexsort((d, group))
        p, g, m, d = p[order], g[order], m[order], d[order]
        # the step between two distances that is nearest to the middle of the group
        step = np.flatnonzero((d[1:] != d[:-1]) & (group[1:] == group[:-1]))
        off = np.abs(2 * (step + 1 - start[group[step]]) - size[group[step]])
        best = np.lexsort((off, group[step]))
        best = best[np.append(True, np.diff(group[step][best]) > 0)] if len(best) else best
        split = np.full(len(start), -1)
        split[group[step[best]]] = step[best] + 1
        alike = np.repeat(split < 0, size)
        seen["visited"] += len(p)
        seen["pruned"] += int((~alike).sum())
        if alike.any():  # nothing left to tell apart in the projection
            for s, n in zip(start[split < 0].tolist(), size[split < 0].tolist(), strict=True):
                a, b = forest(np.unique(p[s : s + n]), radius, seen)
                left.append(a)
                right.append(b)
        side = (np.arange(len(p)) >= np.repeat(split, size)).astype(np.int64)
        g = (2 * group + side)[~alike]
        p, m = p[~alike], m[~alike]
    if tally is not None:
        tally.update(seen)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _leaf_links(p: np.ndarray, g: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within leaves of at most ``LEAF`` points, which lie together in ``g``."""
    a, b = [], []
    for k in range(1, LEAF):
        i = np.flatnonzero((g[k:] == g[:-k]) & (distance(p[k:], p[:-k]) <= radius))
        a.append(i)
        b.append(i + k)
    i, j = np.concatenate(a), np.concatenate(b)
    return p[i], p[j]


def grow_trees(fps: DataFrame) -> ShardTree:
    """The shards' trees, from a sample of the distinct bigints ``fp``; it is chosen by hash, so reruns agree."""
    n = fps.count()
    part = min(SAMPLES / SHARD, MOST_SAMPLES / max(1, n))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("vantage"), "fp"), 11) / F.lit(float(1 << 53))
    picked = [r["fp"] for r in fps.select("fp").where(unit < part).collect()]
    return ShardTree.grow(np.sort(np.array(picked, np.int64)).view(np.uint64))


def link(fps: DataFrame) -> DataFrame:
    """(hi, lo): links of spanning forests over the distinct bigints ``fp`` of ``fps``."""
    shared = fps.sparkSession.sparkContext.broadcast(grow_trees(fps))  # about 40 bytes a node, 4 million nodes at most

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                own = fp[i : i + 4096]
                at, shard, projection = shared.value.seats(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(shard * len(PROJECTIONS) + projection), pa.array(own[at])], names=["shard", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if held:  # 16 bytes a row of one shuffle partition
            shard = np.concatenate([x[0] for x in held])
            a, b = shard_links(np.concatenate([x[1] for x in held]).view(np.uint64), shard, shard % len(PROJECTIONS))
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["hi", "lo"])

    return fps.select("fp").mapInArrow(seat, "shard long, fp long").repartition("shard").mapInArrow(links, "hi long, lo long").distinct()


# -- components ---------------------------------------------------------------
def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (hi > lo): the smallest node of its component.

    Alternating stars; each step aggregates minima, which are combined before the shuffle, and joins
    them back by node and salt, so that the links of a hub are dealt to ``SALTS`` tasks.
    """

    def mark(e: DataFrame) -> tuple[int, int]:
        r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        return r["n"], r["x"]

    def joined(links: DataFrame, key: str, other: str, least: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return links.withColumn("salt", salt).join(salted, [key, "salt"])

    edges = cut(edges.select("hi", "lo").distinct())
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both.where("v > u"), "u", "v", least).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = joined(large, "hi", "lo", least)
        edges = cut(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo").union(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bigint), component_id of every row.

    Fingerprints with more than ``1 / HOT`` of the rows, fewer than ``HOT`` of them, find their
    class by a broadcast table, so that their rows don't meet in one task.
    """
    marked = cut(add_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "fp"))
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(link(groups))
    known = cut(groups.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "first", "root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = known.join(least, "root").select("fp", "component_id")
    of_fp = cut(groups.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    many = (groups.agg(F.sum("n")).first()[0] or 0) / HOT
    hot, rest = of_fp.where(F.col("n") > many).drop("n"), of_fp.where(F.col("n") <= many).drop("n")
    first = marked.join(F.broadcast(hot.withColumnRenamed("fp", "hot_fp")), F.col("fp") == F.col("hot_fp"), "left")
    found = first.where("hot_fp IS NOT NULL").select("doc_id", "fp", "component_id")
    return found.union(first.where("hot_fp IS NULL").select("doc_id", "fp").join(rest, "fp").select("doc_id", "fp", "component_id"))


def first_rows(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key_col`` of one row of each class: that of the smallest doc_id, null last, then of the smallest key.

    Classes are told apart by their fingerprints, not by ids, so ids may be null or used again.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(key_col).alias("row_key"))
    marked = cut(add_fingerprint(rows).select("doc_id", "row_key", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    groups = cut(marked.groupBy("fp").agg(F.min(order).alias("head")))
    roots = components(link(groups))
    classes = groups.join(roots, F.col("fp") == F.col("node"), "left")
    return classes.groupBy(F.coalesce("root", "fp").alias("class")).agg(F.min("head").alias("head")).select(F.col("head.row_key").alias(key_col))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
