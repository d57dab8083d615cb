"""Exact cosine near-duplicates by dual traversal of cover trees.

On the unit sphere a cosine of at least t is an angle of at most acos(t), and angles are a metric. The top of the tree
is distributed: vectors go to the cell of the nearest pivot of their label, and a vector visits another cell only if
its angle to that cell's pivot is no more than the cell's covering radius and acos(t) together; of two cells only the
first's vectors visit the second. In each cell the own vectors and the visitors get cover trees, of nested levels with
halving radii, and the traversal prunes pairs of nodes by the same bound; a pair of nodes that lies wholly within the
angle counts as linked without looking at its points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, only
from panelwright.llm.components import connected_components

#: Vectors of a cell's part, in expectation, and pivots, which are broadcast; with more vectors cells have more parts.
CELL, MOST_PIVOTS = 1500, 20_000
LEAF = 24
SLACK = 1e-7
#: Pairs that are verified at a time.
CHUNK = 1 << 17


class Node:
    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre: int, radius: float, points: np.ndarray, children: list[Node]) -> None:
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles between unit vectors."""
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def build(x: np.ndarray) -> Node:
    """The cover tree of unit vectors: each level's centres cover their points within half the level above's radius."""

    def grow(centre: int, points: np.ndarray, d: np.ndarray, cover: float) -> Node:
        radius = float(d.max())
        if len(points) <= LEAF or radius < 1e-6:
            return Node(centre, radius, points, [])
        while cover >= radius:
            cover /= 2
        children = []
        while len(points):
            near = d <= cover
            children.append(grow(centre, points[near], d[near], cover))
            points = points[~near]
            if len(points):
                centre = int(points[0])
                d = distances(x[points], x[centre : centre + 1])[:, 0]
                d[0] = 0.0
        return Node(int(children[0].centre), radius, np.concatenate([c.points for c in children]), children)

    d = distances(x, x[:1])[:, 0]
    d[0] = 0.0
    return grow(0, np.arange(len(x)), d, 4.0)


def dual(x: np.ndarray, a: Node, y: np.ndarray, b: Node, most: float):
    """Yields (points of x, points of y, whole): pairs to verify, or if whole two sets of points that are linked throughout."""
    left, right, held = [], [], 0
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        ps = p.children or [p]
        qs = q.children or [q]
        d = distances(x[[n.centre for n in ps]], y[[n.centre for n in qs]])
        reach = np.array([n.radius for n in ps])[:, None] + np.array([n.radius for n in qs])[None, :]
        inside = d + reach <= most - SLACK
        for i, j in np.argwhere(inside).tolist():
            yield ps[i].points, qs[j].points, True
        for i, j in np.argwhere((d <= reach + most + SLACK) & ~inside).tolist():
            if ps[i].children or qs[j].children:
                stack.append((ps[i], qs[j]))
            else:
                own, other = ps[i].points, qs[j].points
                left.append(np.repeat(own, len(other)))
                right.append(np.tile(other, len(own)))
                held += len(left[-1])
                if held >= CHUNK:
                    yield np.concatenate(left), np.concatenate(right), False
                    left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right), False


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least point reachable from each of n points by the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meet(x: np.ndarray, y: np.ndarray | None, threshold: float, weight_x: np.ndarray, weight_y: np.ndarray):
    """(links of each x, links of each y, root of each of x then y) between two sets, or within one if y is None.

    Links are folded into counts and roots as they are found, so that memory follows the points, not the links.
    """
    same = y is None
    other, wx = (x, weight_x) if same else (y, weight_y)
    shift = 0 if same else len(x)
    norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((other * other).sum(axis=1))
    ux, uy = x / norm_x[:, None], other / norm_y[:, None]
    tree = build(ux)
    n_x, n_y, root = np.zeros(len(x)), np.zeros(len(other)), np.arange(shift + len(other))
    a, b, waiting = [], [], 0
    for i, j, whole in dual(ux, tree, uy, tree if same else build(uy), math.acos(threshold)):
        if whole:
            n_x[i] += wx[j].sum()
            n_y[j] += weight_x[i].sum()
            if same:
                both = np.intersect1d(i, j)
                n_x[both] -= weight_x[both]
            a += [i, np.full(len(j), i[0])]
            b += [np.full(len(i), j[0] + shift), j + shift]
        else:
            keep = np.empty(len(i), bool)
            for lo in range(0, len(i), 1 << 14):
                s = slice(lo, lo + (1 << 14))
                keep[s] = (x[i[s]] * other[j[s]]).sum(axis=1) / (norm_x[i[s]] * norm_y[j[s]]) >= threshold
            i, j = i[keep], j[keep]
            if same:
                i, j = i[i != j], j[i != j]
            if not len(i):
                continue
            n_x += np.bincount(i, wx[j], len(x))
            n_y += np.bincount(j, weight_x[i], len(other))
            a.append(i)
            b.append(j + shift)
        waiting += len(a[-1]) + len(a[-2] if whole else [])
        if waiting >= CHUNK:
            root, a, b, waiting = _roots(len(root), np.concatenate([np.arange(len(root)), *a]), np.concatenate([root, *b])), [], [], 0
    return n_x, n_y, _roots(len(root), np.concatenate([np.arange(len(root)), *a]), np.concatenate([root, *b]))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Two vectors link when their labels and lengths are equal and their cosine in double precision is at least
    threshold. Null labels, null, empty or zero vectors, and vectors with null or non-finite components link with
    nothing. Equal vectors are one point with a weight. Repeated rows count as other vectors; a null vec_id gives null
    component_id and is linked with nothing; other columns are ignored; an empty table gives an empty table.
    """
    rows = only(vectors, vec_id, vector, label).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))  # null, NaN or infinite if a component is
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((squares > 0) & (squares < float("inf")) & ~F.isnan(squares), F.lit(False))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    points = cut(rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("key", F.struct("label", F.size("v").alias("length"))))
    spark, total = vectors.sparkSession, points.count()
    each = max(CELL, math.ceil(total / MOST_PIVOTS))  # vectors for a pivot; parts of cells stay at CELL
    counts = points.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    place = F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(1 << 40)) / (1 << 40)
    share = F.ceil(F.col("n") / each) / F.col("n")
    chosen = points.join(counts, "key").where(place < share).select(F.to_json("key").alias("k"), "rep", "v").orderBy("k", "rep").toArrow()  # MOST_PIVOTS in expectation, and one for each label that is larger than a cell
    by_key: dict[str, np.ndarray] = {}
    names = chosen.column("k").to_pylist()
    for k in dict.fromkeys(names):
        x = _matrix(chosen.column("v").take(pa.array([i for i, n in enumerate(names) if n == k])))
        by_key[k] = x / np.linalg.norm(x, axis=1)[:, None]
    pivots = spark.sparkContext.broadcast(by_key)
    kind = dict(points.dtypes)["v"]

    def angles(batch, column: int):
        """(key, places in the batch, angles to the key's pivots) for each key that has pivots, in steps of bounded size."""
        own, keys = pivots.value, np.array(batch.column(0).to_pylist(), object)
        for k in sorted(set(keys.tolist()) & set(own)):
            at = np.flatnonzero(keys == k)
            step = max(1, (1 << 22) // len(own[k]))
            for lo in range(0, len(at), step):
                x = _matrix(batch.column(column).take(pa.array(at[lo : lo + step])))
                yield k, at[lo : lo + step], distances(x / np.linalg.norm(x, axis=1)[:, None], own[k])

    def assign(batches):
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for _, at, d in angles(batch, 2):
                cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["k", "rep", "v", "m", "hash", "cell", "far"])

    homed = cut(points.select(F.to_json("key").alias("k"), "rep", "v", "m", F.xxhash64("v").alias("hash")).mapInArrow(assign, f"k string, rep long, v {kind}, m long, hash long, cell int, far double"))
    cells = cut(homed.groupBy("k", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("parts")))
    known = cells.where(F.col("k").isin([*by_key]) if by_key else F.lit(False)).select("k", "cell", "radius").collect()  # at most as many as pivots
    radius = {k: np.full(len(x), -1.0) for k, x in by_key.items()}  # a pivot without points is visited by none
    for r in known:
        radius[r["k"]][r["cell"]] = r["radius"]
    radii = spark.sparkContext.broadcast(radius)
    most = math.acos(threshold)

    def visit(batches):
        """The later cells of its key that each vector must visit."""
        for batch in batches:
            cell, rows, visited = batch.column(5).to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, at, d in angles(batch, 2):
                of = radii.value[k]
                r, c = np.nonzero((d <= of + most + SLACK) & (of >= 0) & (np.arange(len(of)) > cell[at][:, None]))
                rows.append(at[r])
                visited.append(c)
            part = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(4), pa.array(np.concatenate(visited).astype(np.int32))], ["k", "rep", "hash", "cell"])

    visits = cut(homed.mapInArrow(visit, "k string, rep long, hash long, cell int"))
    crowds = visits.groupBy("k", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("crowds"))
    cells = cut(cells.select("k", "cell", "parts").join(crowds, ["k", "cell"], "left"))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_part = F.pmod(F.xxhash64("rep", F.lit(12)), "parts").cast("int")
    hosts = homed.join(cells, ["k", "cell"]).withColumn("part", own_part)
    # a cell's parts meet each other, and its visitors, dealt into crowds of bounded size, meet every part
    own = hosts.select("k", "cell", "rep", "v", "m", "part", many("parts").alias("other"))
    own = own.select("k", "cell", "rep", "v", "m", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") <= F.col("other")).alias("first"))
    hosts = hosts.where("crowds > 0").select("k", "cell", "rep", "v", "m", many("crowds").alias("low"), F.col("part").alias("high"), F.lit(False).alias("first")).withColumn("low", -1 - F.col("low"))
    coming = visits.join(cells, ["k", "cell"]).withColumn("low", -1 - F.pmod(F.xxhash64("rep", F.lit(13)), "crowds").cast("int")).select("k", "cell", "rep", "hash", "low", many("parts").alias("high"))
    coming = coming.join(homed.select("k", "rep", "hash", "v", "m"), ["k", "rep", "hash"]).select("k", "cell", "rep", "v", "m", "low", "high", F.lit(True).alias("first"))
    sent = own.unionByName(hosts).unionByName(coming)

    def traverse(key, group):
        first = group.column("first").to_numpy(zero_copy_only=False).astype(bool)
        rep, m = group.column("rep").to_numpy(), group.column("m").to_numpy().astype(np.float64)
        if key[2].as_py() == key[3].as_py():
            n, _, root = meet(_matrix(group.column("v")), None, threshold, m, m)
            own = rep
        else:
            order = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
            cut_at = int(first.sum())
            x, own, m = _matrix(group.column("v"))[order], rep[order], m[order]
            if not cut_at or cut_at == len(own):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
            n_x, n_y, root = meet(x[:cut_at], x[cut_at:], threshold, m[:cut_at], m[cut_at:])
            n = np.concatenate([n_x, n_y])
        hit = n > 0
        return pa.table({"a": pa.array(own[hit]), "b": pa.array(own[root[hit]]), "n": pa.array(np.rint(n[hit]).astype(np.int64))})

    links = cut(sent.groupBy("k", "cell", "low", "high").applyInArrow(traverse, "a long, b long, n long"))
    joined = connected_components(links, "a", "b").withColumnRenamed("id", "rep")
    linked = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = points.select("label", "v", "rep", "m").join(linked, "rep", "left").join(joined, "rep", "left")
    named = named.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    sound_rows = rows.where("sound").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound_rows.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
