"""Near-duplicate vectors by cover trees and dual traversal: all pairs at a cosine threshold, exactly.

Unit vectors at a cosine of t are sqrt(2 - 2t) apart. The vectors of a label are dealt to cells, each
around a pivot, a cell's to rings by their distance from it, and large rings to blocks of bounded size. Each block gets a cover tree: nested levels of
centres with halving radii, where every node knows the distance to its farthest descendant. Two trees are
traversed together, level by level: a pair of nodes whose centres are farther apart than the threshold
and both covering radii is pruned with all below it; a pair so close that all below must link
is counted as a whole; the others are split into their children. Rings are the level above: a vector meets a ring's
blocks only if its own distance from that ring's pivot is within the threshold of the ring's.

A pair of blocks gives its vectors' numbers of links and the edges of a spanning forest, both of the
length of the blocks. Equal vectors of a label are one vector with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.let import let
from readloom.llm.common import components, cut

#: Bounds within this of the threshold are left to the cosine itself.
SLACK = 1e-6
#: Vectors of a block; pivots of a label, one for each EACH vectors at most, and the bytes of all pivots together (these are broadcast).
BLOCK, PIVOTS, PIVOT_BYTES = 4096, 1024, 64 << 20
EACH = 32
#: Bytes of vectors in a batch that a task sends on.
SENT = 16 << 20


def unit(v: Column) -> Column:
    """The vector in doubles with a length of 1; null if it is null, empty, zero or has a component that is
    null or not finite."""

    def scaled(d: Column) -> Column:
        fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        most = F.array_max(F.transform(d, lambda x: F.abs(x)))  # taken out first, so that squares neither vanish nor overflow
        return F.when(F.coalesce(fine, F.lit(False)) & (most > 0), let(most, lambda m: let(F.transform(d, lambda x: x / m), normal)))

    def normal(e: Column) -> Column:
        return let(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(e, lambda x: x / n))

    return let(F.transform(v, lambda x: x.cast("double")), scaled)


def apart(c: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their cosines."""
    return np.sqrt(np.maximum(2 - 2 * c, 0))


class Level:
    """Nodes of one level: the row that is each one's centre, the node's parent in the level above, the covering
    radius, and the weight of the rows below."""

    def __init__(self, centres: np.ndarray, parent: np.ndarray):
        self.centres, self.parent = centres, parent
        self.radius = self.weight = self.node = np.empty(0)


class Tree:
    """A cover tree over the rows of x, unit vectors. The last level has every row as a node."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, smallest: float = 0.02):
        self.x = x
        n = len(x)
        centres, radius = np.zeros(1, np.int64), 2.0
        levels = [Level(centres, np.zeros(1, np.int64))]
        nearest, distance = np.zeros(n, np.int64), apart(x @ x[0])  # of each row, the centre in `centres`
        while len(centres) < n:
            radius /= 2
            above, before = nearest.copy(), len(centres)
            if radius < smallest:
                rest = np.setdiff1d(np.arange(n), centres)
                centres = np.concatenate([centres, rest])
            else:
                left = np.flatnonzero(distance > radius)
                while len(left):
                    some = left[:256]
                    close = apart(x[some] @ x[some].T) <= radius
                    free, new = np.ones(len(some), bool), []
                    for i in range(len(some)):
                        if free[i]:
                            new.append(some[i])
                            free &= ~close[i]
                    new = np.array(new)
                    d = apart(x @ x[new].T)
                    best = d.argmin(1)
                    least = d[np.arange(n), best]
                    nearer = least < distance
                    nearest[nearer], distance[nearer] = len(centres) + best[nearer], least[nearer]
                    nearest[new], distance[new] = len(centres) + np.arange(len(new)), 0
                    centres = np.concatenate([centres, new])
                    left = left[distance[left] > radius]
            if len(centres) > before:
                levels.append(Level(centres, above[centres]))
        if n > 1 and len(levels[-1].centres) < n:
            raise AssertionError("rows are missing from the last level")
        node = np.empty(n, np.int64)
        node[levels[-1].centres] = np.arange(n)
        for k in range(len(levels) - 1, -1, -1):
            v = levels[k]
            v.node, v.radius = node, np.zeros(len(v.centres))
            np.maximum.at(v.radius, node, apart(np.einsum("ij,ij->i", x, x[v.centres[node]])))
            v.radius[v.radius < 1e-7] = 0  # a centre's distance to itself, by rounding
            v.weight = np.bincount(node, weights=weight, minlength=len(v.centres))
            node = v.parent[node]
        self.levels = levels


def dual(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a the weight of b's rows that it links to, the same for b, and links (row of a, row of b,
    b's rows after a's, or rows of one side) that connect what all links connect."""
    eps = math.sqrt(2 - 2 * cosine)
    n_a, n_b, u, v = np.zeros(len(a.x)), np.zeros(len(b.x)), [], []
    active = np.ones((1, 1), bool)
    for k in range(depth := max(len(a.levels), len(b.levels))):
        la, lb = a.levels[min(k, len(a.levels) - 1)], b.levels[min(k, len(b.levels) - 1)]
        if 0 < k < len(a.levels):
            active = active[la.parent]
        if 0 < k < len(b.levels):
            active = active[:, lb.parent]
        i, j = np.flatnonzero(active.any(1)), np.flatnonzero(active.any(0))
        if not len(i):
            break
        on = active[np.ix_(i, j)]
        c = a.x[la.centres[i]] @ b.x[lb.centres[j]].T
        if k == depth - 1:
            whole = on & (c >= cosine)
        else:
            d, reach = apart(c), la.radius[i][:, None] + lb.radius[j][None, :]
            whole = on & (d + reach <= eps - SLACK)
            active[np.ix_(i, j)] = on & ~whole & (d <= eps + reach + SLACK)
        if whole.any():
            gain_a, gain_b = np.zeros(len(la.centres)), np.zeros(len(lb.centres))
            gain_a[i], gain_b[j] = whole @ lb.weight[j], whole.T @ la.weight[i]
            n_a += gain_a[la.node]
            n_b += gain_b[lb.node]
            p, q = np.nonzero(whole)
            u.append(la.centres[i[p]])
            v.append(lb.centres[j[q]] + len(a.x))
            for level, gain, shift in ((la, gain_a, 0), (lb, gain_b, len(a.x))):
                rows = np.flatnonzero(gain[level.node] > 0)  # all below such a node are connected with its centre
                u.append(rows + shift)
                v.append(level.centres[level.node[rows]] + shift)
    none = [np.empty(0, np.int64)]
    return n_a, n_b, np.concatenate(none + u), np.concatenate(none + v)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that it is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def block_pair(rows: pa.Table, cosine: float) -> pa.Table:
    """Partial results (id, other, n) of one pair of blocks: numbers of links, and forest edges."""
    ids, weight, side = (rows.column(c).to_numpy() for c in ("id", "copies", "side"))
    x = rows.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    parts = [np.flatnonzero(side == s) for s in (0, 1)]
    alone = rows.column("alone")[0].as_py()
    if not alone and not (len(parts[0]) and len(parts[1])):
        return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    order = parts[0] if alone else np.concatenate(parts)
    a = Tree(x[parts[0]], weight[parts[0]])
    b = a if alone else Tree(x[parts[1]], weight[parts[1]])
    n_a, n_b, u, v = dual(a, b, cosine)
    if alone:
        n, v, u = n_a, v % len(order), u % len(order)
    else:
        n = np.concatenate([n_a, n_b])
    ids = ids[order]
    root = forest(u, v, len(ids))
    linked, joined = np.flatnonzero(n > 0), np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"id": pa.array(np.concatenate([ids[linked], ids[joined]]), pa.int64()), "other": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(ids[root[joined]], pa.int64())]), "n": pa.array(np.concatenate([n[linked], np.zeros(len(joined))]).astype(np.int64))})


class Space:
    """How the vectors of one large label are dealt: cells around pivots, a cell's rings by the distance from its pivot, rings of up to
    `wide`; small rings share a block, those near their pivots apart from those far away; a large ring's vectors are dealt to blocks by
    a hash."""

    def __init__(self, centres: np.ndarray, bars: np.ndarray, block: int, wide: float = 0.19):
        """bars: for each cell, how many vectors there are in each of BARS ranges of the distance."""
        self.centres = centres
        step = max(1, int(wide * BARS / FARTHEST))
        cell, bar = np.nonzero(bars)
        # A ring begins with a cell's first range that isn't empty, and where the one before would get too wide.
        rings, self.ring_of = [], np.full(bars.shape, -1, np.int64)
        for c, k in zip(cell.tolist(), bar.tolist()):
            if not rings or rings[-1][0] != c or k - rings[-1][1] >= step:
                rings.append([c, k, k, 0])
            rings[-1][2], rings[-1][3] = k, rings[-1][3] + int(bars[c, k])
            self.ring_of[c, k] = len(rings) - 1
        self.cell, low, high, n = (np.array(x) for x in zip(*rings))
        self.low, self.high = low * FARTHEST / BARS, (high + 1) * FARTHEST / BARS
        self.first, self.blocks, held, at = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), 0, 0
        for r in np.lexsort((self.cell, low)).tolist():
            if held and held + n[r] > block:
                at, held = at + 1, 0
            self.first[r] = at
            if n[r] > block:
                self.blocks[r] = -(-int(n[r]) // block)
                at += int(self.blocks[r])
            else:
                held += int(n[r])
        self.n_blocks = at + bool(held)

    def pairs(self, x: np.ndarray, cell: np.ndarray, bar: np.ndarray, number: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For vectors with cells, ranges and hashes: each one's own block, and (row, block) wherever a block may hold something within eps of it. By the
        triangle inequality such a thing is as far from its pivot as the vector is, give or take eps."""
        d = apart(x @ self.centres.T)
        ring = self.ring_of[cell, bar]
        own = self.first[ring] + number % self.blocks[ring]
        far = d[:, self.cell]
        row, near = np.nonzero((far >= self.low - eps - SLACK) & (far <= self.high + eps + SLACK))
        times = self.blocks[near]
        block = np.repeat(self.first[near], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        both = np.unique(np.concatenate([np.repeat(row, times) * self.n_blocks + block, np.arange(len(x)) * self.n_blocks + own]))
        return own, both // self.n_blocks, both % self.n_blocks


#: Ranges of the distance from a pivot that are counted, and the farthest that unit vectors are apart, with room for rounding.
BARS, FARTHEST = 256, 2.0001


def bar_of(far: np.ndarray) -> np.ndarray:
    return np.minimum((far * (BARS / FARTHEST)).astype(np.int64), BARS - 1)


def flat(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    """The vectors of some rows, which have one length."""
    return batch.column("unit").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def layout(vectors: DataFrame, block: int, pivots: int, pivot_bytes: int) -> tuple[dict[str, Space], DataFrame]:
    """The large spaces of `vectors`, and its rows with cell and bar, 0 outside them. Every one has pivots, up to `pivots` and at least one, fewer for all where they would take more
    than `pivot_bytes`; what the driver holds is a row for each large space, its pivots, and counts of ranges of their cells."""
    spark = vectors.sparkSession
    large = vectors.groupBy("space").agg(F.count("*").alias("n"), F.first(F.size("unit")).alias("size")).where(F.col("n") > block).collect()
    if not large:
        nothing = F.lit(0)
        return {}, vectors.select("space", "unit", "id", "copies", nothing.alias("cell"), nothing.alias("bar"))
    want = {r.space: min(pivots, -(-r.n // EACH)) for r in large}
    scale = min(1, pivot_bytes / sum(8 * r.size * want[r.space] for r in large))
    names = spark.createDataFrame([(s, max(1, int(w * scale))) for s, w in want.items()], "space string, want int")
    # The vector of least hash among each of `want` shares of a space.
    some = vectors.join(F.broadcast(names), "space").groupBy("space", F.pmod(F.xxhash64("id", F.lit(7)), "want")).agg(F.min_by("unit", F.xxhash64("id", F.lit(8))).alias("unit"))
    got = some.select("space", "unit").toArrow()
    spaces = np.array(got.column("space").to_pylist(), object)
    chosen = {s: flat(got.combine_chunks().to_batches()[0], np.flatnonzero(spaces == s)) for s in want}
    shared = spark.sparkContext.broadcast(chosen)

    def to_cells(batches):
        for batch in batches:
            space = np.array(batch.column("space").to_pylist(), object)
            cell, bar = np.zeros((2, len(space)), np.int64)
            for s in set(space.tolist()) & set(shared.value):
                at = np.flatnonzero(space == s)
                d = apart(flat(batch, at) @ shared.value[s].T)
                cell[at] = d.argmin(1)
                bar[at] = bar_of(d[np.arange(len(at)), cell[at]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(bar, pa.int32())], [*batch.schema.names, "cell", "bar"])

    # Kept, so that a vector's ring is that by which it was counted, whatever rounding does in another batch.
    celled = cut(vectors.select("space", "unit", "id", "copies").mapInArrow(to_cells, "space string, unit array<double>, id long, copies long, cell int, bar int"))
    bars = {s: np.zeros((len(c), BARS), np.int64) for s, c in chosen.items()}
    for r in celled.join(F.broadcast(names), "space").groupBy("space", "cell", "bar").agg(F.count("*").alias("n")).toLocalIterator():
        bars[r.space][r.cell, r.bar] = r.n
    shared.unpersist()
    return {s: Space(c, bars[s], block) for s, c in chosen.items()}, celled


def links(vectors: DataFrame, cosine: float, block: int = BLOCK, pivots: int = PIVOTS, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """Partial results of all pairs of blocks. vectors: distinct (space, unit) with id and copies."""
    spark, eps = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    spaces, celled = layout(vectors, block, pivots, pivot_bytes)
    shared = spark.sparkContext.broadcast(spaces)

    def to_pairs(batches):
        """A vector for each block that it may have links in, with the pair of that block and its own."""

        def out(batch, at, key, side, alone):
            part = batch.take(pa.array(at))
            columns = [part.column(c) for c in ("space", "id", "copies", "unit")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(key, pa.string()), pa.array(side, pa.int32()), pa.array(alone, pa.bool_())], ["space", "id", "copies", "unit", "key", "side", "alone"])

        for batch in batches:
            space = np.array(batch.column("space").to_pylist(), object)
            known = {s: np.flatnonzero(space == s) for s in set(space.tolist()) & set(shared.value)}
            rest = np.setdiff1d(np.arange(len(space)), np.concatenate([np.empty(0, np.int64), *known.values()]))
            if len(rest):
                yield out(batch, rest, ["0-0"] * len(rest), np.zeros(len(rest)), np.ones(len(rest), bool))
            cell, bar = (batch.column(c).to_numpy() for c in ("cell", "bar"))
            number = (batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
            for s, at in known.items():
                for a in range(0, len(at), 256):
                    rows = at[a : a + 256]
                    x = flat(batch, rows)
                    own, row, other = shared.value[s].pairs(x, cell[rows], bar[rows], number[rows], eps)
                    mine = own[row]
                    low, high = np.minimum(mine, other), np.maximum(mine, other)
                    step = max(1, SENT // (8 * x.shape[1] + 100))  # rows of a batch that is sent
                    for k in range(0, len(row), step):
                        cut_ = slice(k, k + step)
                        key = [f"{i}-{j}" for i, j in zip(low[cut_].tolist(), high[cut_].tolist())]
                        yield out(batch, rows[row[cut_]], key, mine[cut_] > other[cut_], mine[cut_] == other[cut_])

    kind = "space string, id long, copies long, unit array<double>, key string, side int, alone boolean"
    pairs = celled.mapInArrow(to_pairs, kind)
    return pairs.groupBy("space", "key").applyInArrow(lambda t: block_pair(t, cosine), "id long, other long, n long")


def near_vectors(df: DataFrame, cosine: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row. Vectors link if their labels are equal and not null, their
    lengths are equal, and their cosine in double precision is at least `cosine`. A vector that is null, zero or
    has a null or non-finite component links with nothing, nor does a row without an id (its component is null
    and it isn't kept). Repeated rows stay repeated and count as each other's links. An empty table gives no rows; further columns
    of `df` don't matter, whatever their names."""
    v = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), unit(F.col(vector_column)).alias("unit"))
    v = cut(v.withColumn("unit", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.col("unit"))))
    fine = v.where("unit is not null").withColumn("space", F.struct("label", F.size("unit").alias("n")).cast("string"))
    distinct = cut(fine.groupBy("space", "unit").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    parts = cut(links(distinct.select("space", "unit", "id", "copies"), cosine, block, pivots))
    counts = parts.where("other is null").groupBy("id").agg((F.sum("n") - 1).alias("n_links"))
    roots = components(parts.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = distinct.join(counts, "id").join(roots, distinct["id"] == roots["node"], "left").select("space", "unit", "first", "n_links", F.coalesce("root", "id").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(best, "root").select("space", "unit", "n_links", "component_id")
    done = fine.join(named, ["space", "unit"]).select("id", "n_links", "component_id")
    rest = v.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = done.unionByName(rest)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = """
with recursive v as (
  select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n_links from p group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.a = e.vec_id left join n on n.a = e.vec_id
"""
