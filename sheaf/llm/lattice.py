"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors at random to one to three blocks of 8 dimensions and decodes each block to the nearest point of the lattice E8: the points
are the vector's cell. A vector is indexed in its cell, and looked for there and in the neighbouring cells whose borders it lies closest to. More
vectors take more blocks, so that the strangers in a cell stay few. Cells and ids are shuffled first; vectors follow only to cells in which something
meets. In a cell, lookups are compared with the indexed vectors by cosine, in blocks of bounded size. A pair that meets more than
once counts where it meets first, in the order of tables, which each task works out from the two vectors; so pairs need no shuffle of their
own. A task gives for each vector its number of partners, and a vector that it hangs together with.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import python_ready, table
from sheaf.operators.components import connected_components
from sheaf.session import discard, written

CELLS = "cid bigint, home boolean, tab int, cell bigint"
#: Pairs whose cosines are worked out at once.
PAIRS = 200_000


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1.0, 1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    p = np.rint(x)
    odd = np.flatnonzero(p.sum(1).astype(np.int64) & 1)
    off = x[odd] - p[odd]
    at = np.abs(off).argmax(1)
    p[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1, -1)
    return p


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of the even integer points and the same moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@dataclass(frozen=True)
class Lattice:
    """tables of projections to `blocks` of 8 dimensions, their scale, and the `probes` neighbouring cells that a vector is looked for in, of those within `margin`.

    A block's point may move to one of the `moves` nearest ones; a move costs the square of how far the border is (1: half a cell's width), and margin bounds the sum.
    """

    blocks: int = 1
    tables: int = 6
    scale: float = 0.75
    probes: int = 4
    moves: int = 4
    margin: float = 0.36
    seed: int = 17

    def projection(self, dims: int, t: int, block: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dims, t, block]).standard_normal((dims, 8)) * self.scale

    def cells(self, unit: np.ndarray, t: int) -> np.ndarray:
        """A row for each vector: the key of its home, then of the cells it is looked for in; repeats of home where there are fewer."""
        points, costs = [], []
        for block in range(self.blocks):
            x = unit @ self.projection(unit.shape[1], t, block)
            p = decode(x)
            inside = (x - p) @ roots().T
            near = np.argsort(-inside, axis=1, kind="stable")[:, : self.moves]
            points.append([p, *[p + roots()[near[:, k]] for k in range(self.moves)]])
            costs.append(np.concatenate([np.zeros((len(p), 1)), np.maximum(1 - np.take_along_axis(inside, near, 1), 0) ** 2], 1))
        ways = list(product(range(self.moves + 1), repeat=self.blocks))
        cost = np.stack([sum(c[:, k] for c, k in zip(costs, way, strict=True)) for way in ways], 1)
        cost[:, 0] = -1  # home comes first
        best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes + 1]
        key = np.zeros(best.shape, np.int64)
        for i, way in enumerate(ways):
            row, col = np.nonzero(best == i)
            if len(row):
                key[row, col] = self.key(np.concatenate([p[k][row] for p, k in zip(points, way, strict=True)], 1), unit.shape[1], t)
        return np.where(np.take_along_axis(cost, best, 1) <= self.margin, key, key[:, :1])

    @staticmethod
    def key(p: np.ndarray, dims: int, t: int) -> np.ndarray:
        h = np.full(len(p), np.uint64(0x9E3779B97F4A7C15 * (dims * 64 + t + 1) & 0xFFFFFFFFFFFFFFFF))
        for c in np.rint(2 * p).astype(np.int64).astype(np.uint64).T:
            h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def sized(n: int) -> Lattice:
    """The lattice for n vectors. Of pairs of a cosine of just 0.95, tables find all but about 1 in 1000, 250 and 200; strangers in a cell are about n / 1000, n / 80,000 and n / 1,500,000."""
    if n < 2000:
        return Lattice()
    return Lattice(2, 8, 0.6, 6, 4, 0.8) if n < 4_000_000 else Lattice(3, 10, 0.5, 8, 3, 1.2)


#: The lattice of all inputs: which pairs are found must not depend on how many rows there are. It is the one whose cells hold the fewest strangers.
USUAL = sized(4_000_000)


def unit(v: np.ndarray) -> np.ndarray:
    """v, each row at unit length; very large and small components are scaled first, so that their squares stay finite."""
    most = np.abs(v).max(1, keepdims=True)
    v = np.where((most > 1e100) | (most < 1e-100), v / most, v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _read(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _placed(lattice):
    """The cells of (cid, v), vectors of any lengths."""

    def run(batches):
        for b in batches:
            size = np.fromiter(map(len, b["v"].to_pylist()), np.int64, b.num_rows)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                v, cid = unit(_read(b["v"].take(pa.array(at)))), b["cid"].to_numpy()[at]
                for t in range(lattice.tables):
                    cells = lattice.cells(v, t)
                    fresh = np.stack([np.ones(len(v), bool), *[(cells[:, k, None] != cells[:, :k]).all(1) for k in range(1, cells.shape[1])]], 1)
                    row, col = np.nonzero(fresh)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[row]), pa.array(col == 0), pa.array(np.full(len(row), t, np.int32)), pa.array(cells[row, col])], names=["cid", "home", "tab", "cell"])

    return run


def _met(lattice, q: np.ndarray, h: np.ndarray, v: np.ndarray, tab: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """Which of the pairs of a lookup q and an indexed vector h, rows of v, meet in their table for the first time."""
    used, at = np.unique(np.concatenate([q, h]), return_inverse=True)
    a, b, t = at[: len(q)], at[len(q) :], tab[q]
    first = np.ones(len(q), bool)
    for s in range(int(t.max()) + 1):
        c = lattice.cells(v[used], s)
        looks, looked = (c[a] == c[b][:, :1]).any(1), (c[b] == c[a][:, :1]).any(1)
        first &= np.where(s < t, ~(looks | looked), np.where(s == t, (cid[q] < cid[h]) | ~looked, True))  # in one table the smaller vector's lookup comes first
    return first


def _close(v: np.ndarray, group: np.ndarray, asks: np.ndarray, holds: np.ndarray, cid: np.ndarray, least: float):
    """(q, h): rows of one group, of which q asks and h holds, whose vectors differ and have a cosine of least or more."""
    out = []

    def keep(q, h):
        ok = (cid[q] != cid[h]) & (np.einsum("ij,ij->i", v[q], v[h]) >= least)
        out.append((q[ok], h[ok]))

    qs, hs = np.flatnonzero(asks), np.flatnonzero(holds)
    groups = int(group[-1]) + 1
    nq, nh = np.bincount(group[qs], minlength=groups), np.bincount(group[hs], minlength=groups)
    start_q, start_h = np.cumsum(nq) - nq, np.cumsum(nh) - nh
    large = nq * nh > PAIRS
    for g in np.flatnonzero(large):
        a, b = qs[start_q[g] : start_q[g] + nq[g]], hs[start_h[g] : start_h[g] + nh[g]]
        for i in range(0, len(a), 512):
            x, y = np.nonzero(v[a[i : i + 512]] @ v[b].T >= least - 1e-9)  # sums in another order may fall on the other side of the bound: the last word is one formula's
            keep(a[i : i + 512][x], b[y])
    qs = qs[~large[group[qs]]]
    times = nh[group[qs]]
    ends = np.cumsum(times)
    begin = 0
    while begin < len(qs):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        n = times[begin:end]
        q = np.repeat(qs[begin:end], n)
        h = hs[np.repeat(start_h[group[qs[begin:end]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        keep(q, h)
        begin = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 .. n - 1 reachable from each over the links (a, b)."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(lattice, least):
    def one(x: pa.Table):
        size = np.fromiter(map(len, x["v"].to_pylist()), np.int64, x.num_rows)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            part = x.take(pa.array(at))
            keys = np.stack([part[c].to_numpy() for c in ("cell", "hb", "qb")], 1)
            group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
            v, cid, tab = unit(_read(part["v"])), part["cid"].to_numpy(), part["tab"].to_numpy()
            q, h = _close(v, group, part["asks"].to_numpy(), part["holds"].to_numpy(), cid, least)
            if not len(q):
                continue
            ids, row = np.unique(cid, return_inverse=True)
            root = smallest(row[q], row[h], len(ids))
            first = _met(lattice, q, h, v, tab, cid)
            q, h, members = q[first], h[first], part["n"].to_numpy()
            links = np.bincount(row[q], members[h], len(ids)) + np.bincount(row[h], members[q], len(ids))
            some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some].astype(np.int64))], names=["cid", "root", "links"])

    def run(batches):
        held = None
        for b in batches:
            x = pa.Table.from_batches([b])
            held = pa.concat_tables([held, x]) if held is not None and held.num_rows else x
            if held.num_rows < 2000:
                continue
            keys = np.stack([held[c].to_numpy() for c in ("cell", "hb", "qb")], 1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if len(edge):
                yield from one(held.slice(0, int(edge[-1])).combine_chunks())
                held = held.slice(int(edge[-1]))
        if held is not None and held.num_rows:
            yield from one(held.combine_chunks())

    return run


def links(vectors: DataFrame, lattice: Lattice, least: float = 0.95, block_rows: int = 2000) -> DataFrame:
    """(cid, root, links): for classes of equal vectors (cid, n members, v as packed doubles), how many members of other classes
    each links to, in several rows, and classes that it hangs together with; written.

    A cell of many vectors is split in blocks of about block_rows on either side; every block of lookups meets every block
    of indexed vectors.
    """
    python_ready(vectors.sparkSession)
    rows = written(vectors.select("cid", "v").mapInArrow(_placed(lattice), CELLS))
    size = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    busy = size.where("homes > 0 and all > 1").select("cell", F.ceil(F.col("homes") / block_rows).alias("nh"), F.ceil(F.col("all") / block_rows).alias("nq"))
    x = rows.join(busy, "cell")
    # A row asks in its block of lookups, against every block of indexed vectors; one at home also stands in a block of these, for every block of lookups.
    own = lambda n: F.pmod(F.xxhash64("cid", F.lit(n)), F.col(n))
    every = lambda n, of: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), of)
    at = lambda asks, holds, hb, qb: F.struct(F.lit(asks).alias("asks"), F.lit(holds).alias("holds"), hb.alias("hb"), qb.alias("qb"))
    zero = F.lit(0).cast("bigint")
    split = F.concat(every("nh", lambda i: at(True, False, i, own("nq"))), F.when(F.col("home"), every("nq", lambda i: at(False, True, own("nh"), i))).otherwise(F.array().cast("array<struct<asks:boolean,holds:boolean,hb:bigint,qb:bigint>>")))
    whole = F.array(F.struct(F.lit(True).alias("asks"), F.col("home").alias("holds"), zero.alias("hb"), zero.alias("qb")))
    x = x.select("cid", "tab", "cell", F.explode(F.when((F.col("nh") == 1) & (F.col("nq") == 1), whole).otherwise(split)).alias("at")).select("cid", "tab", "cell", "at.*")
    keys = ["cell", "hb", "qb"]
    placed = x.join(vectors.select("cid", "n", "v"), "cid").repartition(*keys).sortWithinPartitions(*keys)
    out = written(placed.mapInArrow(_compared(lattice, least), "cid bigint, root bigint, links bigint"))
    discard(rows)
    return out


def groups(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, lattice: Lattice | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Vectors of any label are compared, with those of their own length. A vector that is null, empty, zero or holds a null or a non-finite component links with
    nothing. Equal vectors are a class and link with each other; a row whose key repeats counts each time. Rows with a null key take part, but give no
    component their key: where all keys of one are null, so is component_id. Components are the smallest keys whatever the order of rows, so ties don't arise; other columns aren't
    read. An empty table gives no rows. The lattice is the same for tables of any size, where none is given.
    """
    spark = rows.sparkSession
    python_ready(spark)
    packed = rows.select(F.col(key).alias("k"), F.arrow_udf(_packed, "binary")(F.col(vector).cast("array<double>")).alias("v"))
    packed = written(packed.withColumn("h", F.unhex(F.sha2("v", 256))))
    fine = packed.where("v is not null")
    classes = fine.groupBy("h").agg(F.min("k").alias("key"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    flat = written(classes.select(F.monotonically_increasing_id().alias("cid"), "h", "key", "n", "v"))
    met = links(flat, lattice or USUAL, least)
    degree = met.groupBy("cid").agg(F.sum("links").alias("links"))
    # A node is struct(the class has no key, its smallest key, cid), in this order, so that the smallest node of a component has its smallest key.
    node = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("cid"))
    at = lambda end, out: flat.select(F.col("cid").alias(end), node.alias(out))
    edges = met.where("cid <> root").select("cid", "root").distinct().join(at("cid", "a"), "cid").join(at("root", "b"), "root")
    comp = connected_components(edges.select("a", "b"), "a", "b").select(F.col("node.cid").alias("cid"), F.col("component.key").alias("least"), F.col("component.none").alias("none"))
    found = flat.select("cid", "h", "n", "key").join(degree, "cid", "left").join(comp, "cid", "left")
    found = written(found.select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("none").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id")))
    discard(flat, met)
    linked = fine.select("k", "h").join(found, "h").select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = packed.where("v is null").select(F.col("k").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


def _packed(v: pa.Array) -> pa.Array:
    """The doubles of each vector, with one form of zero; null for a vector that links with nothing."""
    flat = v.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    size = np.array(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    end = np.cumsum(size)
    out = []
    for a, b in zip(end - size, end, strict=True):
        one = x[a:b]
        out.append(one.tobytes() if b > a and np.isfinite(one).all() and one.any() else None)
    return pa.array(out, pa.binary())


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector of embeddings."""
    return groups(table(spark, sf_dir, "embeddings"))
