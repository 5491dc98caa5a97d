"""Exact Lloyd rounds over integer vectors by two trees: a cover tree over vectors, a tree over the centroids of a round.

Vectors are dealt into blocks, and every block keeps a cover tree of its vectors, made once: a node covers its
vectors within a power of BASE of its first one, the first ones of its children lie further from each other than
the next lower power, and a node knows the true distance of its furthest vector. The tree over the few
centroids is made anew each round. Going down both at once, a pair of nodes is dropped when no vector of the one
can be as near to any centroid of the other as to one that is known; a node left with one centroid goes to
it whole, and small nodes compare each of their vectors with the centroids left. All numbers that
decide are integers; distances between nodes carry a margin above any rounding.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import shuffle_width, table, whole_groups

DIM, CENTROIDS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2"
BLOCK = 4096  # vectors of a tree
BASE = 1.3  # radii of two levels of a tree; 2 makes stars of vectors that are all about as far from each other
LEAF = 16  # vectors that are compared one by one
SMALL = 1 << 21  # components up to here: squared distances stay exact as doubles (64 components)
MARGIN = 1e-9
LIMB = 48  # bits of a sum that travel in one number
FINITE = 1e150  # components from here on count as infinite, as squares of such numbers are no doubles


def exact(x: np.ndarray) -> np.ndarray:
    """Rows of integers in the cheapest type that keeps squared distances exact: doubles, else Python integers."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(np.float64) if top < SMALL and top * top * 4 * max(1, x.shape[1]) < 1 << 52 else x.astype(object)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, exact for rows made by ``exact``."""
    if x.dtype != y.dtype:
        x, y = x.astype(object), y.astype(object)
        x, y = (np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) for a in (x, y))
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def scaled(v: list, scale: int = SCALE) -> list[int]:
    return [int(np.floor(scale * x)) for x in v]


def root_of(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(d.astype(np.float64), 0))


class CoverTree:
    """A cover tree over the rows of x, in preorder: node k is led by row lead[k] and covers rows lo[k] .. hi[k].

    order says which row of x stands where; first[k] .. first[k + 1] are the children of node k, none for leaves.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        lo, hi, lead, far, kids = [], [], [], [], []
        todo = [(np.arange(len(x)), None, None)] if len(x) else []
        queue = 0
        orders: list[np.ndarray] = []
        spans = []
        # breadth first, so that children of a node have consecutive numbers; rows get their places afterwards
        while queue < len(todo):
            rows, d, level = todo[queue]
            queue += 1
            if d is None:
                d = root_of(squares(x[rows], x[rows[:1]])[:, 0])
            reach = d.max()
            lead.append(rows[0])
            far.append(reach)
            at = len(todo)
            if len(rows) > leaf and reach > 0:
                fits = np.ceil(np.log(reach) / np.log(BASE))
                level = fits if level is None else min(level, fits)
                radius = BASE ** (level - 1)
                left, dl = rows, d
                head = True
                while left.size:
                    near = dl <= radius if head else None
                    if not head:
                        dl = root_of(squares(x[left], x[left[:1]])[:, 0])
                        near = dl <= radius
                    todo.append((left[near], dl[near], level - 1))
                    left, dl = left[~near], dl[~near]
                    head = False
            kids.append((at, len(todo)))
            spans.append(rows)
        n = len(todo)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size = np.array([len(r) for r in spans], np.int64)
        for k in range(n):
            a, b = kids[k]
            hi[k] = lo[k] + size[k]
            if b > a:
                lo[a:b] = lo[k] + np.cumsum(size[a:b]) - size[a:b]
            else:
                self.order[lo[k] : hi[k]] = spans[k]
        self.lead, self.far = np.array(lead, np.int64), np.array(far, np.float64)
        self.lo, self.hi = lo, hi
        self.first, self.last = np.array([k[0] for k in kids], np.int64), np.array([k[1] for k in kids], np.int64)


class Block:
    """Vectors of a block with their cover tree and sums, as it travels between rounds."""

    FIELDS = (("order", np.int64), ("lead", np.int64), ("far", np.float64), ("lo", np.int64), ("hi", np.int64), ("first", np.int64), ("last", np.int64))

    def __init__(self, x: np.ndarray, tree):
        self.x, self.tree = x, tree

    @staticmethod
    def pack(rows: list[list[int]]) -> dict[str, bytes]:
        big = any(abs(v) >= 1 << 31 for row in rows for v in row)
        x = np.array(rows, object if big else np.int64)
        tree = CoverTree(exact(x))
        x = x[tree.order]
        out = {name: getattr(tree, name).astype(kind).tobytes() for name, kind in Block.FIELDS}
        out["x"] = repr(x.tolist()).encode() if big else x.astype(np.int32).tobytes()
        return out

    @staticmethod
    def unpack(row: dict, dim: int) -> "Block":
        tree = CoverTree.__new__(CoverTree)
        for name, kind in Block.FIELDS:
            setattr(tree, name, np.frombuffer(row[name], kind))
        n = len(tree.order)
        if row["x"][:1] == b"[" and len(row["x"]) != 4 * n * dim:
            x = np.array([[int(v) for v in r.split(b",")] for r in row["x"][2:-2].split(b"], [")], object)
        else:
            x = np.frombuffer(row["x"], np.int32).astype(np.int64).reshape(n, dim)
        place = np.empty(n, np.int64)
        place[tree.order] = np.arange(n)
        tree.lead = place[tree.lead]
        return Block(exact(x), tree)


def _grow(tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes, leaves staying themselves, and which of nodes each came from."""
    inner = tree.last[nodes] > tree.first[nodes]
    count = np.where(inner, tree.last[nodes] - tree.first[nodes], 1)
    parent = np.repeat(np.arange(len(nodes)), count)
    step = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
    return np.where(inner[parent], tree.first[nodes[parent]] + step, nodes[parent]), parent


def assign(block: Block, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of every vector of a block, the smaller number on ties."""
    x, tree = block.x, block.tree
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    c = exact(centroids)
    top = CoverTree(c, leaf=1)
    nodes, cols = np.array([0]), np.array([0])
    may = np.ones((1, 1), bool)
    while nodes.size:
        d = root_of(squares(x[tree.lead[nodes]], c[top.lead[cols]]))
        slack = MARGIN * (1 + d)
        far, wide = tree.far[nodes][:, None], top.far[cols][None, :]
        # the lead of a centroid node is a centroid, so it bounds the nearest one for every vector of the vector node
        most = np.where(may, d + far + slack, np.inf).min(axis=1)
        may &= d - far - wide - slack <= most[:, None]
        single = (may.sum(axis=1) == 1) & (top.hi[cols] - top.lo[cols] == 1)[may.argmax(axis=1)]
        leaf = tree.last[nodes] == tree.first[nodes]
        deep = (top.last[cols] == top.first[cols]).all()
        for k in np.flatnonzero(single).tolist():
            out[tree.lo[nodes[k]] : tree.hi[nodes[k]]] = top.order[top.lo[cols[may[k].argmax()]]]
        ready = leaf & ~single
        for k in np.flatnonzero(ready).tolist():
            left = np.sort(np.concatenate([top.order[top.lo[j] : top.hi[j]] for j in cols[may[k]].tolist()]))
            rows = slice(tree.lo[nodes[k]], tree.hi[nodes[k]])
            out[rows] = left[squares(x[rows], c[left]).argmin(axis=1)]
        keep = ~single & ~ready
        nodes, may = nodes[keep], may[keep]
        # centroid nodes are opened first; they are few, and narrow ones let whole vector nodes go
        cols_next, from_col = _grow(top, cols) if not deep else (cols, np.arange(len(cols)))
        may = may[:, from_col]
        cols = cols_next
        if deep or len(nodes) * 4 < len(cols):
            nodes, from_node = _grow(tree, nodes)
            may = may[from_node]
    return out


def _limbs(v: int) -> list[tuple[int, int]]:
    """A whole number as (place, part) with v = sum of part << LIMB * place; parts may be negative."""
    out, k, sign = [], 0, -1 if v < 0 else 1
    v = abs(v)
    while v:
        if v & (1 << LIMB) - 1:
            out.append((k, sign * (v & (1 << LIMB) - 1)))
        v >>= LIMB
        k += 1
    return out


def _blocks(kept: DataFrame, block: int, dim: int) -> DataFrame:
    """(b, ids, none, and a packed tree) of the vectors kept(vec_id, v, s), dealt by hash into blocks."""
    fields = [f for f, _ in Block.FIELDS]

    def run(batches):
        for t in whole_groups(batches, ["b"]):
            t = t.combine_chunks()
            b = t.column("b").to_numpy()
            edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
            for lo, hi in zip(edge, edge[1:]):
                for at in range(lo, hi, 2 * block):  # a hash may deal a block more than its share
                    g = t.slice(at, min(hi, at + 2 * block) - at)
                    made = Block.pack([[int(x) for x in row] for row in g.column("v").to_pylist()])
                    order = np.frombuffer(made["order"], np.int64)
                    row = {"ids": g.column("vec_id").take(pa.array(order)).to_pylist(), **made}
                    yield pa.RecordBatch.from_arrays([pa.array([row["ids"]], pa.list_(pa.int64())), *(pa.array([row[c]], pa.binary()) for c in ["x", *fields])], ["ids", "x", *fields])

    n = kept.count()
    parts = max(1, -(-n // block))
    dealt = kept.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")).select("b", "vec_id", "v")
    width = max(1, min(parts, max(shuffle_width(kept.sparkSession), parts // 64)))
    return dealt.repartition(width, "b").sortWithinPartitions("b").mapInArrow(run, "ids array<long>, x binary, " + ", ".join(f"{f} binary" for f in fields))


def _integers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v array<string>): the vectors kept, their components scaled to whole numbers written out in full."""

    def run(batches):
        for b in batches:
            ids, rows = [], []
            for name, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                if v is not None and len(v) == dim and None not in v and (np.abs(v) < FINITE).all():
                    ids.append(name)
                    rows.append([str(x) for x in scaled(v, scale)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["vec_id", "v"])

    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return src.mapInArrow(run, "vec_id long, v array<string>")


def lloyd(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept row of vectors(vec_id, embedding).

    Kept are vectors of ``dim`` components, none null or non-finite (or of 1e150 and more); the others give no row. Components become
    floor(scale * x). The first centroids are the vectors with the smallest sha256 of salt:vec_id; vectors that share
    an id go by their components, and vectors without an id come after all others. Fewer vectors than centroids
    make fewer centroids, an empty table no rows. Repeated rows count each. A round reads every block once and sends one row a
    centroid, component and task; the driver holds the centroids alone, centroids x dim numbers. Whole numbers are exact at any size; a
    distance or inertia that a long cannot hold comes as null. Other columns are not read.
    """
    kept, _ = table(_integers(vectors, dim, scale), "vectors-scaled")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("vec_id", "v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(centroids).collect()  # centroids rows
    if not first:
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = [[int(x) for x in r.v] for r in sorted(first, key=lambda r: (r.h is None, r.h or "", list(r.v)))]
    trees, _ = table(_blocks(kept, block, dim), "vector-trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(at, dim), "cluster int, n long, pos int, limb int, part long")
        got = sums.groupBy("cluster", "pos", "limb").agg(F.sum("part").alias("part"), F.sum("n").alias("n")).collect()  # centroids x dim numbers
        count, total = [0] * len(at), [[0] * dim for _ in at]
        for r in got:
            if r.pos < 0:
                count[r.cluster] = r.n
            else:
                total[r.cluster][r.pos] += r.part << LIMB * r.limb
        at = [[x // n for x in s] if n else old for old, s, n in zip(at, total, count)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    out, _ = table(trees.select("ids", "x", *(f for f, _ in Block.FIELDS)).mapInArrow(_final(at, dim, names), "vec_id long, cluster int, distance decimal(38,0), centroid_sha256 string"), "vector-clusters")
    per = out.groupBy("cluster").agg(F.sum("distance").alias("i"), F.count_if(F.col("distance").isNull()).alias("u"))  # a row a centroid
    total = "CASE WHEN sum(u) OVER () = 0 THEN try_cast(sum(i) OVER () AS long) END"
    per = per.select("cluster", F.expr("CASE WHEN u = 0 THEN try_cast(i AS long) END").alias("cluster_inertia"), F.expr(total).alias("inertia"))
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _each(batches, dim):
    for b in batches:
        for k in range(b.num_rows):
            yield Block.unpack({c: b.column(c)[k].as_py() for c in b.schema.names if c != "ids"}, dim), b.column("ids")[k].values if "ids" in b.schema.names else None


def _array(at: list[list[int]]) -> np.ndarray:
    return np.array(at, object if any(abs(v) >= 1 << 62 for c in at for v in c) else np.int64)


def _sums(at: list[list[int]], dim: int):
    """A task's sums of the vectors nearest to each centroid, in parts that add up without overflow."""

    def run(batches):
        c = _array(at)
        count, total = [0] * len(at), [[0] * dim for _ in at]
        for block, _ in _each(batches, dim):
            near = assign(block, c)
            order = np.argsort(near, kind="stable")
            edge = np.flatnonzero(np.r_[True, near[order][1:] != near[order][:-1], True])
            for a, b in zip(edge, edge[1:]):
                k = int(near[order[a]])
                count[k] += int(b - a)
                total[k] = [s + int(v) for s, v in zip(total[k], block.x[order[a:b]].sum(axis=0).tolist())]
        rows = [(k, n, -1, 0, 0) for k, n in enumerate(count) if n] + [(k, 0, pos, limb, part) for k, s in enumerate(total) for pos, v in enumerate(s) for limb, part in _limbs(v)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()])], ["cluster", "n", "pos", "limb", "part"])

    return run


def _final(at: list[list[int]], dim: int, names: list[str]):
    """Every vector's centroid, with the squared distance to it."""

    def run(batches):
        from decimal import Decimal

        c = _array(at)
        for block, ids in _each(batches, dim):
            near = assign(block, c)
            d = np.empty(len(near), object)
            for k in np.unique(near).tolist():
                mine = near == k
                d[mine] = [int(v) for v in squares(block.x[mine], exact(c[k : k + 1]))[:, 0]]
            d = [Decimal(v) if v < 10**37 else None for v in d.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(d, pa.decimal128(38, 0)), pa.array([names[k] for k in near.tolist()])], ["vec_id", "cluster", "distance", "centroid_sha256"])

    return run


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters after 5 rounds."""
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
 WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS c, e FROM v QUALIFY row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) <= {CENTROIDS})",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} AS MATERIALIZED {_nearest(r)}")
        parts.append(f"""k{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.e, k.e) AS e FROM k{r} k LEFT JOIN (SELECT c, list(m ORDER BY p) AS e FROM (SELECT c, p, (s - ((s % n) + n) % n) // n AS m FROM
 (SELECT c, p, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{r}) GROUP BY c, p)) GROUP BY c) n USING (c))""")
    parts.append(f"a{ROUNDS} AS MATERIALIZED {_nearest(ROUNDS)}")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(k.e, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN k{ROUNDS} k USING (c)"""


def _nearest(r: int) -> str:
    return f"""(SELECT v.vec_id, v.e, arg_min(k.c, list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 1000 + k.c) AS c,
 min(list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v, k{r} k GROUP BY v.vec_id, v.e)"""


OP13_SQL = _sql()
