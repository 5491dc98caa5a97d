"""Embedding near-dedup by int8 tile products with rigorous quantisation error bounds.

A unit vector u is stored as s * q + e with int8 q, scale s and the exact norm of e. For two of them
|u.v - s_u s_v (q_u . q_v)| <= |s_u q_u| |e_v| + |e_u|, so the integer product decides most pairs and only those
whose interval holds the threshold are computed in double precision from the vectors themselves. Integer
products run as float32 matrix products, which are exact below 2**24 (so up to 1040 components a product).

Tiles travel as int8 codes with three numbers a vector. A pair of tiles counts its sure links and names the
vectors that have an open pair in it; only these vectors travel as doubles, and their open pairs are decided then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.llm.common import forest, row_key, salted_join, shuffle_width, slices, table, whole_groups
from codelode.llm.graph import connected_components

THRESHOLD = 0.9
TILE = 32_768  # vectors to a tile at most
TILES = 8  # tiles at least, so that 36 tasks share small inputs
STRIP, SPAN = 512, 8192  # vectors of the two tiles multiplied at once
EXACT_DIMS = 1040
SLACK = 1e-9  # above any rounding of the bounds themselves, which are sums of products of numbers up to 1


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8-valued q (float32), scale, |s q| and |e| of the rows of x scaled to length 1."""
    x = level(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).clip(-127, 127)
    near = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def level(x: np.ndarray) -> np.ndarray:
    """Rows whose largest component is at least 2**500 or under 2**-500, times a power of two that brings it near 1.

    Squares of all others neither overflow nor vanish; a power of two changes no digit.
    """
    top = np.abs(x).max(axis=1, initial=0)
    far = (top >= 2.0**500) | (top < 2.0**-500) & (top > 0)
    if far.any():
        x = x.copy()
        x[far] = np.ldexp(x[far], -np.frexp(top[far])[1][:, None])
    return x


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    x, y = level(x), level(y)
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def tile_pairs(x: tuple, y: tuple, threshold: float, same: bool):
    """(i, j, sure) of the pairs of two quantised tiles that are sure to reach the threshold or may; with same, only i < j.

    Tiles are (q int8, s, |s q|, |e|). Yields block by block.
    """
    (qx, sx, nx, ex), (qy, sy, ny, ey) = x, y
    kind = np.float64 if qx.shape[1] > EXACT_DIMS else np.float32
    for at in range(0, len(qy), SPAN):
        span = slice(at, min(at + SPAN, len(qy)))
        right = qy[span].astype(np.float32)
        for lo in range(0, min(len(qx), span.stop) if same else len(qx), STRIP):
            part = slice(lo, min(lo + STRIP, len(qx)))
            left = qx[part].astype(np.float32)
            dots = np.zeros((len(left), len(right)), kind)
            for d in range(0, qx.shape[1], EXACT_DIMS):
                dots += left[:, d : d + EXACT_DIMS] @ right[:, d : d + EXACT_DIMS].T
            # one bound for the whole block picks the few pairs that the bound of each pair then judges
            room = nx[part].max() * ey[span].max() + ex[part].max()
            floor = (threshold - SLACK - room) / (sx[part, None].astype(np.float64) * sy[span].max())
            i, j = np.nonzero(dots >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf)) if floor.min() > 0 else np.ones_like(dots, bool))
            approx = dots[i, j].astype(np.float64)
            i, j = i + lo, j + at
            if same:
                up = i < j
                i, j, approx = i[up], j[up], approx[up]
            approx *= sx[i] * sy[j]
            err = nx[i] * ey[j] + ex[i] + SLACK
            may = approx + err >= threshold
            yield i[may], j[may], (approx - err >= threshold)[may]


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec, d1, d2, embedding): vectors that can link, with a 128-bit digest of their doubles. vec is the row's key."""

    def run(batches):
        for b in slices(batches):
            out = []
            for given, name, v in zip(b.column("vec_id").to_pylist(), b.column("vec").to_pylist(), b.column("v").to_pylist(), strict=True):
                if not v or None in v:
                    continue
                a = np.asarray(v, np.float64) + 0.0
                if np.isfinite(a).all() and a.any():
                    d = xxhash.xxh3_128_digest(a.tobytes())
                    out.append((given, name, *np.frombuffer(d, "<i8").tolist(), v))
            cols = list(zip(*out)) or [[], [], [], [], []]
            kinds = [*[pa.int64()] * 4, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["vec_id", "vec", "d1", "d2", "embedding"])

    return keyed(vectors, id_col, vec_col).mapInArrow(run, "vec_id long, vec long, d1 long, d2 long, embedding array<double>")


def keyed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec, v): id as given, key of the row, vector of doubles."""
    name, v = F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")
    return vectors.select(name.alias("vec_id"), row_key(name, v).alias("vec"), v.alias("v"))


def coded(classes: DataFrame) -> DataFrame:
    """classes(d1, d2, rep, copies, dim, v) with their codes: q int8 as bytes, s, nq and ne."""

    def run(batches):
        for b in slices(batches):
            cols = {c: [] for c in ("q", "s", "nq", "ne")}
            for v in b.column("v").to_pylist():
                q, s, nq, ne = quantise(np.asarray([v], np.float64))
                for c, x in zip(cols, (q.astype(np.int8).tobytes(), s[0], nq[0], ne[0])):
                    cols[c].append(x)
            kinds = (pa.binary(), *[pa.float64()] * 3)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols.values(), kinds))], [*b.schema.names, *cols])

    schema = T.StructType(list(classes.schema.fields)).add("q", "binary").add("s", "double").add("nq", "double").add("ne", "double")
    return classes.mapInArrow(run, schema)


def _tile_counts(dealt: DataFrame, threshold: float, width: int, exact: bool) -> DataFrame:
    """(d1, d2, rep, n, root, a, b, side, open) of the classes that have links or open pairs in a pair of tiles.

    n counts the links decided here and root joins them to a forest: sure ones, or with exact the open pairs of
    rows that carry their doubles.
    """
    keys = ["dim", "a", "b"]

    def run(batches):
        for t in whole_groups(batches, keys):
            t = t.combine_chunks()
            key = np.stack([t.column(k).to_numpy() for k in keys])
            edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
            for lo, hi in zip(edge, edge[1:]):
                g, size = t.slice(lo, hi - lo), hi - lo
                c = {k: g.column(k).to_numpy() for k in ("d1", "d2", "rep", "copies", "side", "s", "nq", "ne")}
                same = key[1, lo] == key[2, lo]
                left = np.arange(size) if same else np.flatnonzero(c["side"] == 0)
                right = left if same else np.flatnonzero(c["side"] == 1)
                if not (left.size and right.size):
                    continue
                q = np.frombuffer(b"".join(g.column("q").to_pylist()), np.int8).reshape(size, -1)
                v = g.column("v").combine_chunks().flatten().to_numpy().reshape(size, -1) if exact else None
                one = (q[left], c["s"][left], c["nq"][left], c["ne"][left])
                two = one if same else (q[right], c["s"][right], c["nq"][right], c["ne"][right])
                count, root, open_ = np.zeros(size, np.int64), np.arange(size), np.zeros(size, bool)
                for i, j, sure in tile_pairs(one, two, threshold, same):
                    i, j = left[i], right[j]
                    if exact:
                        i, j = i[~sure], j[~sure]
                        ok = np.zeros(i.size, bool)
                        for at in range(0, i.size, 1 << 14):
                            k = slice(at, at + (1 << 14))
                            ok[k] = cosine(v[i[k]], v[j[k]]) >= threshold
                        i, j = i[ok], j[ok]
                    else:
                        open_[i[~sure]] = open_[j[~sure]] = True
                        i, j = i[sure], j[sure]
                    np.add.at(count, i, c["copies"][j])
                    np.add.at(count, j, c["copies"][i])
                    root = forest(size, np.r_[i, np.arange(size)], np.r_[j, root])
                hit = np.flatnonzero((count > 0) | open_)
                if hit.size:
                    arrays = [pa.array(c[k][hit]) for k in ("d1", "d2", "rep")] + [pa.array(count[hit]), pa.array(c["rep"][root[hit]])]
                    arrays += [pa.array(np.full(hit.size, key[k, lo], np.int32)) for k in (1, 2)] + [pa.array(c["side"][hit]), pa.array(open_[hit])]
                    yield pa.RecordBatch.from_arrays(arrays, ["d1", "d2", "rep", "n", "root", "a", "b", "side", "open"])

    cols = [*keys, "d1", "d2", "rep", "copies", "side", "q", "s", "nq", "ne"] + ["v"] * exact
    return dealt.select(cols).repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(run, "d1 long, d2 long, rep long, n long, root long, a int, b int, side int, open boolean")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Equal vectors are collapsed to one class with a count first, so a third of all rows being copies costs no
    pairs; classes are dealt by hash into tiles and each pair of tiles is one group. A group emits link counts
    per class and a forest of its links, never its pairs. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; so do vectors of other lengths. Rows with a null id count as vectors of
    others' links and take the smallest id they reach as component (null if there is none), but are never kept; equal
    vectors without an id are one node. Rows that repeat an id are one node for components and count as separate
    vectors for n_links. Only the two columns are read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    named, _ = table(valid_vectors(vectors).withColumn("dim", F.size("embedding")), "vectors")
    classes = named.groupBy("d1", "d2").agg(F.min("vec").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("embedding").alias("v"))
    classes, _ = table(coded(classes), "vector-classes")
    n = classes.count()
    tiles = max(TILES, -(-n // tile))
    mine = F.pmod(F.col("d1"), F.lit(tiles)).cast("int")
    dealt = classes.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other")).withColumn("side", (F.col("mine") > F.col("other")).cast("int"))
    width = max(shuffle_width(spark), tiles * (tiles + 1) // 2)
    first, _ = table(_tile_counts(dealt, threshold, width, False), "vector-links")
    again = first.where("open").select("d1", "d2", "a", "b", "side").join(classes, ["d1", "d2"])
    second, _ = table(_tile_counts(again, threshold, width, True), "open-links")
    found = first.where("n > 0").unionByName(second)
    comp = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")), "vectors")
    links = found.groupBy("d1", "d2").agg(F.sum("n").alias("n"))
    verdict = classes.select("d1", "d2", "rep", "least", "copies").join(links, ["d1", "d2"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    verdict = verdict.select("d1", "d2", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("node"))
    # nodes are keys of rows; the smallest id is sought among the ids that rows were given
    least = verdict.groupBy("node").agg(F.min("least").alias("component_id"))
    verdict = verdict.drop("least").join(least, "node").drop("node")
    linked = salted_join(named.select("vec", "d1", "d2"), table(verdict, "vector-verdicts")[0], ["d1", "d2"], "copies", "vec")
    # every row comes back; rows that cannot link are those valid_vectors leaves out
    per_id = linked.groupBy("vec").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = keyed(vectors).select("vec_id", "vec").join(per_id, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at cosine 0.9 and above."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
      AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.dst FROM r JOIN l ON l.src = r.seen),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
d AS (SELECT src AS vec_id, count(*) AS n FROM l GROUP BY src)
SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN d ON d.vec_id = c.vec_id
"""
