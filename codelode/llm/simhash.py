"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into threshold + 1 ring segments. If two differ in at most t bits, there is a start segment
from which every chain of l consecutive segments differs in at most l * t / m bits in sum: none in the first
segment, one in the first two, two in the first three. The first two segments of the chain are the index key, of
25 to 26 bits: a fingerprint stands at its own key (its home) and probes the keys with one set bit of the second
segment cleared, so of two fingerprints that differ in this bit the one that has it meets the other. Pairs of a
home and a home or a probe are pruned along the rest of the chain before the full Hamming check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import forest, rows_of, shuffle_width, slices, table, whole_groups
from codelode.llm.graph import connected_components

SHINGLE = 4
THRESHOLD = 4
SEED = 42
BLOCK = 1024
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of UTF-8 bytes: bit i is 1 if set in over half the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(last)
    spans = zip(starts.tolist(), last)
    for at in range(0, n, _CHUNK):
        size = min(_CHUNK, n - at)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in (next(spans) for _ in range(size))), np.uint64, size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for every row; fp holds the unsigned fingerprint in a signed long."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in rows_of(b, "t")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def ring(threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(offset, width) of each segment of the ring."""
    m = threshold + 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_passes(x: np.ndarray, start: int, segments: list[tuple[int, int]], threshold: int) -> np.ndarray:
    """Which differences x keep every chain from start within its proportional budget; the last chain is the whole ring."""
    m = len(segments)
    live, total = np.arange(x.size), np.zeros(x.size, np.int64)
    for length in range(1, m + 1):
        off, width = segments[(start + length - 1) % m]
        part = np.bitwise_count(x[live] >> np.uint64(off) & np.uint64((1 << width) - 1))
        total = total + part
        ok = total <= length * threshold // m
        live, total = live[ok], total[ok]
    return live


def keys_of(fp: np.ndarray, start: int, segments: list[tuple[int, int]]):
    """The home key of each fingerprint for a start segment, and (index, key) of its probes."""
    (o1, w1), (o2, w2) = segments[start], segments[(start + 1) % len(segments)]
    one = fp >> np.uint64(o1) & np.uint64((1 << w1) - 1)
    two = fp >> np.uint64(o2) & np.uint64((1 << w2) - 1)
    home = one << np.uint64(w2) | two
    rows, bits = np.nonzero(two[:, None] >> np.arange(w2, dtype=np.uint64) & np.uint64(1))
    return home, rows, home[rows] ^ np.uint64(1) << bits.astype(np.uint64)


def _entries(groups: DataFrame, segments, probes: bool) -> DataFrame:
    """(seg, val, kind, rep, fp): every fingerprint at its home keys (kind 0) and, if asked, at the keys it probes (kind 1)."""

    def run(batches):
        for b in slices(batches, 4000):
            rep, fp = b.column("rep").to_numpy(), b.column("fp").to_numpy()
            for seg in range(len(segments)):
                home, rows, near = keys_of(fp.view(np.uint64), seg, segments)
                at, val, kind = np.arange(fp.size), home, np.zeros(fp.size, np.int8)
                if probes:
                    at, val, kind = np.r_[at, rows], np.r_[home, near], np.r_[kind, np.ones(rows.size, np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, seg, np.int8)), pa.array(val.view(np.int64)), pa.array(kind), pa.array(rep[at]), pa.array(fp[at])], ["seg", "val", "kind", "rep", "fp"])

    return groups.select("rep", "fp").mapInArrow(run, "seg byte, val long, kind byte, rep long, fp long")


def _hot_keys(homes: DataFrame, segments) -> DataFrame:
    """(seg, val, blocks) of the keys with over about BLOCK entries.

    A key is hot by its own homes or by those of the keys that probe it; keys of a few homes add BLOCK at most.
    """
    most = max(w for _, w in segments)
    sizes = homes.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // most)

    def near(batches):
        for b in batches:
            seg, val, n = (b.column(c).to_numpy() for c in ("seg", "val", "n"))
            width = np.array([segments[(s + 1) % len(segments)][1] for s in range(len(segments))], np.uint64)[seg]
            rows, bits = np.nonzero((val.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)) * (np.arange(64) < width[:, None]))
            at = np.r_[np.arange(val.size), rows]
            to = np.r_[val.view(np.uint64), val.view(np.uint64)[rows] ^ np.uint64(1) << bits.astype(np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(seg[at]), pa.array(to.view(np.int64)), pa.array(n[at])], ["seg", "val", "n"])

    total = sizes.mapInArrow(near, "seg byte, val long, n long").groupBy("seg", "val").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") > BLOCK).select("seg", "val", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def _links(fp: np.ndarray, kind: np.ndarray, side: np.ndarray, group: np.ndarray, start: int, segments, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of groups whose rows are sorted by kind.

    A group of one block pairs each home with all homes and probes after it; a group of two blocks (side 0 and 1)
    pairs homes of one with homes and probes of the other.
    """
    lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n = fp.size
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    two = np.maximum.reduceat(side, first) > 0

    def keep(i, j):
        live = chain_passes(fp[i] ^ fp[j], start, segments, threshold)
        lefts.append(i[live])
        rights.append(j[live])

    def grid(i, j):
        for at in range(0, i.size, 256):
            x, y = np.meshgrid(i[at : at + 256], j, indexing="ij")
            keep(x.ravel(), y.ravel())

    small = np.repeat((size <= 64) & ~two, size) & (kind == 0)
    rest = np.repeat(first + size, size) - np.arange(n) - 1
    live = np.flatnonzero(small & (rest > 0))
    lag = 1
    while live.size:
        keep(live, live + lag)
        lag += 1
        live = live[rest[live] >= lag]
    for k in np.flatnonzero((size > 64) | two).tolist():
        at = np.arange(first[k], first[k] + size[k])
        home = at[kind[at] == 0]
        if two[k]:
            grid(home[side[home] == 0], at[side[at] == 1])
            grid(home[side[home] == 1], at[(side[at] == 0) & (kind[at] == 1)])
        else:
            for lo in range(0, home.size, 256):
                part = home[lo : lo + 256]
                x, y = np.meshgrid(part, at[lo:], indexing="ij")
                keep(x[y > x], y[y > x])
    return np.concatenate(lefts), np.concatenate(rights)


def link_forest(groups: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(src, dst) links that join the same components as all links of groups(rep, fp).

    groups must be a stored table with one row per fingerprint. A hot key is dealt into pairs of blocks of about
    BLOCK entries, so it becomes many tasks; the hot keys are a stored table, which Spark broadcasts only if its
    size allows it. Each pair of blocks emits a forest, at most one link a row. The plan is the same at every size.
    """
    spark = groups.sparkSession
    segments = ring(threshold)
    if threshold == 0:
        return groups.select(F.col("rep").alias("src"), F.col("rep").alias("dst")).limit(0)
    big, _ = table(_hot_keys(_entries(groups, segments, False), segments), "hot-keys")
    rows = _entries(groups, segments, True).join(big, ["seg", "val"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.select("rep", "fp", "seg", "val", "kind", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("rep", "fp", "seg", "val", "kind", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("byte").alias("side"))
    keys = ["seg", "val", "a", "b"]

    def run(batches):
        for t in whole_groups(batches, keys):
            c = {k: t.column(k).to_numpy() for k in (*keys, "rep", "fp", "kind", "side")}
            changed = np.r_[True, np.any([c[k][1:] != c[k][:-1] for k in keys], axis=0)]
            group = np.cumsum(changed)
            for seg in np.unique(c["seg"]):
                at = np.flatnonzero(c["seg"] == seg)
                i, j = _links(c["fp"].view(np.uint64)[at], c["kind"][at], c["side"][at], group[at], int(seg), segments, threshold)
                i, j = at[i], at[j]
                if not i.size:
                    continue
                names, back = np.unique(c["rep"][np.r_[i, j]], return_inverse=True)
                root = forest(names.size, back[: i.size], back[i.size :])
                hung = np.flatnonzero(root != np.arange(names.size))
                yield pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[root[hung]])], ["src", "dst"])

    width = max(shuffle_width(spark), groups.count() // 20_000)
    return rows.repartition(width, *keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Null and wordless texts have fingerprint zero and link like any other. Equal fingerprints are collapsed to
    one row before links are sought, so copies cost no pairs. Rows without an id link like any other and get the
    smallest id they reach (null if there is none); repeated ids are one document, so their fingerprints share a
    component. Only doc_id and text are read; an empty table gives an empty result.
    """
    prints, _ = table(fingerprints(docs), "fingerprints")
    # a fingerprint is its own node; which ids it stands for is told when components are known
    groups, _ = table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    links = link_forest(groups.select("fp", F.col("fp").alias("rep")), threshold)
    twice = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst < top")
    links = links.unionByName(prints.join(twice, "doc_id").select(F.col("fp").alias("src"), "dst").where("src <> dst"))
    comp = connected_components(links, "simhash").withColumnRenamed("node", "fp")
    joined = groups.join(comp, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("node"))
    least = joined.groupBy("node").agg(F.min("least").alias("component_id"))
    named = joined.select("fp", "node").join(least, "node").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
