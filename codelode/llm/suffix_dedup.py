"""Removal of repeated byte strings, decided by suffix arrays over the few places where repeats can be.

Every length-byte window of a text selects the smallest of its k-gram hashes. Equal windows select equal
hashes, so only windows whose hash is selected twice can repeat. Runs of windows that select one hash are
regions; equal regions collapse to one with a count. The distinct regions of a hash are joined and their suffix
array (see gsaca) puts equal windows next to each other, where they are compared byte by byte. No text is
compared outside a hash, and no hash needs more than its distinct regions in one task; a hash with many of them
is split first: the windows of its regions select anew by another hash, level by level (see ``_split``).

Texts are stored once, bucketed by doc_id, so that reading regions and cutting spans moves no text again.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.llm.common import remove, row_key, rows_of, shuffle_width, slices, table, whole_groups
from codelode.llm.gsaca import suffix_array, suffix_arrays

LENGTH = 200
GRAM = 32
BLOCK = 1 << 20  # windows of a text hashed at once
RUN = 512  # windows in a region at most
REGIONS = 1000  # distinct regions of a hash that one suffix array takes: 0.7 MB at most
LEVELS = 4  # times a group of regions is split by a further hash before its windows are counted by digest
MARK_BYTES = 1 << 20  # regions whose windows are hashed at once, single hashes excepted
BATCH_BYTES = 1 << 19
ROUND, STEP, PLAIN = 85.0, 0.3, 3.0  # microseconds a round, a byte in lockstep and a byte in plain Python


def gram_hashes(a: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each gram-byte string (gram a power of two) of the bytes a; seeds order them anew."""
    h, factor, span = a.astype(np.uint64) + np.uint64(1), 0x100000001B3, 1
    while span < gram:
        h = h[: h.size - span] * np.uint64(factor) + h[span:]
        factor, span = factor * factor % 2**64, 2 * span
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    if seed:
        h ^= np.uint64(seed * 0xD6E8FEB86659FD93 % 2**64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    v, span = h, 1
    while span * 2 <= width:
        v = np.minimum(v[: v.size - span], v[span:])
        span *= 2
    n = h.size - width + 1
    return np.minimum(v[:n], v[width - span : width - span + n])


def regions(text: bytes, length: int = LENGTH, gram: int = GRAM, seed: int = 0):
    """Runs of windows that select one hash: (first window, end, hash, weight) arrays.

    Weight 2 marks runs in which the hash stands at two places or more, whose windows may equal each other.
    """
    found = []
    width = length - gram + 1
    for at in range(0, len(text) - length + 1, BLOCK):
        a = np.frombuffer(text, np.uint8)[at : at + BLOCK + length - 1]
        h = gram_hashes(a, gram, seed)
        low = _sliding_min(h, width)
        cut = np.r_[True, low[1:] != low[:-1]]
        b = np.flatnonzero(cut)
        long = np.flatnonzero(np.diff(np.r_[b, low.size]) > RUN)
        for x, y in zip(b[long], np.r_[b[1:], low.size][long]):
            cut[x:y:RUN] = True
        b = np.flatnonzero(cut)
        e = np.r_[b[1:], low.size]
        v = low[b]
        weight = np.ones(b.size, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(h, width)
        for s in range(0, b.size, 4096):
            t = slice(s, s + 4096)
            head, tail = view[b[t]] == v[t, None], view[e[t] - 1] == v[t, None]
            twice = (head.sum(axis=1) > 1) | (tail.sum(axis=1) > 1) | (b[t] + head.argmax(axis=1) != e[t] - 1 + tail.argmax(axis=1))
            weight[t] += twice
        found.append((b + at, e + at, v.view(np.int64), weight))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_windows(parts: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each distinct region (bytes, count) of one hash: which of its windows occur elsewhere as well."""
    return _mark([parts], length)[0]


def window_hashes(a: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each length-byte window, from two overlapping power-of-two hashes."""
    half = 1 << (length.bit_length() - 1)
    h = gram_hashes(a, half)
    n = a.size - length + 1
    return h[:n] * np.uint64(0xD6E8FEB86659FD93) + h[length - half : length - half + n]


def _mark(groups: list[list[tuple[bytes, int]]], length: int) -> list[list[np.ndarray]]:
    """repeated_windows of many hashes at once.

    Windows whose own hash stands once equal no other. Each region is cut to its other windows and equal cuts
    collapse, so near copies that differ in places come down to a few parts; suffix arrays decide those.
    """
    flat = [(k, text, count) for k, g in enumerate(groups) for text, count in g]
    ends = np.cumsum([len(text) for _, text, _ in flat])
    h = window_hashes(np.frombuffer(b"".join(text for _, text, _ in flat), np.uint8), length)
    own = np.zeros(h.size, bool)
    for b, (_, text, _) in zip((ends - [len(t) for _, t, _ in flat]).tolist(), flat):
        own[b : b + len(text) - length + 1] = True
    at = np.flatnonzero(own)
    _, back, times = np.unique(h[at], return_inverse=True, return_counts=True)
    shared = np.zeros(h.size, bool)
    shared[at] = times[back] > 1
    parts: list[dict[bytes, list]] = [{} for _ in groups]
    out: list[list[np.ndarray]] = [[] for _ in groups]
    for b, (k, text, count) in zip((ends - [len(t) for _, t, _ in flat]).tolist(), flat):
        flags = shared[b : b + len(text) - length + 1]
        runs = runs_of(flags)
        for x, y in zip(runs[::2], runs[1::2]):
            part = parts[k].setdefault(text[x : y - 1 + length], [0, []])
            part[0] += count
            part[1].append((len(out[k]), x, y))
        out[k].append(np.full(flags.size, count > 1))
    ask = [k for k, p in enumerate(parts) if any(c == 1 for c, _ in p.values())]
    told = dict(zip(ask, _mark_parts([[(t, c) for t, (c, _) in parts[k].items()] for k in ask], length)))
    for k, p in enumerate(parts):
        for n, (count, places) in enumerate(p.values()):
            for r, x, y in places:
                out[k][r][x:y] |= True if count > 1 else told[k][n]
    return out


def _mark_parts(groups: list[list[tuple[bytes, int]]], length: int) -> list[list[np.ndarray]]:
    """Repeated windows of each part of each group, by suffix arrays."""
    joined = [b"\xff".join(r for r, _ in g) for g in groups]
    out: list[list[np.ndarray]] = [[] for _ in groups]
    order = sorted(range(len(groups)), key=lambda k: len(joined[k]))
    size = np.array([len(joined[k]) for k in order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), BATCH_BYTES, side="right")) + at)
        # lockstep costs rounds by its longest string, plain Python costs by bytes: take the cheapest cut
        read = np.cumsum(size[at:end])
        cost = np.r_[PLAIN * read[-1], ROUND * size[at:end] + STEP * read + PLAIN * (read[-1] - read)]
        cut = at + int(cost.argmin())
        if cut > at:
            batch = order[at:cut]
            starts, base = suffix_arrays([joined[k] for k in batch])
            for k, b in zip(batch, base.tolist()):
                out[k] = _equal_neighbours(joined[k], starts[b + 1 : b + 1 + len(joined[k])] - b, groups[k], length)
        for k in order[cut:end]:
            out[k] = _equal_neighbours(joined[k], np.array(suffix_array(joined[k]), np.int64), groups[k], length)
        at = end
    return out


def _equal_neighbours(text: bytes, sa: np.ndarray, parts: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """Windows that equal a neighbour in suffix order, or whose region occurs twice, by region."""
    size = np.array([len(r) for r, _ in parts])
    first = np.cumsum(size + 1) - size - 1
    whole = np.zeros(len(text), bool)
    for b, n in zip(first.tolist(), size.tolist()):
        whole[b : b + n - length + 1] = True
    sa = sa[whole[sa]]
    a = np.frombuffer(text, np.uint8)
    hit = np.zeros(len(text), bool)
    # a cheap hash of each window's ends rules out most neighbours before bytes are compared
    ends = a[sa + length - 1] == np.roll(a[sa + length - 1], 1)
    near = np.flatnonzero(ends[1:] & (a[sa[1:]] == a[sa[:-1]])) + 1
    view = np.lib.stride_tricks.sliding_window_view(a, length)
    for s in range(0, near.size, 8192):
        k = near[s : s + 8192]
        k = k[(view[sa[k]] == view[sa[k - 1]]).all(axis=1)]
        hit[sa[k]] = hit[sa[k - 1]] = True
    out = []
    for b, n, (_, count) in zip(first.tolist(), size.tolist(), parts):
        out.append(np.ones(n - length + 1, bool) if count > 1 else hit[b : b + n - length + 1])
    return out


def runs_of(flags: np.ndarray) -> list[int]:
    """Flattened [start, end) runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge.tolist()


def cut_spans(text: bytes, spans: list[int] | None, length: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed) for flattened [start, end) byte spans."""
    if not spans:
        return text, 0, 0
    s = np.asarray(spans, np.int64).reshape(-1, 2)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1]]
    lo = s[new, 0]
    hi = reach[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]
    parts, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts), int((hi - lo).sum()), len(lo)


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc_id, sig, b, e, w): the regions of every row; sig tells rows of one doc_id apart by their text."""

    def run(batches):
        for batch in slices(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for name, text in zip(batch.column("doc_id").to_pylist(), rows_of(batch, "t"), strict=True):
                b, e, h, w = regions(text, length, gram)
                if b.size:
                    sig = xxhash.xxh32_intdigest(text) - (1 << 31)
                    for col, x in zip(cols, (h, np.full(b.size, name, np.int64), np.full(b.size, sig), b, e, w)):
                        col.append(x)
            if cols[0]:
                names = ["h", "doc_id", "sig", "b", "e", "w"]
                kinds = [np.int64, np.int64, np.int32, np.int64, np.int64, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds)], names)

    return docs.select("doc_id", "t").mapInArrow(run, "h long, doc_id long, sig int, b long, e long, w int")


def _region_rows(stored: DataFrame, length: int) -> DataFrame:
    """(h, r1, r2, doc_id, sig, b, e): digests of the regions that a stored text may share."""

    def run(batches):
        for batch in slices(batches):
            rows: list[tuple] = []
            for name, text, at in zip(batch.column("doc_id").to_pylist(), rows_of(batch, "t"), batch.column("at").to_pylist(), strict=True):
                own = xxhash.xxh32_intdigest(text) - (1 << 31)
                for x in at or ():
                    if x["sig"] != own:
                        continue
                    d = np.frombuffer(xxhash.xxh3_128_digest(text[x["b"] : x["e"] + length - 1]), "<i8").tolist()
                    rows.append((x["h"], d[0], d[1], name, x["sig"], x["b"], x["e"]))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "r1", "r2", "doc_id", "sig", "b", "e"])

    return stored.where("at IS NOT NULL").select("doc_id", "t", "at").mapInArrow(run, "h long, r1 long, r2 long, doc_id long, sig int, b long, e long")


def _spread(wanted: DataFrame, length: int) -> DataFrame:
    """(h, r1, r2, runs) for hashes that no level has split far enough: windows are counted by digest.

    Equal windows of a hash have equal digests; the counts are partial sums.
    """

    def windows(batches):
        for batch in slices(batches, 200):
            sizes = np.array([max(0, k - length + 1) for k in pc.binary_length(batch.column("bytes")).to_pylist()])
            if not sizes.sum():
                continue
            texts = batch.column("bytes").to_pylist()
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t[x : x + length]) for t, k in zip(texts, sizes.tolist()) for x in range(k)), "<i8").reshape(-1, 2)
            whose = pa.array(np.repeat(np.arange(sizes.size), sizes))
            place = np.arange(len(digests)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            made = [*(batch.column(c).take(whose) for c in ("h", "r1", "r2", "n")), *(pa.array(x) for x in (place, digests[:, 0].copy(), digests[:, 1].copy()))]
            yield pa.RecordBatch.from_arrays(made, ["h", "r1", "r2", "n", "x", "w1", "w2"])

    w = wanted.repartition("h", "r1", "r2").mapInArrow(windows, "h long, r1 long, r2 long, n long, x long, w1 long, w2 long")
    shared = w.groupBy("h", "w1", "w2").agg(F.sum("n").alias("c")).where("c > 1")
    hit = w.join(shared, ["h", "w1", "w2"]).groupBy("h", "r1", "r2").agg(F.collect_set("x").alias("xs"))
    return hit.select("h", "r1", "r2", F.flatten(F.transform("xs", lambda x: F.array(x, x + 1))).alias("runs"))


def _by_suffix_array(wanted: DataFrame, length: int, width: int) -> DataFrame:
    """(h, r1, r2, runs): the repeated windows of each distinct region, by the suffix array of its hash."""

    def run(batches):
        for t in whole_groups(batches, ["h"]):
            # rows that repeat a doc_id and its text have fetched their regions twice
            h = t.column("h").to_numpy()
            twice = np.r_[False, np.all([t.column(c).to_numpy()[1:] == t.column(c).to_numpy()[:-1] for c in ("h", "r1", "r2")], axis=0)]
            t = t.filter(pa.array(~twice))
            h = h[~twice]
            cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            # hashing takes some twenty times the bytes of its regions, so few hashes are at it at once
            ends = np.cumsum(pc.binary_length(t.column("bytes")).to_numpy())[cut[1:] - 1]
            at = 0
            while at < len(ends):
                done = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, done + MARK_BYTES, side="right")))
                some, edges = t.slice(cut[at], cut[end] - cut[at]).combine_chunks(), (cut[at : end + 1] - cut[at]).tolist()
                n, text = some.column("n").to_pylist(), some.column("bytes").to_pylist()
                groups = [list(zip(text[a:b], n[a:b])) for a, b in zip(edges, edges[1:])]
                runs = [runs_of(flags) for g in _mark(groups, length) for flags in g]
                kept = [some.column(c).combine_chunks() for c in ("h", "r1", "r2")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(runs, pa.list_(pa.int64()))], ["h", "r1", "r2", "runs"])
                at = end

    return wanted.repartition(width, "h").sortWithinPartitions("h", "r1", "r2").mapInArrow(run, "h long, r1 long, r2 long, runs array<long>")


def _split(groups: DataFrame, length: int, gram: int, most: int, width: int, level: int) -> DataFrame:
    """(h, r1, r2, runs) for hashes with more distinct regions than a suffix array takes.

    The windows of every region select the smallest of their k-gram hashes under this level's seed, so equal windows
    of a hash select equal hashes again. A region comes apart into one part or a few; equal parts collapse to one
    with a count, a hash selected once leaves no question, and the groups of parts are solved as regions are.
    """

    def cut(batches):
        for batch in slices(batches):
            rows = []
            for h, r1, r2, n, text in zip(*(batch.column(c).to_pylist() for c in ("h", "r1", "r2", "n", "bytes")), strict=True):
                for b, e, v, w in zip(*(x.tolist() for x in regions(text, length, gram, level))):
                    k = (h * 0x9E3779B97F4A7C15 + v) % 2**64 - 2**63
                    part = text[b : e + length - 1]
                    d = np.frombuffer(xxhash.xxh3_128_digest(part), "<i8").tolist()
                    rows.append((h, r1, r2, b, k, d[0], d[1], n, n * w, part))
            if rows:
                kinds = [pa.int64()] * 9 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["h", "r1", "r2", "x", "k", "p1", "p2", "n", "w", "bytes"])

    made = groups.mapInArrow(cut, "h long, r1 long, r2 long, x long, k long, p1 long, p2 long, n long, w long, bytes binary")
    made, _ = table(made, f"parts-{level}")
    parts = made.groupBy("k", "p1", "p2").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.first("bytes").alias("bytes"))
    parts, _ = table(parts, f"distinct-parts-{level}")
    per = parts.groupBy("k").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.sum("w").alias("c")).where("least = 1 AND c > 1")
    todo = parts.join(per.select("k", "kinds"), "k").select(F.col("k").alias("h"), F.col("p1").alias("r1"), F.col("p2").alias("r2"), "n", "kinds", "bytes")
    todo, _ = table(todo, f"open-parts-{level}")
    count, kinds = todo.agg(F.count("*"), F.coalesce(F.max("kinds"), F.lit(0))).first()
    solved = _solve(todo, count, kinds, length, gram, most, width, level + 1)
    solved = solved.select(F.col("h").alias("k"), F.col("r1").alias("p1"), F.col("r2").alias("p2"), "runs").where(F.size("runs") > 0)
    whole = F.array(F.lit(0).cast("long"), (F.octet_length("bytes") - length + 1).cast("long"))
    full = parts.where("n > 1").select("k", "p1", "p2", whole.alias("runs"))
    known = full.unionByName(solved.join(full.select("k", "p1", "p2"), ["k", "p1", "p2"], "left_anti"))
    hit = made.select("h", "r1", "r2", "x", "k", "p1", "p2").join(known, ["k", "p1", "p2"])
    hit = hit.withColumn("runs", F.transform("runs", lambda r: r + F.col("x")))
    return hit.groupBy("h", "r1", "r2").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _solve(wanted: DataFrame, count: int, kinds: int, length: int, gram: int, most: int, width: int, level: int) -> DataFrame:
    """(h, r1, r2, runs) for wanted(h, r1, r2, n, kinds, bytes), which has count rows and at most kinds to a hash.

    Regions that no further hash tells apart are counted by window digest: the exact way out of the last level.
    """
    solved = _by_suffix_array(wanted.where(F.col("kinds") <= most), length, max(width, count // 20_000))
    if kinds > most:
        hot = wanted.where(F.col("kinds") > most).dropDuplicates(["h", "r1", "r2"])
        more = _spread(hot, length) if level > LEVELS else _split(hot, length, gram, most, width, level)
        solved = solved.unionByName(more)
    return solved


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = REGIONS) -> DataFrame:
    """docs(doc_id, t, ...) as stored, with ``hits``: where its repeated windows are, by region.

    doc_id is no null. Rows that share it and their text share their regions, so these are collected as sets.
    """
    spark = docs.sparkSession
    occ, occ_path = table(_occurrences(docs, length, gram), "regions")
    again = occ.groupBy("h").agg(F.sum("w").alias("c")).where("c > 1").select("h")
    at = occ.join(again, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "sig", "b", "e")).alias("all"))
    # one shuffle of texts by doc_id serves this join and the bucketed copy
    width = max(shuffle_width(spark), 8)
    name = f"codelode_texts_{uuid.uuid4().hex}"
    texts = docs.repartition(width, "doc_id").join(at, "doc_id", "left").withColumnRenamed("all", "at")
    texts.write.bucketBy(width, "doc_id").mode("overwrite").saveAsTable(name)
    stored = spark.table(name)
    remove(spark, occ_path)
    rows, _ = table(_region_rows(stored, length), "region-digests")
    distinct = rows.groupBy("h", "r1", "r2").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "sig", "b", "e")).alias("rep"))
    distinct, _ = table(distinct, "distinct-regions")
    per = distinct.groupBy("h").agg(F.count("*").alias("kinds"), F.min("rows").alias("least"))
    # only hashes with a region that stands once leave a question: single regions that stand twice repeat whole
    todo = distinct.join(per.where("least = 1"), "h").select("h", "r1", "r2", F.col("rows").alias("n"), "kinds", "rep.*")
    need = todo.groupBy("doc_id").agg(F.collect_list(F.struct("h", "r1", "r2", "n", "kinds", "sig", "b", "e")).alias("want"))

    def fetch(batches):
        for batch in slices(batches):
            out = []
            for text, want in zip(rows_of(batch, "t"), batch.column("want").to_pylist(), strict=True):
                own = xxhash.xxh32_intdigest(text) - (1 << 31)
                out += [(x["h"], x["r1"], x["r2"], x["n"], x["kinds"], text[x["b"] : x["e"] + length - 1]) for x in want if x["sig"] == own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 5 + [pa.binary()])], ["h", "r1", "r2", "n", "kinds", "bytes"])

    wanted = stored.select("doc_id", "t").join(need, "doc_id").mapInArrow(fetch, "h long, r1 long, r2 long, n long, kinds long, bytes binary")
    count, kinds = todo.agg(F.count("*"), F.coalesce(F.max("kinds"), F.lit(0))).first()
    solved, _ = table(_solve(wanted, count, kinds, length, gram, most, width, 1).where(F.size("runs") > 0), "solved-regions")
    # regions that stand twice repeat whole, whether their hash was looked at or not
    full = distinct.where("rows > 1").select("h", "r1", "r2", F.lit(None).cast("array<long>").alias("runs"))
    known = full.unionByName(solved.join(full.select("h", "r1", "r2"), ["h", "r1", "r2"], "left_anti"))
    hits = rows.join(known, ["h", "r1", "r2"]).select("doc_id", "sig", "b", "e", "runs")
    hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("sig", "b", "e", "runs")).alias("hits"))
    return stored.drop("at").join(hits, "doc_id", "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = REGIONS, carry: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs(doc_id, text).

    A byte goes if a length-byte string over it also starts anywhere else in any text, its own included. Texts
    are UTF-8 bytes; null and short texts lose nothing; very long texts are hashed in blocks. Rows with a null
    doc_id take part under a number made of their text and come back with the null. Rows that repeat a doc_id are texts of their
    own; what is left may not be valid UTF-8. An empty table gives no rows. Only the two
    columns are read, unless carry asks for a struct ``carried`` of all columns but text as well.
    """
    src = docs.select(
        row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("doc_id"),
        F.col("doc_id").cast("long").alias("given"),
        F.col("text").cast("string").alias("t"),
        *([F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("carried")] if carry else []),
    )
    extra = ["carried"] if carry else []

    def run(batches):
        for batch in slices(batches):
            total, gone, spans, kept = [], [], [], []
            for text, hits in zip(rows_of(batch, "t"), batch.column("hits").to_pylist(), strict=True):
                own = xxhash.xxh32_intdigest(text) - (1 << 31) if hits else 0
                cuts: list[int] = []
                for x in hits or ():
                    if x["sig"] == own:
                        at = x["runs"] if x["runs"] is not None else (0, x["e"] - x["b"])
                        for a, b in zip(at[::2], at[1::2]):
                            cuts += (x["b"] + a, x["b"] + b - 1 + length)
                left, n, k = cut_spans(text, cuts, length)
                total.append(len(text))
                gone.append(n)
                spans.append(k)
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("given"), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(kept, pa.binary()), *(batch.column(c) for c in extra)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *extra],
            )

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]).add("kept", "binary")
    for c in extra:
        schema = schema.add(src.schema[c])
    return repeated_spans(src, length, gram, most).mapInArrow(run, schema)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Removal of 200-byte repeats over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def removed_by_brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) of each text by counting every window, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), len(runs_of(gone)) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
