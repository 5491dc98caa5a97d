"""Substring dedup by content-defined chunks.

A gear rolling hash is taken at every byte; a cut falls where the hash is smaller than all within RADIUS positions
before it and not greater than any within RADIUS after it, so chunks between cuts are longer than RADIUS bytes.
Cuts depend on nearby bytes only, so an insertion moves no cut beyond its surroundings and a passage is cut alike
wherever it stands; MAX_CHUNK bounds the chunks of monotonous text. Chunks are deduplicated by 128-bit digest: the
smallest doc_id that has a chunk keeps its first copy. Redundant chunks go where they stand in a row of at least MIN_RUN bytes, which
passes over chance repeats and single short lines, or where they are the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import row_key, rows_of, salted_join, slices, table
from codelode.llm.suffix_dedup import _sliding_min, cut_spans

RADIUS = 40
MIN_RUN = 100
MAX_CHUNK = 1024
WINDOW = 32  # bytes that a 32-bit gear hash remembers
BLOCK = 4 << 20


def gear_table(seed: int = 0x9E3779B9) -> np.ndarray:
    """A 32-bit number for each byte, from a multiplicative generator."""
    x, out = seed, []
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x >> 32)
    return np.array(out, np.uint32)


GEAR = gear_table()


def gear_hashes(a: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: h = 2 h + gear[byte], modulo 2**32, by doubling."""
    h, span = GEAR[a], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def cuts(text: bytes) -> np.ndarray:
    """Ends of the chunks of text, in order; the last is its length. Blocks overlap, so they do not show."""
    n, found = len(text), []
    for at in range(0, n, BLOCK):
        lo, hi = max(0, at - WINDOW - RADIUS), min(n, at + BLOCK + RADIUS)
        h = gear_hashes(np.frombuffer(text, np.uint8)[lo:hi])
        if h.size <= 2 * RADIUS:
            continue
        low = _sliding_min(h, RADIUS)
        m = h.size - 2 * RADIUS
        here = h[RADIUS : RADIUS + m]
        p = np.flatnonzero((here < low[:m]) & (here <= low[RADIUS + 1 : RADIUS + 1 + m])) + RADIUS + lo
        found.append(p[(p >= at) & (p < at + BLOCK)] + 1)
    ends = np.concatenate([*found, [n]]) if found else np.array([n])
    ends = np.unique(ends)
    if np.diff(ends, prepend=0).max(initial=0) > MAX_CHUNK:
        more, start = [], 0
        for e in ends.tolist():
            more += range(start + MAX_CHUNK, e, MAX_CHUNK)
            start = e
        ends = np.unique(np.concatenate([ends, more]).astype(np.int64))
    return ends


def chunks(text: bytes) -> tuple[list[int], list[bytes]]:
    """(chunk ends, 128-bit digests); an empty text has no chunk."""
    if not text:
        return [], []
    ends, digest, at, out = cuts(text).tolist(), xxhash.xxh3_128_digest, 0, []
    for e in ends:
        out.append(digest(text[at:e]))
        at = e
    return ends, out


def chunk_digests(docs: DataFrame) -> DataFrame:
    """(doc, d1, d2): the distinct chunks of each row of docs(doc, t)."""

    def run(batches):
        for b in slices(batches):
            names, found = [], []
            for name, text in zip(b.column("doc").to_pylist(), rows_of(b, "t"), strict=True):
                own = set(chunks(text)[1])
                names.append(np.full(len(own), name, np.int64))
                found += own
            d = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            names = np.concatenate(names) if names else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(np.ascontiguousarray(d[:, k])) for k in (0, 1))], ["doc", "d1", "d2"])

    return docs.select("doc", "t").mapInArrow(run, "doc long, d1 long, d2 long")


def digest_lists(column: pa.ListArray) -> list[bytes]:
    """Each list of (d1, d2) structs as its 16-byte digests end to end; null as empty."""
    d1, d2 = column.flatten().flatten()
    data = np.column_stack([d1.to_numpy(), d2.to_numpy()]).astype("<i8").tobytes()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()) * 16
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def chunk_dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_redundant, n_removed, n_spans, kept binary) for every row of docs(doc_id, text).

    A chunk is repeated if a smaller doc_id has it or it stood earlier in the same text; n_redundant counts those
    that are removed. Null and empty texts have no chunk. Rows with a null doc_id come after all ids, equal texts
    among them as one document; rows that repeat a doc_id are one document. Only the two columns are read; an empty
    table gives no rows. A chunk that many texts share is salted where texts meet counts (``salted_join``).
    """
    name, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    src = docs.select(name.alias("doc_id"), row_key(name, text).alias("doc"), text.alias("t"))
    seen, _ = table(chunk_digests(src), "chunks")
    shared = seen.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    lost = salted_join(seen, table(shared, "shared-chunks")[0], ["d1", "d2"], "n", "doc").where("doc > first")
    lost = lost.groupBy("doc").agg(F.collect_set(F.struct("d1", "d2")).alias("lost"))

    def run(batches):
        for b in slices(batches):
            rows = []
            for name, text, gone in zip(b.column("doc_id").to_pylist(), rows_of(b, "t"), digest_lists(b.column("lost")), strict=True):
                drop = {gone[k : k + 16] for k in range(0, len(gone), 16)}
                at, spans, redundant, run_from, run = 0, [], 0, None, 0
                ends, digests = chunks(text)
                for e, d in zip([*ends, None], [*digests, None]):
                    if d in drop:
                        run += 1
                        run_from = at if run_from is None else run_from
                    else:
                        if run_from is not None and (at - run_from >= min_run or at - run_from == len(text)):
                            spans += (run_from, at)
                            redundant += run
                        run_from, run = None, 0
                        drop.add(d)
                    at = e
                left, n, k = cut_spans(text, spans, 0)
                rows.append((name, len(text), len(ends), redundant, n, k, left))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            cols = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_chunks", "n_redundant", "n_removed", "n_spans", "kept"])

    return src.join(lost, "doc", "left").select("doc_id", "t", "lost").mapInArrow(run, "doc_id long, n_bytes long, n_chunks long, n_redundant long, n_removed long, n_spans long, kept binary")


def op4_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """Content-defined dedup over all documents."""
    out = chunk_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_chunks", "n_redundant", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
