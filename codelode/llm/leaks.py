"""Benchmark decontamination by suffix arrays of the training texts.

Texts are dealt into shards of about a million words, and every shard gets the suffix array of its words. Every
suffix of every test item is searched in it by bisection, word by word, until no place is left: that gives its
longest verbatim match and, on the way, the places of its first ``window`` words. Texts are read once and never
shuffled: shards are made, searched and given up inside the tasks that read the texts, and what a task returns are
its documents. Test items are broadcast in blocks of bounded size; each block is one pass over the shards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.llm import words
from codelode.llm.words import gathered

WINDOW = 10
TEXT = 1 << 23  # bytes of text that a task holds at once; longer texts come one at a time
SHARD = 1 << 20  # words of a suffix array; with its ends of texts these must be under 2**21
BLOCK = 1 << 23  # bytes of test items searched in one pass
BITS = 21


@dataclass
class Items:
    """Test items: words as codes into terms, first word of each item, names, and what each suffix is looked for by.

    window is the words of a suffix that make a window, 0 if the suffix is too short for one.
    """

    codes: np.ndarray
    first: np.ndarray
    names: list[str | None]
    terms: pa.Array
    window: np.ndarray
    left: np.ndarray = field(init=False)

    def __post_init__(self):
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.codes))  # words from here to the item's end


def items_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Items:
    found = words.split([(text or "").encode() for _, text in rows])
    left = np.repeat(found.first[1:], found.counts) - np.arange(len(found))
    size = np.repeat(found.counts, found.counts)
    need = np.where(left >= window, window, np.where((size < window) & (left == size), size, 0))
    return Items(found.codes, found.first, [name for name, _ in rows], found.terms, need)


def blocks(items: DataFrame, window: int = WINDOW, most: int = BLOCK) -> list[Items]:
    """Items(item_id, text) in blocks of about ``most`` bytes: as many passes as the test set needs."""
    rows = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("name", "t"), F.lit(n)))
    # one block at a time, of a size just measured
    return [items_of([(r.name, r.t) for r in dealt.where(F.col("b") == k).collect()], window) for k in range(n)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of s in ascending order; s ends in a number that stands nowhere else, all under 2**BITS.

    Each round sorts what is still tied by three ranks at once, so the depth triples.
    """
    n = len(s)
    rank = np.zeros(n + 1, np.uint64)
    rank[:n] = s
    sa, slots, depth = np.arange(n), np.arange(n), 1
    while slots.size:
        tied = sa[slots]
        key = rank[tied] << np.uint64(2 * BITS) | rank[np.minimum(tied + depth, n)] << np.uint64(BITS) | rank[np.minimum(tied + 2 * depth, n)]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        sa[slots] = tied
        new = np.r_[True, key[1:] != key[:-1]]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(key)])
        rank[tied] = np.repeat(slots[begin], size)
        slots = slots[np.repeat(size > 1, size)]
        depth *= 3
    return sa


def _bound(s: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, depth: int, after: bool) -> np.ndarray:
    """First place in lo..hi whose word at this depth is not under value (with after: is over it), for many at once."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while open_.size:
        mid = (lo[open_] + hi[open_]) >> 1
        v = s[sa[mid] + depth]
        low = v <= value[open_] if after else v < value[open_]
        lo[open_[low]] = mid[low] + 1
        hi[open_[~low]] = mid[~low]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(s: np.ndarray, sa: np.ndarray, codes: np.ndarray, left: np.ndarray, window: np.ndarray):
    """(longest match, its first and last + 1 place in sa, and the same two for the window) of every suffix of codes.

    codes are words as they stand in s, -1 for words that do not; a suffix has left words. Windows that stand
    nowhere have an empty range.
    """
    n = len(codes)
    longest, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(sa))
    wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    heads = s[sa]
    here, depth = np.flatnonzero(codes >= 0), 0
    while here.size:
        value = codes[here + depth]
        if depth:
            a = _bound(s, sa, lo[here], hi[here], value, depth, False)
            b = _bound(s, sa, a, hi[here], value, depth, True)
        else:
            a, b = np.searchsorted(heads, value), np.searchsorted(heads, value, "right")
        depth += 1
        alive = a < b
        here, a, b = here[alive], a[alive], b[alive]
        lo[here], hi[here], longest[here] = a, b, depth
        at = window[here] == depth
        wlo[here[at]], whi[here[at]] = a[at], b[at]
        here = here[left[here] > depth]
        here = here[codes[here + depth] >= 0]
    return longest, lo, hi, wlo, whi


def _shards(found: words.Words, window: int, most: int):
    """(words as a sequence with an end after each part, global place of each, which are repeated for the next shard).

    Parts are whole texts, or stretches of long ones that share window - 1 words with the next stretch.
    """
    parts = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        parts += [(x, min(x + most, b), min(x + most + window - 1, b)) for x in range(a, b, most)]
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + parts[end][2] - parts[end][0] <= most) and end - at < most // 2:
            size += parts[end][2] - parts[end][0]
            end += 1
        some = np.array(parts[at:end])
        length = some[:, 2] - some[:, 0] + 1
        begin = np.cumsum(length) - length
        place = np.repeat(some[:, 0] - begin, length) + np.arange(length.sum())
        ends = begin + length - 1
        s = found.codes[np.minimum(place, len(found) - 1)].astype(np.int64) + len(some)
        s[ends] = np.arange(len(some))
        own = place < np.repeat(some[:, 1], length)
        own[ends] = False
        yield s, place, own, len(some)
        at = end


def _dense(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes numbered without gaps in their order, and wanted codes as they are numbered there (-1: not there)."""
    seen = np.zeros(int(max(codes.max(initial=-1), wanted.max(initial=-1))) + 2, np.int64)
    seen[codes] = 1
    number = np.cumsum(seen) - 1
    return number[codes], np.where(seen[wanted] > 0, number[wanted], -1)


class _Group:
    """A task's texts of the moment against one block of items."""

    def __init__(self, texts: list[bytes], items: Items, window: int, shard: int):
        self.found, self.items = words.split(texts), items
        known = pc.index_in(items.terms, value_set=self.found.terms).fill_null(-1).to_numpy().astype(np.int64)
        self.shards = self._searched(known[items.codes] if len(items.codes) else np.empty(0, np.int64), window, shard)

    def _searched(self, wanted, window, shard):
        if not len(wanted):
            return
        for s, place, own, ends in _shards(self.found, window, shard):
            word = s >= ends
            numbered, codes = _dense(np.where(word, s - ends, 0), wanted)
            # ends keep their own numbers below all words; words get numbers without gaps, which fit the packed keys
            s = np.where(word, np.where(word, numbered, 0) + ends, s)
            codes = np.where(codes >= 0, codes + ends, -1)
            sa = suffix_array(s)
            yield (place, own, sa, *search(s, sa, codes, self.items.left, self.items.window))

    def hits(self) -> tuple[np.ndarray, list[set]]:
        """Which words of the texts stand in an occurrence of a window, and the items found in each text."""
        found, items = self.found, self.items
        edge = np.zeros(len(found) + 1, np.int64)
        text = found.text_of_words()
        names = [set() for _ in range(len(found.first) - 1)]
        whose = np.repeat(np.arange(len(items.names)), np.diff(items.first))
        for place, own, sa, _, _, _, lo, hi in self.shards:
            some = np.flatnonzero(lo < hi)
            if not some.size:
                continue
            # equal windows have one range, so no place is looked at twice
            ranges, back = np.unique(np.stack([lo[some], hi[some], items.window[some]]), axis=1, return_inverse=True)
            holders = [set() for _ in range(ranges.shape[1])]
            for k, i in zip(back.ravel().tolist(), whose[some].tolist()):
                holders[k].add(items.names[i])
            for (a, b, size), who in zip(ranges.T.tolist(), holders):
                at = sa[a:b]
                at = place[at[own[at]]]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                for t in np.unique(text[at]).tolist():
                    names[t] |= who
        return np.cumsum(edge[:-1]) > 0, names


def _block_pass(items: Items, window: int, shard: int, text: int):
    """Adds what one block of items hits to rows (t, carried, n_words, spans, names)."""

    def run(batches):
        for t, texts in gathered(batches, "t", text):
            g = _Group(texts, items, window, shard)
            hit, names = g.hits()
            spans, found = t.column("spans").to_pylist(), t.column("names").to_pylist()
            first = g.found.first
            fresh = np.zeros(len(hit) + 1, bool)
            fresh[first] = True
            begin = np.flatnonzero(hit & (fresh[:-1] | ~np.r_[False, hit[:-1]]))
            end = np.flatnonzero(hit & (fresh[1:] | ~np.r_[hit[1:], False])) + 1
            cut = np.searchsorted(begin, first)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                x = slice(cut[k], cut[k + 1])
                spans[k] += (np.stack([begin[x], end[x]], 1).ravel() - first[k]).tolist()
                found[k] += sorted(n for n in names[k] if n is not None)
            for name, kind, made in (("n_words", pa.int64(), g.found.counts), ("spans", pa.list_(pa.int64()), spans), ("names", pa.list_(pa.string()), found)):
                t = t.set_column(t.schema.get_field_index(name), name, pa.array(made, kind))
            yield from t.to_batches(max_chunksize=1000)

    return run


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard: int = SHARD, text: int = TEXT, block: int = BLOCK, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items): every row of docs(doc_id, text) with its words, the words that stand in a test
    window, and the ids (as strings, in order) of the test items with a window there.

    With carry a struct ``carried`` of all columns of docs comes instead of doc_id. Windows are ``window`` consecutive words of an item, or all
    words of a shorter one; words are runs of ASCII letters (lower-cased), digits and characters above ASCII.
    Null and empty texts have no words. Items without words have no window; items without an id count for n_hit and
    are not named. Items that repeat an id are one item with all their windows. Rows that repeat a doc_id, or have
    none, are texts of their own. Empty tables of either kind are fine. Long texts are searched in stretches that
    overlap, so no window is missed.
    """
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("names")]
    src = docs.select(F.col("text").cast("string").alias("t"), F.struct(*(docs[c] for c in docs.columns)).alias("carried") if carry else F.col("doc_id"), *none)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema])
    for some in blocks(items, window, block):
        src = src.mapInArrow(_block_pass(some, window, shard, text), schema)
    names = F.array_sort(F.array_distinct("names"))
    return src.select("carried" if carry else "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), names.alias("items"))


def _covered(spans):
    """Words under any of the flattened [start, end) spans."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda k: F.struct(F.get(spans, k).alias("a"), F.get(spans, k + 1).alias("b")))
    step = lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(x.a, acc.top))).alias("n"), F.greatest(acc.top, x.b).alias("top"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("top"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.array_sort(pairs), zero, step, lambda acc: acc.n))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs(text, ...) in which no window of a test item stands, as they came."""
    return scan(docs, items, window, carry=True).where("n_hit = 0").select("carried.*")


def longest_matches(docs: DataFrame, items: DataFrame, shard: int = SHARD, text: int = TEXT, block: int = BLOCK) -> DataFrame:
    """(item_id, start, length, doc_id, position): the longest verbatim match in docs of every suffix of every item.

    start and position count words from 0; of equally long matches the one in the smallest doc_id at the smallest
    position is given (rows without an id last), suffixes whose first word stands nowhere are left out. A task
    sends one row a suffix at most, so the shuffle does not grow with the matches.
    """

    def run_of(items_: Items):
        def run(batches):
            best: dict[int, tuple] = {}
            for t, texts in gathered(batches, "t", text):
                g, ids = _Group(texts, items_, 1 << 30, shard), t.column("doc_id").to_pylist()
                of = g.found.text_of_words()
                key = np.array([(1 << 63) - 1 if x is None else x for x in ids], np.int64)
                rank = np.lexsort((key, np.array([x is None for x in ids], bool)))
                order = np.empty(len(ids), np.int64)
                order[rank] = np.arange(len(ids))
                for place, _, sa, longest, lo, hi, _, _ in g.shards:
                    for q in np.flatnonzero(longest).tolist():
                        if longest[q] < best.get(q, (0,))[0]:
                            continue
                        at = place[sa[lo[q] : hi[q]]]
                        w = at[np.lexsort((at, order[of[at]]))[0]]
                        one = (int(longest[q]), ids[of[w]], int(w - g.found.first[of[w]]))
                        worst = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
                        if q not in best or worst(one) < worst(best[q]):
                            best[q] = one
            whose = np.repeat(np.arange(len(items_.names)), np.diff(items_.first))
            rows = [(items_.names[whose[q]], int(q - items_.first[whose[q]]), *x) for q, x in best.items()]
            for k in range(0, len(rows), 10_000):
                cols = list(zip(*rows[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, [pa.string(), *[pa.int64()] * 4])], ["item_id", "start", "length", "doc_id", "position"])

        return run

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    found = None
    for some in blocks(items, 1 << 30, block):
        part = src.mapInArrow(run_of(some), "item_id string, start long, length long, doc_id long, position long")
        found = part if found is None else found.unionByName(part)
    order = F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("z"), "doc_id", "position")
    one = found.groupBy("item_id", "start").agg(F.min(order).alias("m"))
    return one.select("item_id", "start", (-F.col("m.l")).alias("length"), F.col("m.doc_id").alias("doc_id"), F.col("m.position").alias("position"))


def op12_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items at windows of 10 words."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    sha = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _words_sql(table: str, name: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"SELECT {name}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM ({_words_sql("documents", "doc_id")})), i AS MATERIALIZED ({_words_sql("benchmark", "item_id")}),
wi AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(list_slice(w, p, p + least(len(w), {WINDOW}) - 1), ' ') AS g
 FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM i WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM wi),
wd AS (SELECT r, p, l, array_to_string(list_slice(w, p, p + l - 1), ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls WHERE len(w) >= l)),
o AS MATERIALIZED (SELECT r, p, wi.l, item_id FROM wd JOIN wi ON wd.g = wi.g AND wd.l = wi.l),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM o) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
