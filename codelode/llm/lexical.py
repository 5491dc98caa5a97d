"""Ranked lexical search over inverted treaps.

Documents are dealt into shards, a task's texts of the moment. The index keeps, for every shard and term, the
documents that hold the term and how often, and one row a shard with its documents' ids and lengths. A search
reads the posting lists of the query terms alone and makes a treap of each: in doc_id order from left to right,
the largest impact on top, so the root of any subtree bounds all of it. All queries go down all their treaps at
the same time. A range of documents is dropped when the summed roots of its terms cannot enter the top k; else
the document of its heaviest root is scored and the range falls into two, each term's treap being cut there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm import words
from codelode.llm.common import shuffle_width, table, whole_groups
from codelode.llm.words import gathered

TOP = 20
TEXT = 1 << 24  # bytes of text in a shard; longer texts are shards of their own
BLOCK = 1 << 22  # bytes of query text searched in one pass over the index
RANGES = 2048  # ranges of documents cut at once
INDEX = "term string, shard long, n long, words long, docs binary, tfs binary, ids binary, nulls binary"


def build(docs: DataFrame, text: int = TEXT) -> DataFrame:
    """The index of docs(doc_id, text), written to shared storage: a row for each shard and term, in order of terms.

    docs holds the places of documents in their shard (32 bits each, ascending) and tfs the occurrences there. The
    row of the empty term has a shard's ids and, in tfs, lengths in words; n are its documents and words their sum.
    Documents without words are left out. Rows that repeat a doc_id are documents of their own.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for t, texts in gathered(batches, "t", text):
            found = words.split(texts)
            size = found.counts
            ids = t.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            some = np.flatnonzero(size)
            if not some.size:
                continue
            some = some[np.lexsort((ids[some], null[some]))]
            place = np.zeros(len(size), np.int64)
            place[some] = np.arange(len(some))
            key = np.sort(found.codes.astype(np.int64) * len(some) + np.repeat(place, size))
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            tf = np.diff(np.r_[new, len(key)]).astype(np.int32)
            code, doc = np.divmod(key[new], len(some))
            begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = np.r_[begin, len(code)]
            columns = [found.terms.cast(pa.string()), pa.array(np.full(len(begin), number)), pa.array(np.diff(ends)), pa.nulls(len(begin), pa.int64())]
            offsets = pa.py_buffer((ends * 4).astype(np.int32))
            for values in (doc.astype(np.int32), tf):
                columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(values)]))
            columns += [pa.nulls(len(begin), pa.binary())] * 2
            rows = pa.RecordBatch.from_arrays(columns, names)
            rows = rows.take(pc.sort_indices(rows.column("term")))
            head = ["", number, len(some), int(size.sum()), b"", size[some].astype(np.int64).tobytes(), ids[some].astype(np.int64).tobytes(), null[some].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(head, rows.schema)], names)
            for at in range(0, rows.num_rows, 20_000):
                yield rows.slice(at, 20_000)
            number += 1

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    return table(src.mapInArrow(run, INDEX), "treaps")[0]


def treap(imp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left child, right child, root of each list) of the treaps over lists of impacts laid end to end.

    A node's parent is the smaller of the next greater ones on its two sides (of equal ones the first is greater);
    these are found for all nodes together by following what smaller neighbours found. No child is len(imp).
    """
    n = len(imp)
    lists = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before, after = np.arange(n) - 1, np.arange(n) + 1
    low, high = first[lists] - 1, first[lists + 1]
    for side, end, over in ((before, low, lambda a, b: a >= b), (after, high, lambda a, b: a > b)):
        todo = np.arange(n)
        while todo.size:
            todo = todo[side[todo] != end[todo]]
            todo = todo[~over(imp[side[todo]], imp[todo])]
            side[todo] = side[side[todo]]
    left, right = np.full(n + 1, n), np.full(n + 1, n)
    has_l, has_r = before != low, after != high
    # the lower of the two greater neighbours; of equal ones the right one, which ranks below the left
    up = has_l & (~has_r | (imp[before] < imp[np.minimum(after, n - 1)])) if n else has_l
    down = has_r & ~up
    at = np.arange(n)
    right[before[up]] = at[up]
    left[after[down]] = at[down]
    root = np.full(len(first) - 1, n)
    top = ~(has_l | has_r)
    root[lists[top]] = at[top]
    return left, right, root


class Shard:
    """Posting lists of a shard as treaps laid end to end; node len(doc) stands for an empty treap."""

    def __init__(self, doc: np.ndarray, imp: np.ndarray, first: np.ndarray, docs: int):
        self.left, self.right, self.root = treap(imp, first)
        self.doc, self.imp, self.docs = np.r_[doc, -1], np.r_[imp, 0], docs

    def cut(self, nodes: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray):
        """Cut treaps (rows: ranges a .. b, columns: terms) at the documents d.

        Gives the highest nodes in a .. d and in d + 1 .. b, and the nodes of d itself.
        """
        none = len(self.imp) - 1
        shape, cur = nodes.shape, nodes.ravel()
        a, b, d = (np.repeat(x, shape[1]) for x in (a, b, d))
        low, high, hit = (np.full(cur.size, none) for _ in range(3))
        act = np.flatnonzero(cur != none)
        cur = cur[act]
        sides = [[], []]
        while act.size:
            doc = self.doc[cur]
            less, more = doc < d[act], doc > d[act]
            x = less & (doc >= a[act]) & (low[act] == none)
            low[act[x]] = cur[x]
            x = more & (doc < b[act]) & (high[act] == none)
            high[act[x]] = cur[x]
            same = ~(less | more)
            hit[act[same]] = cur[same]
            sides[0].append((act[same], self.left[cur[same]]))
            sides[1].append((act[same], self.right[cur[same]]))
            cur = np.where(less, self.right[cur], self.left[cur])[~same]
            act = act[~same]
            live = cur != none
            act, cur = act[live], cur[live]
        # below a node of d itself the two sides go on apart
        for side, out in ((0, low), (1, high)):
            act = np.concatenate([x for x, _ in sides[side]] or [np.empty(0, np.int64)])
            cur = np.concatenate([x for _, x in sides[side]] or [np.empty(0, np.int64)])
            live = (cur != none) & (out[act] == none)
            act, cur = act[live], cur[live]
            while act.size:
                doc = self.doc[cur]
                inside = (doc >= a[act]) & (doc < b[act])
                out[act[inside]] = cur[inside]
                act, cur = act[~inside], cur[~inside]
                cur = self.right[cur] if side == 0 else self.left[cur]
                live = cur != none
                act, cur = act[live], cur[live]
        return low.reshape(shape), high.reshape(shape), hit.reshape(shape)


def search(shard: Shard, terms: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, document, score) of the best k documents a query, and the documents scored on the way.

    terms are the posting lists of each query (rows padded with -1), weight their weights; least are scores that
    k documents elsewhere reach, so that lower ones are of no use.
    """
    none = len(shard.imp) - 1
    roots = np.where(terms >= 0, np.r_[shard.root, none][terms], none)
    q = np.flatnonzero((roots != none).any(axis=1))
    a, b, nodes = np.zeros(len(q), np.int64), np.full(len(q), shard.docs), roots[q]
    floor, floor_doc = np.maximum(least, 0), np.full(len(terms), shard.docs)
    floor_doc[floor == 0] = -1
    best = tuple(np.empty(0, np.int64) for _ in range(3))
    scored = 0
    while q.size:
        value = shard.imp[nodes] * weight[q]
        most = value.sum(axis=1)
        may = (most > floor[q]) | ((most == floor[q]) & (a < floor_doc[q]))
        q, a, b, nodes, value, most = (x[may] for x in (q, a, b, nodes, value, most))
        if not q.size:
            break
        rest = np.empty(0, np.int64)
        now = np.arange(q.size)
        if q.size > RANGES:
            order = np.argpartition(-most, RANGES)
            now, rest = order[:RANGES], order[RANGES:]
        heavy = nodes[now, value[now].argmax(axis=1)]
        d = shard.doc[heavy]
        low, high, hit = shard.cut(nodes[now], a[now], b[now], d)
        score = (shard.imp[hit] * weight[q[now]]).sum(axis=1)
        scored += len(now)
        who, doc, got = (np.concatenate(x) for x in zip(best, (q[now], d, score)))
        order = np.lexsort((doc, -got, who))
        who, doc, got = who[order], doc[order], got[order]
        begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        nth = np.arange(len(who)) - np.repeat(begin, np.diff(np.r_[begin, len(who)]))
        keep = (nth < k) & (got > 0)
        last = keep & (nth == k - 1)
        better = got[last] > floor[who[last]]
        floor_doc[who[last]] = np.where(better | (floor_doc[who[last]] < shard.docs), doc[last], floor_doc[who[last]])
        floor[who[last]] = np.maximum(floor[who[last]], got[last])
        best = who[keep], doc[keep], got[keep]
        q = np.concatenate([q[rest], q[now], q[now]])
        a, b = np.concatenate([a[rest], a[now], d + 1]), np.concatenate([b[rest], d, b[now]])
        nodes = np.concatenate([nodes[rest], low, high])
    return (*best, scored)


class Queries:
    """A block of queries: their names, and the terms and counts of each as matrices padded with -1 and 0."""

    def __init__(self, rows: list[tuple]):
        self.names = sorted({name for name, _ in rows}, key=lambda x: (x is None, x))
        number = {name: k for k, name in enumerate(self.names)}
        found = words.split([(text or "").encode() for _, text in rows])
        self.terms = [x.decode() for x in found.terms.to_pylist()]
        counts: list[dict[int, int]] = [{} for _ in self.names]
        for (name, _), a, b in zip(rows, found.first, found.first[1:]):
            mine = counts[number[name]]
            for c in found.codes[a:b].tolist():
                mine[c] = mine.get(c, 0) + 1
        width = max([1, *map(len, counts)])
        self.which, self.times = np.full((len(self.names), width), -1), np.zeros((len(self.names), width), np.int64)
        for k, mine in enumerate(counts):
            self.which[k, : len(mine)], self.times[k, : len(mine)] = list(mine), list(mine.values())


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 12 * m) with m = 75 + (25 * length * docs) div total, in whole numbers."""
    if 25 * int(length.max(initial=0)) * docs < 1 << 63:
        m = 75 + 25 * length * docs // max(1, total)
    else:
        m = np.array([75 + 25 * n * docs // total for n in length.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def rank(index: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of queries(item_id, text).

    Scores are as in ``impacts`` and ``weight``, summed over the query's terms with repeats; only scores over 0 count,
    equal ones go by doc_id, documents without an id last. Rows of queries that share an item_id (or have none) are one query of all their
    terms. Queries without terms, or whose terms no document holds, give no rows; nor does an empty index. A shard's
    lists meet in one task, which searches its shards one after the other and passes on what k documents reach.
    """
    rows = queries.select(F.col("item_id"), F.col("text").cast("string").alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-total // block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    docs, length = index.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    kind = rows.schema["item_id"].dataType
    out = None
    for p in range(passes):  # a block of a size just measured is brought to the driver and sent to the tasks
        q = Queries([(r.item_id, r.t) for r in dealt.where(F.col("b") == p).collect()])
        part = _ranked(index, q, docs, length, k)
        names = index.sparkSession.createDataFrame(list(enumerate(q.names)), f"q int, item_id {kind.simpleString()}")
        part = part.join(F.broadcast(names), "q").drop("q")  # names of the block's queries
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked(index: DataFrame, q: Queries, docs: int, length: int, k: int) -> DataFrame:
    """(q, doc_id, score): each task's best k documents of every query."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([("", -1), *((t, n) for n, t in enumerate(q.terms))], "term string, number int")
    lists = index.join(F.broadcast(wanted), "term")  # the terms of a block of queries
    df = {r.number: r.df for r in lists.where("number >= 0").groupBy("number").agg(F.sum("n").alias("df")).collect()}  # likewise
    by_term = np.array([weight(df[n], docs) if n in df else 0 for n in range(len(q.terms))], np.int64)
    which, times = q.which, q.times

    def run(batches):
        least = np.zeros(len(which), np.int64)
        best: list[list] = [[] for _ in which]
        for t in whole_groups(batches, ["shard"]):
            t = t.combine_chunks()
            number = t.column("shard").to_numpy()
            edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
            for lo, hi in zip(edge, edge[1:]):
                g = t.slice(lo, hi - lo)
                ids, null = (np.frombuffer(g.column(c)[0].as_py(), kind) for c, kind in (("ids", np.int64), ("nulls", bool)))
                size = np.frombuffer(g.column("tfs")[0].as_py(), np.int64)
                have = g.column("number").to_numpy()[1:]
                first = np.concatenate([[0], np.cumsum(g.column("n").to_numpy()[1:])])
                doc, tf = (np.frombuffer(b"".join(g.column(c).to_pylist()[1:]), np.int32).astype(np.int64) for c in ("docs", "tfs"))
                shard = Shard(doc, impacts(tf, size[doc], docs, length), first, len(ids))
                local = np.full(len(by_term) + 1, -1)
                local[have] = np.arange(len(have))
                weights = np.where(which >= 0, by_term[which] * times, 0) if len(by_term) else times
                who, at, score, _ = search(shard, local[which], weights, k, least)
                for x, y, s in zip(who.tolist(), at.tolist(), score.tolist()):
                    best[x].append((-s, bool(null[y]), int(ids[y])))
                for x in np.unique(who).tolist():
                    best[x] = sorted(best[x])[:k]
                    if len(best[x]) == k:
                        least[x] = -best[x][-1][0]
        rows = [(x, None if z else i, -s) for x, mine in enumerate(best) for s, z, i in mine]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[at : at + 10_000]), (pa.int32(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])

    dealt = lists.repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard", "number")
    return dealt.select("shard", "number", "n", "docs", "tfs", "ids", "nulls").mapInArrow(run, "q int, doc_id long, score long")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item among all documents."""
    return rank(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _terms_sql(relation: str, name: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"SELECT {name}, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{upper}', '{upper.lower()}') AS t FROM {relation}"


OP11_SQL = f"""
WITH p AS MATERIALIZED (SELECT r, doc_id, t, count(*) AS tf FROM ({_terms_sql("(SELECT row_number() OVER () AS r, doc_id, text FROM documents)", "r, doc_id")}) GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
m AS (SELECT r, 100 - 25 + ((25 * n * docs) // l) AS m FROM n, s),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY t, docs),
i AS (SELECT item_id, t, count(*) AS c FROM ({_terms_sql("benchmark", "item_id")}) GROUP BY ALL),
x AS (SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""
