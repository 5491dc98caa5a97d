"""Ranked search, decontamination and clustering against brute force on small fixtures; their SQL is in test_llm."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import clusters, leaks, lexical, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = [None, "", " \n", "a", "Äa-B_c 字字\x00xİZ9", "the Cat sat. on the mat", "THE cat sat on the mat", "x " * 400, "one two three four five six seven eight nine ten eleven twelve"]


def split(text):
    return WORD.findall((text or "").translate(FOLD))


def prose(rng, n, vocabulary=30):
    return " ".join(f"w{min(int(rng.expovariate(0.2)), vocabulary)}" for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    rows = [(k if ids is None else ids[k], t, "x", 1, b"y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, term string, n long, t binary")


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_words():
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randrange(40)) for _ in range(50))]
    for piece in (1, 7, 1 << 24):
        found = words.split([(t or "").encode() for t in texts], piece)
        terms = found.terms.to_pylist()
        assert [[terms[c].decode() for c in found.codes[a:b]] for a, b in zip(found.first, found.first[1:])] == [split(t) for t in texts]
        assert len(set(terms)) == len(terms)
    assert len(words.split([])) == len(words.split([b"", b" "])) == 0


# ranked search


def ranked(docs, items, k=20):
    terms = [(i, split(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for x, d in df.items()}
    joined = {}
    for i, t in items:
        joined[i] = joined.get(i, []) + split(t)
    out = []
    for item, query in joined.items():
        scores = []
        for i, t in terms:
            m = 100 - 25 + (25 * len(t) * n) // total
            s = sum(weight[x] * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 12 * m)) for x in query if x in t)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if z else i, -s) for r, (s, z, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_treaps_and_traversal():
    rng = np.random.default_rng(0)
    for _ in range(120):
        docs, terms, queries, k = (int(rng.integers(1, x)) for x in (60, 8, 6, 6))
        lists = [np.sort(rng.choice(docs, rng.integers(1, docs + 1), replace=False)) for _ in range(terms)]
        imps = [rng.integers(1, 6, len(x)) for x in lists]
        first = np.r_[0, np.cumsum([len(x) for x in lists])]
        shard = lexical.Shard(np.concatenate(lists), np.concatenate(imps), first, docs)

        def inorder(x):
            if x == first[-1]:
                return []
            assert all(shard.imp[c] <= shard.imp[x] for c in (shard.left[x], shard.right[x]))
            return inorder(shard.left[x]) + [x] + inorder(shard.right[x])

        assert all(inorder(shard.root[t]) == list(range(first[t], first[t + 1])) for t in range(terms))
        width = int(rng.integers(1, terms + 1))
        which, weight = np.array([rng.choice(terms, width, replace=False) for _ in range(queries)]), rng.integers(0, 4, (queries, width))
        who, doc, score, _ = lexical.search(shard, which, weight, k, np.zeros(queries, np.int64))
        for q in range(queries):
            sums = np.zeros(docs, np.int64)
            for t, w in zip(which[q], weight[q]):
                sums[lists[t]] += w * imps[t]
            want = sorted((-v, d) for d, v in enumerate(sums.tolist()) if v)[:k]
            assert [(-s, d) for x, d, s in zip(who, doc, score) if x == q] == want


def test_traversal_prunes():
    """A rare heavy term makes most ranges of a common light one worthless."""
    n = 4000
    lists, imps = [np.arange(n), np.arange(0, n, 100)], [np.full(n, 3), np.full(n // 100, 900)]
    shard = lexical.Shard(np.concatenate(lists), np.concatenate(imps), np.r_[0, n, n + n // 100], n)
    who, doc, _, scored = lexical.search(shard, np.array([[0, 1]]), np.array([[1, 1]]), 20, np.zeros(1, np.int64))
    assert doc.tolist() == list(range(0, 2000, 100)) and scored < 200


@pytest.mark.parametrize("text", [1, 300, lexical.TEXT])
def test_ranked_search(spark, text):
    rng = random.Random(4)
    texts = [*ODD, *(prose(rng, rng.randrange(60)) for _ in range(150))]
    texts += texts[20:40] + texts[20:25] * 5
    ids = [rng.randrange(1 << 62, (1 << 63) - 1) if k % 7 == 3 else k for k in range(len(texts))]
    ids[30], ids[31], ids[33] = None, None, ids[32]
    items = [(1, "w1 w2 w2 w9 zebra"), (2, prose(rng, 30)), (2, "w17 w17"), (3, ""), (4, None), (5, "nowhere"), (None, "w3 W4"), (6, "the mat 字字")]
    got = found(lexical.rank(lexical.build(frame(spark, texts, ids).repartition(3), text), benchmark(spark, items)))
    assert got == ranked(list(zip(ids, texts)), items)
    assert len(got) > 60 and all(a[:2] != b[:2] for a, b in zip(got, got[1:]))


def test_ranked_search_in_blocks(spark):
    rng = random.Random(5)
    texts, items = [prose(rng, 30) for _ in range(80)], [(k, prose(rng, 12)) for k in range(9)]
    index = lexical.build(frame(spark, texts))
    assert found(lexical.rank(index, benchmark(spark, items), 7, block=100)) == ranked(list(enumerate(texts)), items, 7)


def test_ranked_search_of_nothing(spark):
    none, some = frame(spark, []), benchmark(spark, [(1, "a")])
    assert lexical.rank(lexical.build(none), some).count() == 0
    assert lexical.rank(lexical.build(frame(spark, [None, "", "-"])), some).count() == 0
    assert lexical.rank(lexical.build(frame(spark, ["a"])), some.limit(0)).count() == 0


def test_large_numbers():
    """Lengths whose products pass 64 bits take whole numbers of any size."""
    tf, length = np.array([3, 1 << 30]), np.array([1 << 40, 1 << 50])
    want = [1_000_000_000 * t // (1000 * t + 12 * (75 + 25 * n * 10**9 // 10**20)) for t, n in zip(tf.tolist(), length.tolist())]
    assert lexical.impacts(tf, length, 10**9, 10**20).tolist() == want


# decontamination


def hits(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, names = split(t), set(), set()
        for name, text in items:
            v = split(text)
            size = min(window, len(v))
            grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for p in range(len(w) - size + 1):
                if size and tuple(w[p : p + size]) in grams:
                    hit |= set(range(p, p + size))
                    names.add(name)
        out.append((len(w), len(hit), sorted(str(n) for n in names if n is not None)))
    return out


def leaky(rng):
    items = [(k, prose(rng, 25, 200)) for k in range(12)] + [(12, "alpha beta"), (13, "solo"), (3, prose(rng, 14, 200)), (None, "uno dos tres"), (14, ""), (15, None), (16, "r " * 30), (17, "r " * 10)]
    texts = [*ODD, "uno dos tres y alpha beta; SOLO", "r " * 55, ""]
    for _ in range(60):
        v = split(rng.choice(items[:12])[1])
        a, b = sorted(rng.sample(range(len(v) + 1), 2))
        texts.append(prose(rng, rng.randrange(30), 200) + " " + " ".join(v[a:b]) + ", " + prose(rng, rng.randrange(30), 200))
    return items, texts + texts[20:26]


@pytest.mark.parametrize(("shard", "text"), [(64, 200), (11, 1 << 20), (leaks.SHARD, leaks.TEXT)])
def test_leaks(spark, shard, text):
    items, texts = leaky(random.Random(8))
    docs = frame(spark, texts, [None if k == 12 else min(k, 60) for k in range(len(texts))])
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in leaks.scan(docs, benchmark(spark, items), shard=shard, text=text).collect())
    assert got == sorted((str(None if k == 12 else min(k, 60)), *x) for k, x in enumerate(hits(texts, items)))
    assert sum(bool(x[2]) for x in got) > 20


def test_leaks_in_blocks(spark):
    items, texts = leaky(random.Random(9))
    got = leaks.scan(frame(spark, texts), benchmark(spark, items), block=300, window=6).orderBy("doc_id").collect()
    assert len(leaks.blocks(benchmark(spark, items), most=300)) > 3
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == hits(texts, items, 6)


def test_leaks_of_nothing(spark):
    items, texts = leaky(random.Random(9))
    assert leaks.scan(frame(spark, []), benchmark(spark, items)).count() == 0
    bare = leaks.scan(frame(spark, texts), benchmark(spark, items).limit(0)).collect()
    assert len(bare) == len(texts) and not any(r.n_hit or r["items"] for r in bare)


def test_decontaminate(spark):
    items, texts = leaky(random.Random(10))
    docs = frame(spark, texts).withColumn("spans", F.lit(2))
    left = leaks.decontaminate(docs, benchmark(spark, items))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(k, t) for k, (t, x) in enumerate(zip(texts, hits(texts, items))) if not x[1]]


@pytest.mark.parametrize("shard", [40, leaks.SHARD])
def test_longest_matches(spark, shard):
    """Longest match, and its first place by doc_id and position, of every suffix of every item."""
    rng = random.Random(11)
    items = [(k, prose(rng, 12)) for k in range(5)] + [(9, "nowhere w1"), (None, "w2")]
    texts = [prose(rng, rng.randrange(35)) for _ in range(40)] + [items[2][1] + " " + items[2][1], None]
    ids = [None if k == 3 else 100 - k // 2 for k in range(len(texts))]
    want = {}
    for name, text in items:
        v = split(text)
        for q in range(len(v)):
            for doc, t in zip(ids, texts):
                w = split(t)
                for p in range(len(w)):
                    n = 0
                    while q + n < len(v) and p + n < len(w) and v[q + n] == w[p + n]:
                        n += 1
                    one = (-n, doc is None, doc or 0, p)
                    if n and one < want.get((str(name), q), (1,)):
                        want[str(name), q] = one
    # a long text is searched in stretches; matches end there, so only whole texts are compared
    got = leaks.longest_matches(frame(spark, texts, ids), benchmark(spark, items), shard=shard, text=250).collect()
    assert {(str(r.item_id), r.start): (-r.length, r.doc_id is None, r.doc_id or 0, r.position) for r in got} == want


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 50, 400):
        s = np.r_[rng.integers(1, 4, n - 1), 0].astype(np.int64)
        assert leaks.suffix_array(s).tolist() == sorted(range(n), key=lambda k: s[k:].tolist())
    assert leaks.suffix_array(np.r_[np.ones(300, np.int64), 0]).tolist() == list(range(300, -1, -1))


# clustering


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, ids string")


def plain_lloyd(rows, k, rounds, dim, scale):
    import hashlib

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and abs(x) < 1e150 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", list(map(str, r[1]))))
    at = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(at)]
    found = [(i, *near(v)) for i, v in kept]
    per = {}
    for _, d, n in found:
        per[n] = per.get(n, 0) + d
    long = lambda x: x if x < 1 << 63 else None
    return sorted(map(str, ((i, n, long(d), long(per[n]), long(sum(per.values())), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, d, n in found)))


def clustered(df):
    return sorted(str((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in df.collect())


@pytest.mark.parametrize("block", [10, 64, clusters.BLOCK])
def test_lloyd(spark, block):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 5)) * 3
    x = (middles[rng.integers(0, 6, 200)] + rng.normal(size=(200, 5)) * 0.2).tolist()
    x += [x[0]] * 70 + np.round(rng.normal(size=(60, 5))).tolist()
    rows = [(k if k % 50 else None, v) for k, v in enumerate(x)] + [(7, x[9]), (7, x[9]), (1 << 62, x[3])]
    rows += [(900, None), (901, [1.0] * 4), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [float("inf")] * 5), (905, []), (906, [0.0] * 5), (907, [-0.0] * 5)]
    df = vectors(spark, [(i, v, 0, "x") for i, v in rows])
    assert clustered(clusters.lloyd(df.repartition(3), 9, 3, 5, block=block)) == plain_lloyd(rows, 9, 3, 5, 256)


def test_lloyd_few_and_none(spark):
    rows = [(3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [0.5, -0.3])]
    df = vectors(spark, [(i, v, 0, "x") for i, v in rows])
    assert clustered(clusters.lloyd(df, 9, 2, 2)) == plain_lloyd(rows, 9, 2, 2, 256)
    empty = clusters.lloyd(df.where("vec_id < 0"), 9, 2, 2)
    assert empty.count() == 0 and empty.dtypes == clusters.lloyd(df, 9, 2, 2).dtypes


def test_lloyd_large_numbers(spark):
    rows = [(k, [3.0e18 * (k % 5) + k, -1.0e25 * (k % 2), 0.25 * k]) for k in range(20)] + [(50, [1e149, 0.0, 0.0]), (51, [1e307, 0.0, 0.0])]
    df = vectors(spark, [(i, v, 0, "x") for i, v in rows])
    assert clustered(clusters.lloyd(df, 4, 2, 3)) == plain_lloyd(rows, 4, 2, 3, 256)


def test_cover_tree():
    """Children lie inside their node, their leads apart from each other, and every row stands in one leaf."""
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(300, 3)) * 100, np.repeat(rng.normal(size=(1, 3)) * 100, 80, axis=0)].round()
    tree = clusters.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for k in range(len(tree.lead)):
        rows = x[tree.order[tree.lo[k] : tree.hi[k]]]
        assert np.isclose(np.sqrt(((rows - x[tree.lead[k]]) ** 2).sum(axis=1)).max(), tree.far[k])
        kids = np.arange(tree.first[k], tree.last[k])
        if kids.size:
            assert tree.lo[kids[0]] == tree.lo[k] and tree.hi[kids[-1]] == tree.hi[k] and tree.lead[kids[0]] == tree.lead[k]
            lead = x[tree.lead[kids]]
            apart = np.sqrt(((lead[:, None] - lead[None]) ** 2).sum(axis=2))
            assert (apart[~np.eye(len(kids), dtype=bool)] > tree.far[kids].max()).all() or len(kids) == 1
