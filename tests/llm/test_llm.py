"""The llm operators against brute force on small fixtures and on the small tables."""

import hashlib
import random
import textwrap
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from codelode.llm import bpe, chunk_dedup, common, embeddings, exact_dedup, graph, gsaca, licenses, lines, packing, queries, simhash, suffix_dedup, toxicity

tok = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "\n", "a", "A b\tc\n\nA b\tc", "é" * 30 + " Ünïcode ﬁ 字 " * 9, "x" * 5000, "same line here\nother line there\n", "Same Line Here  \nthird line of it", "ab" * 400, "the quick brown fox jumps over the lazy dog " * 40]


def frame(spark, texts, first=0):
    rows = [(first + k, t, "ids", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, h string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("op", [bpe.encode, packing.pack, exact_dedup.exact_dedup, suffix_dedup.remove_repeats, lines.line_dedup, simhash.near_duplicates, chunk_dedup.chunk_dedup, licenses.scan])
def test_empty_table_null_id_repeats(spark, op):
    more = {bpe.encode: (tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN), packing.pack: (tok.path("word_bpe_49k.json"),)}.get(op, ())
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert op(empty, *more).count() == 0
    odd = frame(spark, ODD).unionByName(frame(spark, ODD[5:7], 5)).unionByName(frame(spark, ["null id text"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = op(odd, *more)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert set(ids) == set(range(len(ODD))) | {None}
    if op is not packing.pack:
        assert len(ids) == odd.count()


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    e = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "src long, dst long")
    label = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {n: c for n, c in label.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_op1_bounds_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:100] + rng.normal(size=(100, 16)) * np.linspace(0.02, 0.6, 100)[:, None]
    norm = np.linalg.norm(x, axis=1)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu((x @ x.T) / np.outer(norm, norm) >= 0.9, 1)))}
    q, *rest = embeddings.quantise(x)
    tile = (q.astype(np.int8), *rest)
    sure, open_ = set(), set()
    for i, j, s in embeddings.tile_pairs(tile, tile, 0.9, True):
        for a, b, k in zip(i.tolist(), j.tolist(), s.tolist()):
            (sure if k else open_).add((a, b))
    assert sure <= want <= sure | open_ and sure and open_ and len(open_) < len(want)
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0])]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[8] == (3, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 9)) and got[None] == (3, 1, False)
    clash = spark.createDataFrame([(1, [1.0, 0.0], 3, "a")], "vec_id long, embedding array<float>, d1 long, rep string")
    assert [tuple(r) for r in embeddings.near_duplicates(clash).collect()] == [(1, 0, 1, True)]
    assert embeddings.near_duplicates(clash.limit(0)).count() == 0


def test_op1_around_the_threshold(spark):
    """Vectors whose cosines crowd at 0.9, where most pairs are open, against brute force in double precision."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 24))
    x[1:90] = x[0] + rng.normal(size=(89, 24)) * np.linalg.norm(x[0]) / np.sqrt(24) * 0.333
    x = x.astype(np.float32).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    near = (x @ x.T) / np.outer(norm, norm) >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")).collect()}
    root = common.forest(len(x), *np.nonzero(np.triu(near, 1)))
    assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist() and near.any()
    assert [got[k].component_id for k in range(len(x))] == root.tolist()


def test_op1_many_tiles(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    a = sorted(map(tuple, embeddings.near_duplicates(v).collect()))
    assert a == sorted(map(tuple, embeddings.near_duplicates(v, tile=20).collect()))


def test_op2_round_trip(spark):
    enc = bpe.encoding(tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    long = "word don't  stop\n\n12 " * 9000 + "字" * 500
    rows = frame(spark, [*ODD, long])
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(rows, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).collect()}
    for k, t in enumerate([*ODD, long]):
        ids = enc.encode_ordinary(t or "")
        assert bytes(got[k].ids_le) == np.array(ids, "<u4").tobytes() and bytes(got[k].bytes) == (t or "").encode()
    assert len(list(bpe.safe_pieces(long))) > 1 and "".join(bpe.safe_pieces(long)) == long


def test_op2_long_runs(spark):
    """Runs that the library matches alike on shorter texts, and texts on which it fails."""
    ranks, pattern = tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN
    enc = bpe.encoding(ranks, pattern)
    for run in (" " * 70_000, "\n" * 70_000, "\t \n\u3000" * 20_000, "\xa0" * 70_001, "\x1c" * 70_000):
        for text in (run, "a" + run, run + "b", "a." + run + "1" + run + "!", "x" + run[:-1] + " y", "x" + run + "\nz", "x" + run[:1500] + "\x1c" + run):
            assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)
    rows = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "w" * 2_000_000, "1" * 1_000_000 + "\r\n" * 1_000_000]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, rows), ranks, pattern), ranks, pattern).collect()}
    assert [bytes(got[k].bytes).decode() for k in range(4)] == rows


def test_op2_table(spark, docs, texts):
    """Every column of the registered query, from the library on whole texts."""
    enc = bpe.encoding(tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    got = {r.doc_id: r for r in queries.QUERIES["op2_byte_bpe"](spark, DATA).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        ids = enc.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == want


def test_op3_ids_and_places(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    special = ["a<|endoftext|>b", "<|ENDOFTEXT|> <|startoftext|>", "<|startoftext|><|endoftext|>.", "é<|endof\ntext|> x<|endoftext|>é Ünï 字<|endoftext|>", "<|endoftext|>" * 2100]
    odd = frame(spark, ODD + special, 10_000_000)
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got: dict = {}
    for r in packing.pack(both, tok.path("word_bpe_49k.json"), with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    total, seqs = 0, {}
    for k, text in [*texts, *((10_000_000 + k, x) for k, x in enumerate(ODD + special))]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(got[k], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids
        for n, r in enumerate(own):
            part = ids[2048 * n : 2048 * (n + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (n, 2048 * n, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= 1.02 * -(-total // 2048) + 1


def test_op3_plan_covers_every_rank():
    rng = random.Random(1)
    histogram = {rng.randrange(1, 2049): rng.randrange(1, 500) for _ in range(300)}
    fill: dict = {}
    for length, lo, hi, seq, per, off in packing.plan(histogram):
        for p in range(lo, hi):
            fill.setdefault(seq + (p - lo) // per, []).append((off + (p - lo) % per * length, length))
    assert sum(map(len, fill.values())) == sum(histogram.values())
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_op4_chunks(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(70)
    rows = [text(200), passage + " " + text(100), text(50) + " inserted " + passage + text(90), text(150)]
    got = {r.doc_id: r for r in chunk_dedup.chunk_dedup(frame(spark, rows)).collect()}
    assert got[0].n_removed == got[1].n_removed == got[3].n_removed == 0 and got[2].n_removed >= 150
    big = (text(2000)).encode()
    assert chunk_dedup.cuts(big).tolist()[-1] == len(big)
    whole = chunk_dedup.cuts(big).tolist()
    before, chunk_dedup.BLOCK = chunk_dedup.BLOCK, 1000
    assert chunk_dedup.cuts(big).tolist() == whole
    chunk_dedup.BLOCK = before


def plain_chunks(text):
    n, h, ends = len(text), [], []
    for c in text:
        h.append(((h[-1] if h else 0) * 2 + int(chunk_dedup.GEAR[c])) % 2**32)
    r, start = chunk_dedup.RADIUS, 0
    for end in [p + 1 for p in range(r, n - r) if h[p] < min(h[p - r : p]) and h[p] == min(h[p : p + r + 1])] + [n] * (n > 0):
        ends += [*range(start + chunk_dedup.MAX_CHUNK, end, chunk_dedup.MAX_CHUNK), end] if end > start else []
        start = end
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def test_op4_brute_force(spark, texts):
    """All columns over the small table and odd rows, among them short whole copies, repeated and null ids."""
    rows = [*texts, *enumerate(ODD, 10_000), (10_100, "a short text"), (10_101, "a short text"), (10_102, "a short text"), (10_101, "a short text"), (10_103, "Z" * 60 + "a short text"), (None, "a short text"), (None, "none has this one" * 30)]
    parts = [plain_chunks((t or "").encode()) for _, t in rows]
    first: dict = {}
    order = lambda k, t: (k is None, k if k is not None else t)  # noqa: E731  rows without an id come last, equal texts as one
    for (k, t), own in zip(rows, parts):
        for c in own:
            first[c] = min(first.get(c, order(k, t)), order(k, t))
    want = []
    for (k, t), own in zip(rows, parts):
        gone = [c in own[:i] or first[c] < order(k, t) for i, c in enumerate(own)]
        kept, removed, spans, redundant, i = b"", 0, 0, 0, 0
        while i < len(own):
            j = i
            while j < len(own) and gone[j] == gone[i]:
                j += 1
            run = b"".join(own[i:j])
            if gone[i] and (len(run) >= 100 or j - i == len(own)):
                removed, spans, redundant = removed + len(run), spans + 1, redundant + j - i
            else:
                kept += run
            i = j
        want.append((k, len((t or "").encode()), len(own), redundant, removed, spans, kept))
    frame_ = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(*r[:6], bytes(r.kept)) for r in chunk_dedup.chunk_dedup(frame_).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(g[4] for g in got if g[0] in (10_100, 10_101, 10_102)) == [0, 12, 12, 12]


def test_op5_incremental(spark, tmp_path):
    at = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, at, 4)
    one = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.add(frame(spark, ["A", "a", "É", "é", None, ""]), "first").collect()}
    assert one == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True)}
    two = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.DigestIndex(spark, at, 4).add(frame(spark, ["a", "new"], 10), "second").collect()}
    assert two == {10: (1, False), 11: (11, True)}
    for k in range(3):
        exact_dedup.DigestIndex(spark, at, 4).add(frame(spark, [f"more {k} {n}" for n in range(5)] + ["new"], 100 * k + 100)).collect()
    index = exact_dedup.DigestIndex(spark, at, 4)
    assert len(index.generations()) <= 4 and sum(g.rows for g in index.generations()) == 4 + 1 + 15
    # a batch that comes again, as after a lost job, gives the same rows and appends nothing
    again = {r.doc_id: (r.keep_id, r.kept) for r in index.add(frame(spark, ["a", "new"], 10), "second").collect()}
    assert again == two and sum(g.rows for g in exact_dedup.DigestIndex(spark, at).generations()) == 20
    plan = exact_dedup.exact_dedup(frame(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op5_index_is_read_sorted(spark, tmp_path):
    """Neither a shuffle nor a sort stands over the scan of the index, and no Python in the plan."""
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.add(frame(spark, [f"text {k}" for k in range(100)]))
    groups = exact_dedup.digests(frame(spark, ["text 5", "unseen"])).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    spark.conf.set(exact_dedup.SORTED_READ, "true")
    try:
        plan = index.fresh(groups, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(exact_dedup.SORTED_READ, "false")
    below = plan[plan.index("SortMergeJoin") :].split("\n")
    scan = next(k for k, line in enumerate(below) if "codelode_digests" in line and "Scan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(below[scan])
    for line in reversed(below[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    assert above and not any("Sort [" in x or "Exchange" in x for x in above[:-1]) and "SortMergeJoin" in above[-1]
    assert "Python" not in plan and "Arrow" not in plan


def test_op6_rules(spark):
    mit = "The MIT License (MIT)\n\n" + "\n".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-condition", "as-is-software"))
    wrapped = licenses.SENTENCES["bsd-redistribution"][0].replace(" forms", "\nforms") + "\n" + licenses.SENTENCES["bsd-source"][0] + "\n" + licenses.SENTENCES["bsd-binary"][0]
    rows = [mit, wrapped, "Some text.\nLicensed under CC BY-NC 4.0.\nMore.", "He said licensed things.", None]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[k].licenses for k in range(5)] == ["MIT", "BSD-2-Clause", "CC-BY-NC-4.0", "", ""]
    assert rows[2][got[2].matches[0].start : got[2].matches[0].end] == "Licensed under CC BY-NC 4.0."
    for forms in licenses.SENTENCES.values():
        assert all(any(t in f.lower() for t in licenses.TRIGGERS) for f in forms)


def test_op6_finds_every_form(spark):
    """Plain, wrapped, under a title line, and as comments of several languages."""
    ways, rows = [("", 10_000), ("", 50), *[(m, 50) for m in ("# ", "// ", " * ", ";; ", "-- ", "% ", "dnl ", "REM ", "C ", "! ")]], []
    for name, forms in licenses.SENTENCES.items():
        for form in forms:
            for mark, width in ways:
                body = textwrap.wrap(form, width, break_long_words=False, break_on_hyphens=False)
                rows += [(name, "\n".join(mark + x for x in [*head, *body])) for head in ([], ["Copyright 2020 A. Author"], ["Copyright 2020 by the authors", ""])]
            rows.append((name, f"/* {form} */"))
            rows.append((name, f"<!-- {form} -->"))
    got = {r.doc_id: r.sentences.split(",") for r in licenses.scan(frame(spark, [t for _, t in rows])).collect()}
    assert [(t, got[k]) for k, (name, t) in enumerate(rows) if got[k] != [name] and got[k] != ["apache2-notice", "apache2-compliance"]] == []


def test_op6_runs_of_sentences(spark):
    form = {k: v[0] for k, v in licenses.SENTENCES.items()}
    rows = [form["gpl-or-later"] + "\n\n" + form["gpl-warranty"], form["gpl2-or-later"] + " " + form["gpl-warranty"], form["gpl2-or-later"], form["mpl2-notice"] + " If a copy was not distributed, see below."]
    rows += [form["gpl-or-later"].replace(": ", ":\n\n"), form["gpl-or-later"] + " A. B. C. " + form["gpl-warranty"], form["gpl-or-later"] + " A. B. C. D. " + form["gpl-warranty"]]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[k].licenses for k in range(len(rows))] == ["GPL-3.0-or-later", "GPL-2.0-or-later", "GPL-2.0-or-later", "MPL-2.0", "", "GPL-3.0-or-later", "GPL-3.0-or-later"]
    spans = [[rows[k][m.start : m.end] for m in got[k].matches] for k in range(len(rows))]
    assert spans[0] == [rows[0]] and spans[3] == [form["mpl2-notice"]]
    assert spans[5] == [rows[5]] and spans[6] == [form["gpl-or-later"]]


def test_op6_padding_and_gaps(spark):
    """White space inside a sentence does not hide it; lines without sentence ends count as sentences between two of a rule."""
    form = {k: v[0] for k, v in licenses.SENTENCES.items()}
    notice, copy = "Licensed under the Apache License, Version 2.0", form["apache2-copy"]
    filler = lambda n: "\n".join(f"line {k} without an end" for k in range(n))
    rows = [form["mit-grant"].replace(" ", " " * 60), form["mit-grant"].replace("copy", "copy" + " " * 50_000), f"{notice}.\n{filler(500)}\n{copy}", f"{notice}.\n{filler(3)}\n{copy}"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[k].licenses for k in (0, 1)] == ["MIT", "MIT"]
    assert [[(m.start, m.end) for m in got[k].matches] for k in (2, 3)] == [[(0, len(notice) + 1)], [(0, len(rows[3]))]]


# Written out by hand, apart from the library's tables: what the licence lines of the test tables are.
PLAIN_LINES = {
    "this work is licensed under the gnu general public license, version 3.": ("gpl3-notice", "GPL-3.0"),
    "licensed under the apache license, version 2.0.": ("apache2-notice", "Apache-2.0"),
    "released under the mit license.": ("mit-notice", "MIT"),
    "licensed under cc by-sa 4.0.": ("cc-by-sa", "CC-BY-SA-4.0"),
    "licensed under cc by-nc 4.0.": ("cc-by-nc", "CC-BY-NC-4.0"),
    "licensed under cc by 4.0.": ("cc-by", "CC-BY-4.0"),
    "all rights reserved.": ("rights-reserved", "all-rights-reserved"),
    "released under cc0 1.0.": ("cc0", "CC0-1.0"),
}


def test_op6_against_plain_lines(spark, texts):
    """Every column of the registered query on the small table, where a licence sentence is a line of its own."""
    got = {r.doc_id: r for r in queries.QUERIES["op6_license_scan"](spark, DATA).collect()}
    seen = 0
    for k, text in texts:
        want, at = [], 0
        for line in (text or "").split("\n"):
            bare = line.strip()
            if bare.lower() in PLAIN_LINES:
                want.append((*PLAIN_LINES[bare.lower()], at + line.index(bare), at + line.index(bare) + len(bare)))
            at += len(line) + 1
        r = got[k]
        assert (r.sentences, r.licenses, r.n_matches) == (",".join(w[0] for w in want), ",".join(sorted({w[1] for w in want})), len(want))
        assert [(m.license, m.start, m.end) for m in r.matches] == [w[1:] for w in want]
        seen += len(want)
    assert seen


def test_op7_held_out_and_fairness(duck):
    rows = duck.execute("select text, toxic, doc_id from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by doc_id").fetchall()
    fit = [r for r in rows if not toxicity.held_out(r[2])]
    m = toxicity.fit([r[0] for r in fit], [r[1] for r in fit])
    test = [(m.score(r[0]) >= 0.7, r[1]) for r in rows if toxicity.held_out(r[2])]
    assert sum(a and b for a, b in test) / sum(b for _, b in test) > 0.85
    assert sum(a and not b for a, b in test) / sum(not b for _, b in test) < 0.01
    assert m.pairs >= len(fit)
    plain = toxicity.fit([r[0] for r in fit], [r[1] for r in fit], fairness=0.0)
    terms = [t for g in toxicity.IDENTITY_GROUPS for t in g]
    change = lambda m: sum((m.score(f"{a} stand here") - m.score(f"{b} stand here")) ** 2 for g in toxicity.IDENTITY_GROUPS for a in g for b in g)
    assert change(m) <= change(plain) and all(m.score(f"the {t} of this town") < 0.7 for t in terms)


def test_op7_neutral_mentions():
    """Where toxic texts name a group and clean ones do not, swaps take the group's weight and false positives with it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("bcdfgklmnprst", k=5))
    insults = [word() for _ in range(40)]
    x = [f"{rng.choice(['muslims', 'women'])} {word()} {rng.choice(insults)} {word()}" for _ in range(150)] + [f"{word()} {word()} {word()} {word()}" for _ in range(150)]
    y = [1] * 150 + [0] * 150
    neutral = [f"{t} {word()} {word()}" for t in ("muslims", "women") for _ in range(50)]
    wrong = {f: sum((m := toxicity.fit(x, y, fairness=f)).score(t) >= 0.7 for t in neutral) for f in (0.0, 1.0)}
    assert m.pairs > 300 and wrong[0.0] > 50 and wrong[1.0] < wrong[0.0] / 5


def test_op7_slots_without_terms():
    """No labelled text holds a term, yet a beginning that a term shares with a toxic word loses weight on the term."""
    x = ["muslix here", "muslox there", "muslax now", "people here", "person there", "gente now"] * 30
    y = [1, 1, 1, 0, 0, 0] * 30
    free, fair = (toxicity.fit(x, y, fairness=f) for f in (0.0, 1.0))
    assert fair.pairs >= 180 and fair.score("muslims here") < free.score("muslims here")
    assert toxicity.fit(["a"], [0]).score(None) < 0.7


def test_op7_tables(spark):
    """An empty table, clashing names, null and repeated ids, ids labelled twice."""
    docs = spark.createDataFrame([], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int, text string")
    m = toxicity.train(docs, labels)
    assert toxicity.score_all(docs, m).count() == 0
    rows = [(k, f"bad{'x' * (k % 3)} thing" if k % 2 else "good thing", 7, 0.5) for k in range(60)] + [(None, "bad thing", 7, 0.5), (4, None, 7, 0.5), (4, "", 7, 0.5)]
    docs = spark.createDataFrame(rows, docs.schema)
    labels = spark.createDataFrame([(k, k % 2, "clash") for k in range(60)] + [(5, 0, "x"), (None, 1, "x"), (6, None, "x")], labels.schema)
    m = toxicity.train(docs, labels)
    got = toxicity.score_all(docs, m).collect()
    assert len(got) == 63 and all(r.predicted == (r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert all(r.held_out == toxicity.held_out(r.doc_id) for r in got if r.doc_id is not None)
    assert min(r.score for r in got if r.doc_id is not None and r.doc_id % 2) > max(r.score for r in got if r.doc_id is not None and r.doc_id % 2 == 0)


def test_op7_odd_rows(spark):
    m = toxicity.Model({"bad$": 9.0}, -4.0)
    got = toxicity.score_all(frame(spark, ODD + ["a bad one"]), m).collect()
    assert len(got) == len(ODD) + 1 and [r.predicted for r in got] == [0] * len(ODD) + [1]


def test_gsaca():
    rng = random.Random(4)
    many = [bytes(rng.randrange(97, 97 + a) for _ in range(n)) for n in (0, 1, 2, 7, 40) for a in (1, 2, 26) for _ in range(20)]
    want = [sorted(range(len(t)), key=lambda i, t=t: t[i:]) for t in many]
    assert [gsaca.suffix_array(t) for t in many] == want
    starts, base = gsaca.suffix_arrays(many)
    assert [(starts[b + 1 : b + 1 + len(t)] - b).tolist() for t, b in zip(many, base)] == want


@pytest.mark.parametrize("most, levels", [(1, 0), (1, 2), (3, 4), (1000, 4)])
def test_op8_brute_force(spark, texts, most, levels, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=450))
    made = ["".join(rng.choices("abcdefgh ", k=rng.randrange(0, 700))) for _ in range(25)]
    made += [m[:90] + passage[k : k + 205 + k] + m[90:] for k, m in enumerate(made[:20])] + [passage * 2, "z" * 900, "ab" * 350, "é" * 150, None, "", made[3], made[3]]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, made), most=most).collect()}
    want = suffix_dedup.removed_by_brute_force([(t or "").encode() for t in made])
    assert [(got[k].n_removed, got[k].n_spans, hashlib.sha256(bytes(got[k].kept)).hexdigest()) for k in range(len(made))] == want


def test_op8_table(spark, docs, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op8_suffix_array_dedup"](spark, DATA).collect()}
    want = suffix_dedup.removed_by_brute_force([(t or "").encode() for _, t in texts])
    assert [(got[k].n_removed, got[k].n_spans, got[k].kept_sha256) for k, _ in texts] == want


def test_op8_repeated_and_null_ids(spark):
    """Every row is a text of its own, with or without an id; ids come back as they were given."""
    rng = random.Random(16)
    passage, other = ("".join(rng.choices("abcdefgh ", k=n)) for n in (260, 300))
    plain = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(4)]
    rows = [(1, plain[0] + passage), (1, plain[1]), (None, passage + plain[2]), (None, other), (None, other), (2, plain[3]), (2, plain[3]), (None, None), (None, "z" * 250)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = suffix_dedup.removed_by_brute_force([(t or "").encode() for _, t in rows])
    digest = lambda r: hashlib.sha256(bytes(r.kept)).hexdigest()
    assert sorted(((r.doc_id, r.n_removed, r.n_spans, digest(r)) for r in got), key=repr) == sorted(((k, *w) for (k, _), w in zip(rows, want)), key=repr)


def test_op9_reversible(spark, tmp_path):
    rows = ["a long enough line\nonly here", "A LONG enough line  \nx", "a long enough line\nshared between two", "Shared between two"]
    state = lambda i: sorted(map(tuple, i.counts.select("h1", "h2", "n_docs", "min_doc", "max_doc").collect()))
    one = lines.LineIndex(spark)
    one.insert(frame(spark, rows))
    two = lines.LineIndex(spark, str(tmp_path / "index"))
    two.insert(frame(spark, rows[:2]))
    two.insert(frame(spark, rows[2:], 2))
    assert state(one) == state(two)
    two = lines.LineIndex(spark, str(tmp_path / "index"))
    two.insert(frame(spark, rows[:3]))  # rows the index has already do not count again
    assert state(one) == state(two)
    assert sorted(map(tuple, one.clean(frame(spark, rows)).collect())) == sorted(map(tuple, two.clean(frame(spark, rows)).collect()))
    two.delete(frame(spark, rows[2:], 2).select("doc_id"))
    less = lines.LineIndex(spark)
    less.insert(frame(spark, rows[:2]))
    assert state(two) == state(less)
    assert {r.doc_id: r.n_dropped for r in two.clean(frame(spark, rows[:2])).collect()} == {0: 0, 1: 1}
    two = lines.LineIndex(spark, str(tmp_path / "index"))
    two.delete(frame(spark, rows[:1]).select("doc_id"))
    assert {r.doc_id: r.n_dropped for r in two.clean(frame(spark, rows[1:2], 1)).collect()} == {1: 0}
    two.insert(frame(spark, rows[:1]))  # a deleted document can come again
    assert state(two) == state(less)
    with pytest.raises(ValueError):
        lines.LineIndex(spark, str(tmp_path / "index"), min_chars=5)


def test_op9_repeated_and_null_ids(spark):
    """One document under a repeated id; rows without an id come last, equal ones as one document."""
    i = lines.LineIndex(spark)
    rows = [(1, "only in one document"), (1, "only in one document"), (2, "found in two of them"), (None, "found in two of them\nb"), (None, "only without an id"), (None, "only without an id")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    i.insert(made)
    assert sorted(r.n_docs for r in i.counts.collect()) == [1, 1, 2]
    got = sorted(map(tuple, i.clean(made).collect()), key=repr)
    assert got == sorted([(1, 1, 0, "only in one document")] * 2 + [(2, 1, 0, "found in two of them"), (None, 2, 1, "b")] + [(None, 1, 0, "only without an id")] * 2, key=repr)


def test_op9_shards_grow(spark):
    """Shards double with the keys, and filters of all sizes let every repeated line through to the counts."""
    text = lambda a, b: "\n".join(f"line number {k} of the test" for k in range(a, b))
    i = lines.LineIndex(spark, shard_keys=20)
    seen = []
    for k, n in enumerate((10, 60, 200)):
        i.insert(frame(spark, [text(0, n), text(0, n) + "\nown line of the second"], 2 * k))
        seen.append(i.shards)
        got = {r.doc_id: (r.n_dropped, r.text) for r in i.clean(frame(spark, [text(0, n), text(0, n) + "\nown line of the second"], 2 * k)).collect()}
        assert got[2 * k + 1] == (n + (k > 0), "" if k else "own line of the second")
    assert seen[0] < seen[1] < seen[2] and i.filters.count() == i.shards


def test_op9_cuckoo():
    h = np.random.default_rng(7).integers(0, 2**63, 20_000).astype(np.uint64)
    c = lines.Cuckoo.of(h)
    assert c.contains(h).all() and lines.Cuckoo.load(c.dump()).contains(h).all()
    assert c.contains(np.arange(20_000, dtype=np.uint64) << np.uint64(33)).mean() < 0.01
    c.delete(h[:5000])
    assert c.contains(h[5000:]).all() and c.contains(h[:5000]).mean() < 0.05


def plain_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    sh = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("threshold", [1, 3, 4, 7])
def test_op10_links(spark, threshold):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6, 8])):
            x ^= 1 << b
        prints.append(x)
    prints += [(prints[0] & ~0xFFFF) | k for k in range(1400)]  # a hot segment, over one block
    prints = sorted(set(prints))
    label = list(range(len(prints)))
    a = np.array(prints, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= threshold, 1))
    want = common.forest(len(a), i, j)
    signed = a.view(np.int64).tolist()
    groups, _ = common.table(spark.createDataFrame([(k, signed[k]) for k in label], "rep long, fp long"), "test-groups")
    got = {r.node: r.component for r in graph.connected_components(simhash.link_forest(groups, threshold)).collect()}
    assert [got.get(k, k) for k in label] == want.tolist()


def test_op10_fingerprints(spark, texts):
    rows = ODD + [t for _, t in texts[:40]]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(frame(spark, rows)).collect()}
    assert [got[k] & (2**64 - 1) for k in range(len(rows))] == [plain_fingerprint(t) for t in rows]


def test_pipeline_copies_of_repeated_ids(spark):
    """A clean text stays where another text under its doc_id is a copy."""
    import corpus_pipeline as cp

    rows = [(1, "copied"), (1, "clean"), (2, "Copied"), (3, None), (4, ""), (None, "copied"), (2, "Copied"), (5, "clean too")]
    left = cp.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(1, "clean"), (2, "Copied"), (2, "Copied"), (4, ""), (None, "copied"), (5, "clean too")], key=repr)


def test_pipeline_stages(spark, docs, texts):
    """Each stage against a plain version over its own input."""
    import corpus_pipeline as cp

    cur = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        nxt, _ = common.table(stage(spark, cur, DATA), "test-stage")
        assert nxt.columns == docs.columns
        seen.append(({r.doc_id: r.text for r in cur.collect()}, {r.doc_id: r.text for r in nxt.collect()}))
        cur = nxt
    m = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(seen[0][1]) == {k for k, t in seen[0][0].items() if m.score(t) < m.threshold}
    best: dict = {}
    for k, t in seen[1][0].items():
        key = re.sub("[A-Z]", lambda c: c[0].lower(), t or "")
        best[key] = max(best.get(key, k), k)
    assert set(seen[1][1]) == set(best.values())
    ids = sorted(seen[2][0])
    a = np.array([plain_fingerprint(seen[2][0][k]) for k in ids], np.uint64)
    root = common.forest(len(a), *np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, 1)))
    assert set(seen[2][1]) == {ids[k] for k in set(root.tolist())}
    ids = sorted(seen[3][0])
    want = suffix_dedup.removed_by_brute_force([(seen[3][0][k] or "").encode() for k in ids])
    assert [len((seen[3][0][k] or "").encode()) - n == len((seen[3][1][k] or "").encode()) or "�" in seen[3][1][k] for k, (n, _, _) in zip(ids, want)] == [True] * len(ids)
    assert all(seen[3][0][k] == seen[3][1][k] for k, (n, _, _) in zip(ids, want) if n == 0)
    packed = cp.STAGES[-1][1](spark, cur, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(seen[3][1])
