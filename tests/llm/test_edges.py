"""Edges of the llm operators: ids near the ends of a long, rows without an id, extreme numbers, odd letters, bounds."""

import random

import numpy as np
import pytest

from codelode.llm import embeddings, packing, simhash, suffix_dedup, toxicity

tok = pytest.importorskip("public_tokenizers")
TOP = 1 << 62


def test_op1_ids_of_any_size(spark):
    """Components and kept rows go by ids, whatever their size; rows without an id link others and are never kept."""
    rows = [(TOP + 1, [1.0, 0.0]), (TOP + 2, [2.0, 0.1]), (-5, [0.0, 1.0]), (TOP * 2 - 1, [0.0, 3.0]), (-TOP * 2, [-1.0, 0.0]), (None, [-1.0, 0.1]), (None, [-3.0, -3.0])]
    got = sorted((tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    want = [(TOP + 1, 1, TOP + 1, True), (TOP + 2, 1, TOP + 1, False), (-5, 1, -5, True), (TOP * 2 - 1, 1, -5, False), (-TOP * 2, 1, -TOP * 2, True), (None, 1, -TOP * 2, False), (None, 0, None, False)]
    assert got == sorted(want, key=repr)


def test_op1_extreme_vectors(spark):
    """Vectors whose squares overflow or vanish link as their directions do."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    x[30:] = x[:30] + rng.normal(size=(30, 6)) * 0.2
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(norm, norm) >= 0.9
    np.fill_diagonal(near, False)
    scale = np.array([1e300, 1e-300, 1.0, 1e200, 1e-160])[np.arange(60) % 5]
    rows = [(k, (x[k] * scale[k]).tolist()) for k in range(60)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k] for k in range(60)] == near.sum(axis=1).tolist() and near.any()


def test_op3_letters_before_a_point():
    """Every letter, alone and at the end of a word, before a point and a comma, as the library has it."""
    from tokenizers import Tokenizer

    path = tok.path("word_bpe_49k.json")
    mine, lib = packing.WordTokenizer(path, 1 << 30), Tokenizer.from_file(path)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    texts = [w + x for c in letters for w in (c, "a" + c) for x in ".,"] + [c + "x" + c + "y." for c in letters if not mine._stays_letter(c)]
    for k in range(0, len(texts), 20_000):
        part = texts[k : k + 20_000]
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(part)] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
    assert not mine._stays_letter("İ") and mine._stays_letter("é")


def test_op10_rows_without_an_id(spark):
    """Documents joined only through a row without an id, or only through an id that repeats, are one component."""
    fp = lambda *bits: sum(1 << b for b in bits)
    base, chain = fp(1, 9, 17, 33), [fp(1, 9, 17, 33), fp(1, 9, 17, 33, 2, 3, 4, 5), fp(1, 9, 17, 33, 2, 3, 4, 5, 6, 7, 8, 10)]
    far = [fp(*range(30, 60)), fp(*range(11, 28))]
    rows = [(40, chain[0]), (None, chain[1]), (50, chain[2]), (None, far[0]), (7, far[1]), (7, far[0] ^ fp(0, 20, 21, 22, 23, 61)), (8, far[0] ^ fp(0, 20, 21, 22, 23, 61) ^ 4), (None, fp(60, 61, 62, 50, 40))]
    prints = spark.createDataFrame([(i, p) for i, p in rows], "doc_id long, fp long")
    whole = simhash.fingerprints
    try:
        simhash.fingerprints = lambda docs: docs
        got = sorted((tuple(r) for r in simhash.near_duplicates(prints).collect()), key=repr)
    finally:
        simhash.fingerprints = whole
    count = lambda a, b: bin(a ^ b).count("1")
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if count(rows[a][1], rows[b][1]) <= 4 or rows[a][0] == rows[b][0] is not None:
                    label[a] = label[b] = min(label[a], label[b])
    ids = {n: min((rows[k][0] for k in range(len(rows)) if label[k] == n and rows[k][0] is not None), default=None) for n in label}
    assert base == chain[0] and got == sorted(((i, p, ids[label[k]]) for k, (i, p) in enumerate(rows)), key=repr)
    assert (50, chain[2], 40) in got


def test_op7_takes_one_text_an_id_and_bounded_words(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = [(k, " ".join(word() for _ in range(20)) + (" vile" if k % 2 else "")) for k in range(90)] + [(0, f"other text {k}") for k in range(500)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id long, toxic int")
    taken = []
    plain = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda words, y, **o: (taken.append([list(w) for w in words]), plain(taken[-1], y, **o))[1])
    m = toxicity.train(docs, labels)
    assert len(taken[0]) == sum(not toxicity.held_out(k) for k in range(90)) and m.score("vile") > m.score("mild")
    toxicity.train(docs, labels, max_words=200)
    assert 5 < len(taken[1]) < len(taken[0]) and sum(map(len, taken[1])) <= 200
    assert all(x in taken[0] for x in taken[1])


def test_op8_texts_over_a_block(monkeypatch):
    """Regions of a text hashed in many blocks choose for every window the hash they choose in one."""
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 100, 5000, np.uint8)) + b"ab" * 700 + bytes(rng.integers(97, 123, 3000, np.uint8))
    choice = lambda: {w: (h, t) for b, e, h, t in zip(*(x.tolist() for x in suffix_dedup.regions(text))) for w in range(b, e)}
    whole = choice()
    assert sorted(whole) == list(range(len(text) - suffix_dedup.LENGTH + 1))
    for block in (300, 1024, 2999):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        cut = choice()
        assert {w: h for w, (h, _) in cut.items()} == {w: h for w, (h, _) in whole.items()}


def test_op10_texts_over_a_chunk(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["one", "two", "Three", "four", "é"]) for _ in range(1000)).encode()
    whole = simhash.fingerprint(text)
    for chunk in (1, 7, 996, 997, 998):
        monkeypatch.setattr(simhash, "_CHUNK", chunk)
        assert simhash.fingerprint(text) == whole


def test_op3_groups_of_texts(monkeypatch):
    """However texts are put into groups, each keeps its ids."""
    path = tok.path("word_bpe_49k.json")
    texts = ["one two. three", "", "x" * 50, "İ. qué", "a b c " * 30, "\n", "one two. three"]
    whole = packing.WordTokenizer(path).encode(texts)
    for group, chars in ((1, 1), (2, 1 << 20), (512, 20)):
        monkeypatch.setattr(packing, "GROUP", group)
        monkeypatch.setattr(packing, "GROUP_CHARS", chars)
        few = packing.WordTokenizer(path, 3)
        assert [ids for part in packing.parcels(texts) for ids in few.encode(part)] == whole


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, digest binary, component_id string, carried int"


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_odd_tables(spark, empty):
    """Stages over an empty table, and over null ids, null texts and columns whose names the operators use."""
    import corpus_pipeline as cp
    from conftest import DATA

    twin = " ".join(f"word{k}" for k in range(60))
    rows = [(1, twin), (2, twin.upper()), (None, twin), (None, None), (3, None), (4, ""), (5, twin + " more"), (6, "something else entirely, and short"), (6, "x " * 400)]
    docs = spark.createDataFrame([] if empty else [(i, t, "en", "s", len(t or ""), 1, b"d", "c", 2) for i, t in rows], COLUMNS)
    left = docs
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, left, DATA)
        assert left.dtypes == docs.dtypes, name
        left, _ = cp.table(left, "odd")
    got = [(r.doc_id, r.text, r.component_id) for r in left.collect()]
    packed = cp.pack(spark, left, DATA)
    assert {r.doc_id for r in packed.collect()} == {i for i, _, _ in got}
    if empty:
        assert not got
    else:
        ids = [i for i, _, _ in got]
        # rows without an id pass the stages that name documents; of equal texts the largest id stays
        assert ids.count(None) == 2 and not {1, 3} & set(ids) and ids.count(6) == 2 and {2, 4} <= set(ids)
        assert all(c == "c" for _, _, c in got) and sum(r.n_chars for r in left.collect()) == sum(len(t or "") for _, t, _ in got)
