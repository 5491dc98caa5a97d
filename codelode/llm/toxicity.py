"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their beginnings (3 to 8 letters), which also catch unseen
inflections; a feature's value is log2(1 + distinct words that have it). Training minimises logistic loss + an L1 term + a penalty on the squared change of the score when
an identity term of a labelled text is swapped for another of its group or for the group's neutral word, so that
a neutral mention of a group carries no weight of its own. In a labelled text without identity terms the terms of
one group take the same slot in turn (groups go round over the texts). The model is fitted on the driver on at most about ``max_rows`` labelled rows
chosen by a hash of doc_id (a documented bound); scoring is one narrow pass over all texts.
"""

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import give_back, slices, table

MAX_ROWS = 6_000
MAX_WORDS = 6_000_000  # distinct words by text that the driver takes from the labelled texts, all together
MAX_FEATURES = 20_000
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
# Identity terms by group, in four languages. The last of a group is its neutral word, which is swapped
# in for the others but never out.
IDENTITY_GROUPS = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("girl", "boy", "child"), ("female", "male", "human"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "adult"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "local"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "local"),
    ("immigrant", "native", "refugee", "neighbour"), ("immigrants", "natives", "refugees", "neighbours"),
    ("old", "young", "other"), ("deaf", "blind", "disabled", "other"),
    ("femmes", "hommes", "gens"), ("musulmans", "chrétiens", "juifs", "gens"), ("noirs", "blancs", "arabes", "gens"), ("immigrés", "réfugiés", "voisins"),
    ("frauen", "männer", "leute"), ("muslime", "christen", "juden", "leute"), ("türken", "araber", "deutsche", "leute"), ("einwanderer", "flüchtlinge", "nachbarn"),
    ("mujeres", "hombres", "gente"), ("musulmanes", "cristianos", "judíos", "gente"), ("negros", "blancos", "árabes", "gente"), ("inmigrantes", "refugiados", "vecinos"),
)
GROUP_OF = {term: group for group in IDENTITY_GROUPS for term in group[:-1]}
_WORD_CACHE = 50_000
LOG = np.log2(1 + np.arange(1 << 14)).tolist()


def features_of(word: str) -> list[str]:
    """The features of one lower-cased word: itself and its proper beginnings."""
    return [word + "$"] + [word[:n] for n in PREFIXES if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    threshold: float = THRESHOLD
    pairs: int = 0  # counterfactual pairs that the fit has penalised

    def logit(self, words: set[str]) -> float:
        found = Counter(f for w in words for f in features_of(w) if f in self.weights)
        return self.bias + sum(self.weights[f] * LOG[min(found[f], len(LOG) - 1)] for f in sorted(found))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -500, 500))))


def fit(texts: Iterable[str | Iterable[str] | None], y: list[int], fairness: float = 1.0, sparsity: float = 4e-4, max_features: int = MAX_FEATURES, steps: int = 600) -> Model:
    """Accelerated proximal gradient over texts or their distinct words. Without both classes the score is the share of label 1."""
    share = (sum(y) + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(set(y)) < 2:
        return Model({}, prior)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words_of(t) if t is None or isinstance(t, str) else t)], np.int32) for t in texts]
    for term in (t for group in IDENTITY_GROUPS for t in group):
        vocabulary.setdefault(term, len(vocabulary))
    features: dict[str, int] = {}
    of_word = np.full((len(vocabulary), 1 + len(PREFIXES)), -1, np.int32)
    for w, i in vocabulary.items():
        for k, f in enumerate(features_of(w)):
            of_word[i, k] = features.setdefault(f, len(features))
    seen = np.zeros((2, len(features)))
    for d, label in zip(docs, y, strict=True):
        own = np.unique(of_word[d])
        seen[label, own[own >= 0]] += 1
    pos, n = sum(y), len(y)
    # two-sided z of a feature's share among label 1 against label 0 picks the features
    p = seen.sum(axis=0) / n
    z = np.abs(seen[1] / pos - seen[0] / (n - pos)) / np.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)) + 1e-12)
    common = np.flatnonzero(seen.sum(axis=0) >= 3)
    kept = np.sort(common[np.lexsort((common, -z[common]))][:max_features])
    at = np.full(len(features), -1, np.int64)
    at[kept] = np.arange(kept.size)
    names = [f for f, i in features.items() if at[i] >= 0]
    logs = np.array(LOG)

    def own(word: int) -> set[int]:
        return {int(k) for k in at[of_word[word][of_word[word] >= 0]] if k >= 0}

    term_features = {vocabulary[t]: own(vocabulary[t]) for group in IDENTITY_GROUPS for t in group}
    groups = [[vocabulary[t] for t in group] for group in IDENTITY_GROUPS]
    group_of = {vocabulary[t]: [vocabulary[x] for x in group] for t, group in GROUP_OF.items()}
    # arrays, as lists of numbers take several times as much
    cols, vals, size_of, change_of, change_cols, change_vals, pairs = [], [], [], array("q"), array("q"), array("d"), 0
    for k, d in enumerate(docs):
        found = of_word[d].ravel()
        found = at[found[found >= 0]]
        u, c = np.unique(found[found >= 0], return_counts=True)
        cols.append(u.astype(np.int32))
        vals.append(np.minimum(c, len(LOG) - 1).astype(np.int32))
        size_of.append(u.size)
        count, words = dict(zip(u.tolist(), c.tolist())), set(d.tolist())
        named = sorted(words & group_of.keys())
        if named:
            swaps = [(i, j, True) for i in named for j in group_of[i] if j not in words]
        else:
            slot = groups[k % len(groups)]
            swaps = [(i, j, False) for i, j in zip(slot, slot[1:] + slot[:1])]
        for i, j, there in swaps:
            # a has the term i (which the text holds, or else is put into it), b has j in its place
            out, into = (term_features[i] if there or i not in words else set()), (term_features[j] if j not in words else set())
            for f in sorted(out ^ into):
                n_a = count.get(f, 0) + (not there and f in out)
                n_b = count.get(f, 0) - (there and f in out) + (f in into)
                if n_a != n_b:
                    change_of.append(pairs)
                    change_cols.append(f)
                    change_vals.append(LOG[min(n_a, len(LOG) - 1)] - LOG[min(n_b, len(LOG) - 1)])
            pairs += 1
    del docs, vocabulary, features, of_word, seen, at
    give_back()
    cols, vals, of = np.concatenate(cols).astype(np.int64), logs[np.concatenate(vals)], np.repeat(np.arange(n), size_of)
    dof, dcol, dval = np.frombuffer(change_of, np.int64), np.frombuffer(change_cols, np.int64), np.frombuffer(change_vals)
    label = np.array(y, np.float64)
    size = len(names)
    # Lipschitz bound by power iteration on the quadratic form of both terms
    v = np.ones(size) / np.sqrt(size or 1)
    top = 1.0
    for _ in range(12):
        z = np.bincount(of, vals * v[cols], n)
        u = np.bincount(cols, vals * z[of], size) / (4 * n)
        if pairs:
            u += 2 * fairness / pairs * np.bincount(dcol, dval * np.bincount(dof, dval * v[dcol], pairs)[dof], size)
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    step = 1 / (1.1 * top + 0.25)
    w, bias, free = np.zeros(size), prior, np.ones(size, bool)
    for shrink in (sparsity, sparsity / 10):  # choose features, then fit the chosen ones with less shrinkage
        look, look_bias, t = w, bias, 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(np.bincount(of, vals * look[cols], n) + look_bias)))
            grad = np.bincount(cols, vals * (p - label)[of], size) / n
            if pairs:
                grad += 2 * fairness / pairs * np.bincount(dcol, dval * np.bincount(dof, dval * look[dcol], pairs)[dof], size)
            moved = np.where(free, look - step * grad, 0)
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
            new_bias = look_bias - step * float((p - label).mean())
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            k = (t - 1) / t_new
            look, look_bias = new + k * (new - w), new_bias + k * (new_bias - bias)
            w, bias, t = new, new_bias, t_new
        free = w != 0
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(bias), pairs=pairs)


def fold(doc_id):
    """crc32 of doc_id as text, modulo 3; rows with 1 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, **options) -> Model:
    """Fit on labelled rows outside the held-out fold, at most about max_rows of them and max_words distinct words by text.

    Rows without a label, id or text column value follow these rules: a null label or id is skipped, a null text
    is empty, an id labelled twice counts as toxic if any label says so, an id with several texts stands for the one
    with the smallest hash. Labelled ids are taken in the order of a hash until either bound is reached; what comes to the
    driver are words, not texts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id") != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def split(batches):
        for b in slices(batches, 200):
            words = pa.array([sorted(words_of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), words], ["doc_id", "toxic", "words"])

    stored, _ = table(one.mapInArrow(split, "doc_id long, toxic int, words array<string>"), "labelled-words")
    left, taken = max_words, []
    for r in stored.select("doc_id", F.size("words").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # about max_rows rows
        left -= r.n
        if left < 0:
            break
        taken.append((r.doc_id,))
    if left < 0:
        stored = stored.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id")
    got = stored.select("doc_id", "toxic", "words").toArrow().sort_by("doc_id")
    words, y = got.column("words"), [int(t > 0) for t in got.column("toxic").to_pylist()]
    del got
    model = fit((w.as_py() for w in words), y, **options) if y else Model()
    del words
    give_back()
    return model


def scorer(docs: DataFrame, model: Model):
    """An Arrow UDF of a text column giving the score; the model's size is bounded by max_features."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = share.value
        weights = m.weights
        known: dict[str, tuple[str, ...]] = {}  # features with weight of the words met, for one task only
        for texts in parts:
            z = np.empty(len(texts))
            for i, text in enumerate(texts):
                found: Counter = Counter()
                for w in words_of(text.as_py()):
                    hit = known.get(w)
                    if hit is None:
                        hit = tuple(f for f in features_of(w) if f in weights)
                        if len(known) < _WORD_CACHE:
                            known[w] = hit
                    if hit:
                        found.update(hit)
                z[i] = m.bias + sum(weights[f] * LOG[min(found[f], len(LOG) - 1)] for f in sorted(found))
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            pa.default_memory_pool().release_unused()

    return score


def score_all(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and empty texts get the score of the bias. A null doc_id is held out: false. Repeated rows are scored
    alike; other columns are not read; an empty table gives an empty result.
    """
    score = scorer(docs, model)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_all(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def held_out(doc_id: int) -> bool:
    """The fold rule in Python, for tests and evaluation."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
