"""Full-text search over trigrams, and symbol probes."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import paths, text


def postings(files: DataFrame) -> DataFrame:
    """(gram, file_id): the distinct trigrams of path and content. Write it bucketed by gram to search many times."""
    grams = F.array_union(text.trigrams(F.col("path")), text.trigrams(F.col("content")))
    return files.select(F.col("id").alias("file_id"), F.explode(grams).alias("gram"))


BLOCK = 1 << 22  # characters of texts whose trigrams are sorted together, about


def posting_lists(files: DataFrame) -> DataFrame:
    """(gram, file_ids): the postings as lists, a row for each trigram of a block of files that are read together.

    Lists are made where the texts are read, so a posting is one number in a list and no row of its own.
    """

    def run(batches):
        for b in batches:
            ids, paths, texts = b["id"].to_numpy(), b["path"].to_pylist(), b["content"].to_pylist()
            sizes = np.cumsum([len(x) + len(y) for x, y in zip(paths, texts)])
            ends = [*np.flatnonzero(np.diff(sizes // BLOCK)) + 1, len(ids)]
            for at, end in zip([0, *ends], ends):
                yield from _lists(ids[at:end], paths[at:end], texts[at:end])

    low = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("path", "content")]
    return files.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), *low).mapInArrow(run, "gram string, file_ids array<long>")


def _lists(ids: np.ndarray, *columns: list[str]):
    """Batches of (gram, file_ids) of files and the texts in columns, by sorting numbers that stand for a trigram and a file."""
    n, texts = len(ids), [t for c in columns for t in c]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    held = np.zeros(0x110000, bool)
    held[codes] = True
    signs, number = np.flatnonzero(held), np.cumsum(held) - 1
    a = len(signs)
    if n > 1 and a**3 * n >= 1 << 63:  # too many different characters for one number
        for k in (slice(None, n // 2), slice(n // 2, None)):
            yield from _lists(ids[k], *[c[k] for c in columns])
        return
    keys = [np.empty(0, np.int64)]
    for at in range(0, len(codes) - 2, BLOCK):  # long texts in parts
        c, t = number[codes[at : at + BLOCK + 2]], text[at : at + BLOCK + 2]
        keys.append(_distinct((((c[:-2] * a + c[1:-1]) * a + c[2:]) * n + t[:-2] % n)[t[:-2] == t[2:]]))
    key = _distinct(np.concatenate(keys))
    if not len(key):
        return
    gram, file = np.divmod(key, n)
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    g = gram[first]
    three = signs[np.stack([g // a // a, g // a % a, g % a], 1)].astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(ids[file]))
    yield pa.RecordBatch.from_arrays([pa.array([three[k : k + 3] for k in range(0, len(three), 3)]), lists], ["gram", "file_ids"])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def has_term(term: str) -> Column:
    """Case-insensitive substring of path or content; terms under three characters match nothing."""
    if len(term) < 3:
        return F.lit(False)
    low = F.lit(term.lower())
    return F.contains(F.lower("path"), low) | F.contains(F.lower("content"), low)


_TOKENS = re.compile(r'"(?:[^"]|"")*"?|[()]|[^\s"()]+')


def parse(query: str):
    """A term query as nested tuples: ("term", text), ("and" | "or", parts), ("not", wanted, unwanted); None if it is empty.

    Words and quoted phrases side by side must all match and hold together most; then NOT, AND, OR. Round brackets group.
    """
    todo = _TOKENS.findall(query)[::-1]

    def ahead(word: str) -> bool:
        return bool(todo) and todo[-1] == word

    def chain(name: str, word: str, part):
        parts = [part()]
        while ahead(word):
            todo.pop()
            parts.append(part())
        parts = [p for p in parts if p]
        return (name, parts) if len(parts) > 1 else parts[0] if parts else None

    def together():
        parts = []
        while todo and todo[-1] not in (")", "AND", "OR", "NOT"):
            t = todo.pop()
            if t == "(":
                parts.append(either())
                if ahead(")"):
                    todo.pop()
            else:
                parts.append(("term", t[1:].removesuffix('"').replace('""', '"') if t[0] == '"' else t.removesuffix("*")))
        parts = [p for p in parts if p]
        return ("and", parts) if len(parts) > 1 else parts[0] if parts else None

    def without():
        wanted = together()
        while ahead("NOT"):
            todo.pop()
            unwanted = together()
            wanted = ("not", wanted, unwanted) if wanted and unwanted else wanted
        return wanted

    def either():
        return chain("or", "OR", lambda: chain("and", "AND", without))

    found = either()
    while todo:  # a bracket or a word without its other half is passed over
        todo.pop()
        more = either()
        found = ("and", [found, more]) if found and more else found or more
    return found


def terms_of(tree) -> list[str]:
    """The distinct terms of a parsed query, in order."""
    if tree is None:
        return []
    parts = [tree[1]] if tree[0] == "term" else [t for p in (tree[1:] if tree[0] == "not" else tree[1]) for t in terms_of(p)]
    return list(dict.fromkeys(parts))


def decide(tree, term, maybe: bool = False) -> Column:
    """A parsed query as a condition, term giving that of a word; with maybe terms may err towards true, so NOT decides nothing."""
    if tree[0] == "term":
        return term(tree[1])
    if tree[0] == "not":
        wanted = decide(tree[1], term, maybe)
        return wanted if maybe else wanted & ~decide(tree[2], term)
    return reduce(lambda a, b: a & b if tree[0] == "and" else a | b, [decide(p, term, maybe) for p in tree[1]])


def grams_of(term: str) -> list[str]:
    return sorted({term.lower()[i : i + 3] for i in range(len(term) - 2)})


def match(files: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """Files that match a term query. With a postings index, candidates come from a semi-join on grams first."""
    wanted = parse(query)
    if wanted is None:
        return files.where(F.lit(False))
    if index is not None:
        files = files.join(candidates(index, wanted), files.id == F.col("file_id"), "left_semi")
    return files.where(decide(wanted, has_term))


def candidates(index: DataFrame, tree) -> DataFrame:
    """file_id of files whose grams allow a match: one pass over the postings of the query's grams."""
    words = [t for t in terms_of(tree) if len(t) > 2]
    grams = sorted({g for t in words for g in grams_of(t)})
    held = [F.count_if(F.col("gram").isin(grams_of(t))).alias(f"n{k}") for k, t in enumerate(words)]
    per = index.where(F.col("gram").isin(grams)).groupBy("file_id").agg(*held or [F.count("*").alias("n")])
    full = {t: F.col(f"n{k}") == len(grams_of(t)) for k, t in enumerate(words)}
    return per.where(decide(tree, lambda t: full.get(t, F.lit(False)), maybe=True)).select("file_id")


def bm25(files: DataFrame, tree, total: int, mean: float, among: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """files(id, path, content) that match a parsed query, with ``rank``: smaller (more negative) is better.

    A term's weight is ln((N - n + 0.5) / (n + 0.5)), 1e-6 at least, N being all files and n those among the given
    ones that hold it; files must therefore be all that hold any term of the query. Occurrences in path and content count,
    overlapping ones too; a file is as long as the trigrams of both, mean being the average. With among(file_id), only
    those files count. Files are compared and counted where they are read, so what meets among is counts, and texts of matches only.
    """
    words = [t for t in terms_of(tree) if len(t) > 2]
    found = lambda t, c: F.regexp_count(F.lower(c), F.lit("(?s)(?=" + re.escape(t.lower()) + ")"))
    size = F.greatest(F.length("path") - 2, F.lit(0)) + F.greatest(F.length("content") - 2, F.lit(0))
    some = files.where(reduce(lambda x, y: x | y, [has_term(t) for t in words], F.lit(False)))
    base = some.select("id", "path", "content", size.alias("_d"), *[(found(t, "path") + found(t, "content")).alias(f"_f{k}") for k, t in enumerate(words)])
    if among is not None:
        base = base.join(among, base.id == among.file_id, "left_semi")
    held = base.agg(*[F.count_if(F.col(f"_f{k}") > 0).alias(f"_n{k}") for k in range(len(words))] or [F.lit(0).alias("_n")])
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = F.greatest(F.log((F.lit(total) - F.col(f"_n{k}") + 0.5) / (F.col(f"_n{k}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"_f{k}") * (k1 + 1) / (F.col(f"_f{k}") + k1 * (1 - b + b * F.col("_d") / mean))
    return base.where(decide(tree, has_term)).crossJoin(F.broadcast(held)).select("id", "path", "content", (-score).alias("rank"))  # one row of counts


def rank(files: DataFrame, terms: list[str], limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best files by BM25 of term occurrences in content; rank is negative, smaller is better; ties by path."""
    low = F.lower("content")
    tf = [(F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t) for t in terms]
    base = files.select("id", "path", F.length("content").alias("len"), *[x.alias(f"tf{i}") for i, x in enumerate(tf)])
    stats = base.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = base.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(stats))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return joined.select("id", "path", F.round(-score, 6).alias("rank")).orderBy("rank", "path").limit(limit)


def symbols_like(symbols: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Symbols by case-insensitive LIKE, first by path and id."""
    return symbols.where(F.col("name").ilike(pattern)).orderBy("path", "id").limit(limit)


def symbols_named(symbols: DataFrame, name: str, kinds: list[str] | None = None, limit: int | None = 500) -> DataFrame:
    """Symbols of a name, the first limit by path and id; without a limit all, in no order."""
    rows = symbols.where(F.col("name") == name)
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    return rows if limit is None else rows.orderBy("path", "id").limit(limit)


def referenced_paths(statements: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): indexed paths a statement's literals name, in single or double quotes.

    Outer % and * are stripped; a literal that equals a path names that path alone, others every path they are in.
    Each distinct literal is searched once, among the paths that have its rarest trigram.
    """
    quoted = statements.select("id", F.explode(F.regexp_extract_all("sql_text", F.lit("['\"]([^'\"]+)['\"]"), 1)).alias("q"))
    lits = quoted.select("id", F.regexp_replace("q", "^[%*]+|[%*]+$", "").alias("core")).where("core <> ''")
    said = lits.groupBy("id").agg(F.array_sort(F.collect_set("core")).alias("lits"))
    each = said.select("lits").distinct().select("lits", F.explode("lits").alias("core"))
    cores, paths = each.select("core").distinct(), files.select("path").distinct()
    exact = cores.join(paths.withColumn("core", F.col("path")), "core")
    rest = cores.join(exact.select("core"), "core", "left_anti")
    # trigrams as written, as the search is case-sensitive
    grams = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), 1))).alias("gram")
    by_gram = paths.select("path", grams("path"))
    sizes = by_gram.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = rest.select("core", grams("core")).join(sizes, "gram", "left").groupBy("core").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    part = rarest.join(by_gram, "gram").where(F.contains("path", F.col("core")))
    short = rest.where(F.length("core") < 3).join(paths, F.contains("path", F.col("core")))
    named = exact.select("core", "path").unionByName(part.select("core", "path")).unionByName(short.select("core", "path"))
    found = each.join(named, "core").select("lits", "path").distinct()
    return join_in_tiles(said, found, "lits").select("id", "path")


RUN = 2048, 256  # rows of either side that are handled in a row, about


def join_in_tiles(left: DataFrame, right: DataFrame, key: str, rows: tuple[int, int] = (32768, 4096)) -> DataFrame:
    """An inner join whose keys have many rows on both sides: about rows of either side meet in a group.

    Rows travel in lists, each to as many groups as the other side of its key has, so larger groups send less. In a
    group the left passes one piece of the right after the other. So a row of the left is repeated for a piece, a piece comes again
    and again in one order, and a task sees few distinct rows: dictionaries, run lengths and page compression then write
    a result of many times the inputs in a fraction of a byte a row. Pieces hold a multiple of 8 rows, as Parquet packs 8 at a time
    and packed repeats only look alike when they begin at whole bytes.
    """
    run = [min(x, y) for x, y in zip(RUN, rows)]
    parts, pieces = (y // x for x, y in zip(run, rows))  # of a group: lists of the left, pieces of the right
    n = F.count("*")
    sizes = left.groupBy(key).agg(F.ceil(n / run[0]).alias("_m")).join(
        right.groupBy(key).agg(F.ceil(n / rows[1]).alias("_n"), F.least(F.lit(pieces).cast("long"), F.ceil(n / run[1])).alias("_p")), key)
    below = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    others = lambda df: [c for c in df.columns if c != key]
    lists = lambda df, c: df.join(sizes, key).groupBy(key, "_m", "_n", "_p", F.pmod(F.xxhash64(*others(df)), F.col(c)).alias("_i")).agg(F.collect_list(F.struct(*others(df))).alias("_l"))
    tasks = 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as groups must not be put together by their few bytes
    a = lists(left, "_m").select(key, F.floor(F.col("_i") / parts).alias("_a"), F.explode(below(F.col("_n"))).alias("_b"), "_p", "_l").repartition(tasks, key, "_a", "_b")
    size = (F.ceil(F.size("_l") / F.col("_p") / 8) * 8).cast("int")
    cut = F.transform(below(F.col("_p")), lambda k: F.slice("_l", k.cast("int") * size + 1, size))
    b = lists(right, "_n").select(key, F.col("_i").alias("_b"), cut.alias("_r"), F.explode(below(F.ceil(F.col("_m") / parts))).alias("_a")).repartition(tasks, key, "_a", "_b")
    a = a.select(key, "_a", "_b", "_l", F.explode(below(F.col("_p"))).alias("_k")).select(key, "_a", "_b", "_k", F.explode("_l").alias("_l"))
    met = a.join(b.hint("merge"), [key, "_a", "_b"])  # takes a row of the left at a time, with one piece
    return met.select(key, "_l", F.explode(F.get("_r", F.col("_k").cast("int"))).alias("_r")).select(key, "_l.*", "_r.*")


def staged_seeds(files: DataFrame, symbols: DataFrame, seed: str, limit: int = 25, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, path, stage): files of the first stage that finds any, the first limit of them.

    Stages: 1 the path or its end, shortest first; 2 the name of a symbol in it; 3 a part of a symbol's name, for
    seeds without LIKE signs; 4 path or text, in order of BM25. All stages are decided in one pass over either table.
    """
    want, path = paths.normalise(F.lit(seed)), paths.normalise(F.col("path"))
    low = F.lower(F.concat_ws("\n", "path", "content"))
    tf = (F.length(low) - F.length(F.replace(low, F.lit(seed.lower()), F.lit("")))) / max(1, len(seed))
    mean = files.agg(F.avg(F.length("content")).alias("mean"))
    score = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.length("content") / F.col("mean")))
    by_file = files.crossJoin(F.broadcast(mean))  # one row of totals
    stage = F.when((path == want) | F.endswith(path, F.concat(F.lit("/"), want)), 1).when(has_term(seed), 4)
    by_file = by_file.select("id", "path", stage.alias("stage"), F.when(stage == 4, -score).alias("rank"))
    fuzzy = F.lit(False) if any(c in seed for c in "%_") else F.col("name").ilike(f"%{seed}%")
    by_name = symbols.select(F.col("file_id").alias("id"), "path", F.when(F.col("name") == seed, 2).when(fuzzy, 3).alias("stage"), F.lit(None).cast("double").alias("rank"))
    found = by_file.unionByName(by_name).where("stage IS NOT NULL").groupBy("id", "path").agg(F.min_by("rank", "stage").alias("rank"), F.min("stage").alias("stage"))
    first = found.agg(F.min("stage").alias("stage"))
    best = found.join(F.broadcast(first), "stage")  # one row
    return best.orderBy("rank", F.when(F.col("stage") == 1, F.length("path")), "path", "id").limit(limit).select("id", "path", "stage")
