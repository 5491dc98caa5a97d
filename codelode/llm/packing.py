"""Best-fit packing planned over the length histogram, with documents joined to planned slots by rank within length.

The driver sees one count per length (at most ``capacity`` rows). Best-fit decreasing runs over those counts:
bins with the same room are one entry, and a whole run of equal pieces is placed at once. The plan is a list of
slot runs (length, first rank, last rank, first sequence, pieces per sequence, offset). Its size follows the
number of distinct lengths and rooms, not the number of documents.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import remove, slices, table

CAPACITY = 2048
GROUP, GROUP_CHARS = 512, 4 << 20  # texts encoded together, and their characters
CACHE = 200_000  # chunks in a generation of a worker's memory, about 40 MB
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of a word-level-split tokenizer file, remembered by white-space chunk.

    The file's normaliser folds white space and its pre-tokeniser never matches across it, so a text's ids are
    those of its chunks between spaces and newlines joined. A chunk of letters is one word to the pre-tokeniser,
    and a point or comma after it another, unless the normaliser turns the last letter into one with a mark. Unknown words are encoded together and told apart by their end
    tokens; other unknown chunks by the offsets the library reports. The memory has two generations, so it is
    bounded and keeps what is in use.
    """

    def __init__(self, path: str, cache: int = CACHE):
        # a task has one core; the library's threads would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the library takes special tokens out of a text before anything else; so does encode, hence they are text here
        self.tok.encode_special_tokens = True
        self.special = {x.content: np.asarray([i], "<u4").tobytes() for i, x in self.tok.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # for words of letters up to U+00FF the file's normaliser and splitting come down to these
        self.light = Tokenizer.from_file(path)
        self.light.encode_special_tokens = True
        self.light.normalizer = normalizers.Lowercase()
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_of])
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache = cache
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.letters: dict[str, bool] = {}

    def _words(self, words: list[str], tok) -> None:
        """Learn chunks of letters only."""
        lines = [words[i : i + 256] for i in range(0, len(words), 256)]
        for line, enc in zip(lines, tok.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.asarray(enc.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if cuts.size != len(line):
                self._chunks(line)
                continue
            raw, at = ids.tobytes(), 0
            for c, end in zip(line, (4 * cuts).tolist(), strict=True):
                self.known[c] = raw[at:end]
                at = end

    def _chunks(self, chunks: list[str]) -> None:
        """Learn any chunks."""
        lines = [chunks[i : i + 256] for i in range(0, len(chunks), 256)]
        for line, enc in zip(lines, self.tok.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            raw = np.asarray(enc.ids, dtype="<u4").tobytes()
            starts = np.asarray([o[0] for o in enc.offsets], dtype=np.int64)
            cuts = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in line]))
            at = 0
            for c, end in zip(line, (4 * cuts).tolist(), strict=True):
                self.known[c] = raw[at:end]
                at = end

    def _stays_letter(self, letter: str) -> bool:
        """Whether a letter's normal form ends in a letter; a mark there is one word with a point that follows."""
        if letter < "\u0100":
            return True
        known = self.letters.get(letter)
        if known is None:
            known = self.letters[letter] = unicodedata.category(self.tok.normalizer.normalize_str(letter)[-1])[0] == "L"
        return known

    def _learn(self, chunks: set[str]) -> None:
        known, old = self.known, self.old
        words, tailed, odd = set(), [], []
        for c in chunks:
            have = old.get(c)
            if have is not None:
                known[c] = have
            elif c.isalpha():
                words.add(c)
            elif c[-1] in ".," and c[:-1].isalpha() and self._stays_letter(c[-2]):
                tailed.append(c)
            else:
                odd.append(c)
        for c in tailed:
            word = c[:-1]
            if word not in known:
                have = old.get(word)
                if have is None:
                    words.add(word)
                else:
                    known[word] = have
        plain = [c for c in words if c.isascii() or max(c) < "\u0100"]
        self._words(plain, self.light)
        self._words(list(words.difference(plain)), self.tok)
        self._chunks([*odd, *(c for c in ".," if c not in known)])
        for c in tailed:
            known[c] = known[c[:-1]] + known[c[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; special tokens spelled out in a text are one id each."""
        if not any(x in t for t in texts for x in self.special):
            return self._plain(texts)
        cut = [self.split.split(t) for t in texts]
        ids = iter(self._plain([x for parts in cut for x in parts[::2]]))
        return [b"".join(self.special[x] if k % 2 else next(ids) for k, x in enumerate(parts)) for parts in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        clean = []
        for text in texts:
            try:
                text.encode("latin-1")  # here the library and Python agree on lower case
                text = text.lower()
            except UnicodeEncodeError:
                pass
            clean.append(text.replace("\n", " "))
        chunks = pc.split_pattern(pa.array(clean, pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > self.cache:
            self.known, self.old = {"": b""}, self.known
        ids = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            self._learn({words[i] for i in missing})
            for i in missing:
                ids[i] = self.known[words[i]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[index]
        at = np.concatenate(([0], np.cumsum(n)))
        out = pool[np.repeat(first[index] - at[:-1], n) + np.arange(at[-1])]
        ends = at[chunks.offsets.to_numpy()]
        return [out[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def parcels(texts: list[str]):
    """Lists of neighbouring texts within the bounds of a group; a longer text is alone."""
    held, chars = [], 0
    for text in texts:
        if held and (len(held) == GROUP or chars + len(text) > GROUP_CHARS):
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids plus end_id, cut only past capacity."""

    def run(batches):
        tok = tokenizer(tokenizer_file)
        tok.cache = cache
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            names = b.column("doc_id").to_pylist()
            cols: list[list] = [[], [], [], [], [], []]
            texts = [t or "" for t in b.column("t").to_pylist()]
            encoded = (ids for part in parcels(texts) for ids in tok.encode(part))
            for name, ids in zip(names, encoded, strict=True):
                ids += tail
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    row = (name, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            fields = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = len(fields) if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], fields[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slot runs (length, lo, hi, sequence, per, offset) of best-fit decreasing over counts.

    Rank p of a length, lo <= p < hi, goes to sequence + (p - lo) // per at offset + (p - lo) % per * length.
    """
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, int]]] = {}
    runs, fresh = [], 0

    def free(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        done, n = 0, histogram[length]
        while done < n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, first = capacity, fresh
                count = -(-(n - done) // (capacity // length))
                fresh += count
            per, left = room // length, n - done
            used = min(count, left // per)
            if used:
                took = used * per
            else:
                per = took = left
                used = 1
            runs.append((length, done, done + took, first, per, capacity - room))
            free(room - per * length, first, used)
            free(room, first + used, count - used)
            done += took
    return runs


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with (doc_id, piece, length).

    parts must be a stored table: it is read twice. Ranks within a length are counted in hash buckets of doc_id
    whose number follows the row count, so a length that holds a third of all rows is still many tasks; bucket
    bases are a running sum over (length, bucket) counts. Repeated rows get slots of their own.
    """
    spark = parts.sparkSession
    n = parts.count()
    buckets = min(4096, max(16, n // 20_000))
    parts = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = parts.groupBy("length", "_b").agg(F.count("*").alias("c"))
    base = counts.select("length", "_b", (F.sum("c").over(Window.partitionBy("length").orderBy("_b")) - F.col("c")).alias("base"))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.asarray(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 6)
    share = spark.sparkContext.broadcast(runs)
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece"))).join(base, ["length", "_b"])
    ranked = ranked.withColumn("_p", F.col("_r") - 1 + F.col("base")).drop("_r", "_b", "base")
    kept = [c for c in ranked.columns if c != "_p"]
    schema = ranked.select(kept).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        r = share.value
        keys = r[:, 0] << 44 | r[:, 1]
        for b in slices(batches):
            length = b.column("length").to_numpy()
            p = b.column("_p").to_numpy()
            at = np.searchsorted(keys, length << 44 | p, side="right") - 1
            k = p - r[at, 1]
            seq, off = r[at, 3] + k // r[at, 4], r[at, 5] + k % r[at, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Pack all documents: one row per piece with its place.

    Null and empty texts are one piece holding only the end id. Null ids and repeated rows are packed like any
    row. Only doc_id and text are read. An empty table gives an empty result. with_ids keeps each piece's ids;
    cache bounds the chunks a worker remembers (two generations of it).
    """
    parts, _ = table(pieces(docs, tokenizer_file, capacity, with_ids=with_ids, cache=cache), "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return place(parts, capacity).select(*out)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers as tok

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tok.path("word_bpe_49k.json"))
