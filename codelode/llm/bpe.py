"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before encoding. A boundary is a single space or newline between two
word characters: no alternative of the split pattern continues from a non-space into white space, and none of
the white-space alternatives sees more than this one character there, so pieces encode as the whole would.
Long runs of white space, on which the library's pattern would recurse too deep, are matched here as the pattern
does: all but the last character before a non-space is one match, the whole run at the end of the text. Other
texts without a boundary are encoded whole. Decoding joins raw bytes, so ids that cut a character are safe.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import rows_of, slices

BOUNDARY = re.compile(r"(?<=[^\W\d_])[ \n](?=[^\W\d_])")
LONG = 1 << 16
# The characters that the library's pattern takes for white space
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a local rank file, one per worker process."""
    key = (rank_file, pattern)
    if key not in _ENCODINGS:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """Cut text into pieces of about long characters at safe boundaries; the pieces join to the text."""
    start = 0
    while len(text) - start > long:
        m = BOUNDARY.search(text, start + long)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in RUN.finditer(text):
        for piece in safe_pieces(text[at : m.start()]):
            ids += enc.encode_ordinary(piece)
        at = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc._encode_single_piece(text[m.start() : at])
    for piece in safe_pieces(text[at:]):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) for every row, in one narrow pass without a shuffle.

    Null and empty texts give an empty array; a null id and repeated rows pass through; other columns are not
    read, so their names cannot clash; an empty table gives an empty result.
    """

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in slices(batches):
            ids = [encode_text(enc, t or "") for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_le, bytes): the ids as little-endian 32-bit integers and the raw bytes they decode to."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in slices(batches):
            col = b.column("ids")
            ids = [np.asarray(x or [], dtype="<u4") for x in col.to_pylist()]
            raw = [enc.decode_bytes(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(raw, pa.binary())],
                ["doc_id", "n_tokens", "ids_le", "bytes"],
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_le binary, bytes binary")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Round trip of every document: token count and digests of its ids and of the decoded bytes."""
    import public_tokenizers as tok

    ranks, pattern = tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = decode(encode(docs, ranks, pattern), ranks, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
