"""Which span a place lies in: stabbing joins over byte spans, identifier tokens, and the edges that follow from both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

BLOCK = 1 << 20  # bytes of a file whose places are ordered in one group
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
WORD = DIGIT | np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"))
NAMED = ("function", "method", "class", "struct")


def stab(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(file_id, at, ...) with the spans(file_id, s, e, ...) that hold them: s <= at < e, any number of rows each.

    An equality join: a span stands under the one or two cells of the power of two at or above its length that it
    touches, a point under its cell of every such power that its file has. So a cell meets few spans however
    they lie, a file may be of any size, and empty spans hold nothing. The spans' columns must not clash with the points'.
    """
    size = F.col("e") - F.col("s")
    level = F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)
    some = spans.where("s < e").withColumn("_level", level)
    cells = some.withColumn("_cell", F.explode(F.array_distinct(F.array(F.expr("shiftright(s, _level)"), F.expr("shiftright(e - 1, _level)")))))
    levels = some.groupBy("file_id").agg(F.collect_set("_level").alias("_levels"))  # 64 at most
    asked = points.join(levels, "file_id").withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_cell", F.expr("shiftright(at, _level)"))
    return asked.join(cells, ["file_id", "_level", "_cell"]).where("s <= at AND at < e").drop("_level", "_cell")


def changes(spans: DataFrame) -> DataFrame:
    """(file_id, at, _id): the last of the spans that hold each place where one of them starts or ends, null for none."""
    own = spans.select("file_id", F.col("id").alias("_id"), F.col("start_byte").alias("s"), F.col("end_byte").alias("e")).where("s < e")
    edges = own.select("file_id", F.explode(F.array("s", "e")).alias("at")).distinct()
    held = stab(edges, own).groupBy("file_id", "at").agg(F.max_by("_id", F.struct("s", (-F.col("e")).alias("e"), "_id")).alias("_id"))
    return edges.join(held, ["file_id", "at"], "left").select("file_id", "at", "_id")


def innermost(points: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """points(file_id, at, ...) with ``span_id``: the last of the spans(file_id, id, start_byte, end_byte) that hold a point.

    Last is by (start, -end, id), so where spans nest it is the innermost. Points in no span get null; spans may cross.
    What holds at each start and end of a span is found by ``stab``; a point takes what holds at the last such place
    before it, in one ordered pass over blocks of ``block`` bytes, which hand on what holds at their end.
    """
    # a struct tells "in no span" from "nothing known"
    state = changes(spans).select("file_id", "at", F.struct("_id").alias("_state"))
    place = F.floor(F.col("at") / block).alias("_block")
    state = state.select("*", place)
    last = state.groupBy("file_id", "_block").agg(F.max_by("_state", "at").alias("_carry"))
    after = F.lead("_block").over(Window.partitionBy("file_id").orderBy("_block"))
    carry = last.withColumn("_next", after).where("_next IS NOT NULL AND _carry._id IS NOT NULL")
    carry = carry.select("file_id", F.explode(F.sequence(F.col("_block") + 1, F.col("_next"))).alias("_block"), "_carry")
    rows = state.withColumn("_point", F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType))
    asked = points.select("file_id", "at", F.lit(None).cast(state.schema["_state"].dataType).alias("_state"), place, F.struct(*points.columns).alias("_point"))
    order = Window.partitionBy("file_id", "_block").orderBy("at", F.col("_point").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(asked).repartition("file_id", "_block").withColumn("_state", F.last("_state", ignorenulls=True).over(order)).where("_point IS NOT NULL")
    found = both.join(carry, ["file_id", "_block"], "left").withColumn("_state", F.coalesce("_state", "_carry"))
    return found.select("_point.*", F.col("_state._id").alias("span_id"))


def containing(spans: DataFrame) -> DataFrame:
    """(id, parent_id) of spans(file_id, id, start_byte, end_byte): the shortest strictly longer span that holds all of it.

    Of equally long ones the smallest id. Equal spans share their parent; null where there is none. An empty span lies in
    those that hold its place or end there.
    """
    own = spans.select("file_id", "id", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    # equal spans are one, named by the smallest id
    one = own.groupBy("file_id", "s", "e").agg(F.min("id").alias("_first"))
    inner = one.select("file_id", F.col("s").alias("_start"), F.col("e").alias("_end"))
    # an empty span is also held by those that end where it stands, which hold the byte before
    probe = F.when(F.col("_start") < F.col("_end"), F.array("_start")).otherwise(F.array("_start", F.col("_start") - 1))
    up = stab(inner.withColumn("at", F.explode(probe)), one).where("s <= _start AND e >= _end AND e - s > _end - _start")
    best = up.groupBy("file_id", F.col("_start").alias("s"), F.col("_end").alias("e")).agg(F.min_by("_first", F.struct((F.col("e") - F.col("s")).alias("n"), "_first")).alias("parent_id"))
    return own.join(best, ["file_id", "s", "e"], "left").select("id", "parent_id")


def pieces(batches, rows: int = 1000):
    """Batches in parts of a thousand lines, as a line may be long."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def words_at(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(line, first byte in it, word) of the words of ASCII letters, digits and _ that begin with no digit, over a column of lines."""
    lines = pc.fill_null(lines.cast(pa.large_string()), "")
    _, offsets, data = lines.buffers()
    ends = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    text = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    part = WORD[text]
    first = part.copy()
    first[1:] &= ~part[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = part[begins]
    last = part.copy()
    last[:-1] &= ~part[1:] | first[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    named = ~DIGIT[text[start]]
    spread = np.zeros(text.size + 1, np.int8)
    spread[start[named]] += 1
    spread[stop[named]] -= 1
    start, stop = start[named], stop[named]
    chars = text[np.cumsum(spread[:-1], dtype=np.int8) > 0]
    words = pa.LargeStringArray.from_buffers(start.size, pa.py_buffer(np.append(0, np.cumsum(stop - start))), pa.py_buffer(chars)).cast(pa.string())
    line = np.searchsorted(ends, start, side="right") - 1
    return line, start - ends[line], words


def identifiers(lines: DataFrame) -> DataFrame:
    """(file_id, name, at): the words of ASCII letters, digits and _ in lines(file_id, pos, line, start_byte), with their first byte.

    Words that begin with a digit are numbers and left out. Each line is read by itself, so nothing is sent or sorted.
    """

    def run(batches):
        for b in pieces(batches):
            line, at, names = words_at(b.column("line"))
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(pa.array(line)), names, pc.add(b.column("start_byte").take(pa.array(line)), pa.array(at))], ["file_id", "name", "at"])

    own = lines.select("file_id", F.col("start_byte").cast("long").alias("start_byte"), "line")
    return own.mapInArrow(run, StructType([own.schema["file_id"], StructField("name", StringType()), StructField("at", LongType())]))


def placed(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_id, name, at, span_id) of the identifiers of lines(file_id, line, start_byte): ``innermost`` over ``identifiers``.

    Lines are what is sent: each gets the span at its start and the changes inside it, and its words are
    told apart by them where it is read.
    """
    own = lines.select("file_id", F.col("start_byte").cast("long").alias("at"), "line")
    starts = own.groupBy("file_id", "at").agg(F.max(F.octet_length("line")).alias("_n"))
    inner = stab(changes(spans), starts.select("file_id", F.col("at").alias("s"), (F.col("at") + F.col("_n")).alias("e"))).where("s < at")
    inner = inner.groupBy("file_id", F.col("s").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("at", "_id"))).alias("_later"))
    known = innermost(starts.select("file_id", "at"), spans)
    known = known.join(inner.withColumnRenamed("_s", "at"), ["file_id", "at"], "left").where("span_id IS NOT NULL OR _later IS NOT NULL")
    rows = own.join(known, ["file_id", "at"], "left").select("file_id", "at", "line", "span_id", F.transform("_later", lambda x: x.at).alias("_places"), F.transform("_later", lambda x: x._id).alias("_ids"))

    def run(batches):
        for b in pieces(batches):
            line, at, names = words_at(b.column("line"))
            files, starts, spans, places, ids = (b.column(c) for c in ("file_id", "at", "span_id", "_places", "_ids"))
            at = at + starts.to_numpy(zero_copy_only=False)[line]
            pool, pick, n = [spans], line.copy(), len(spans)
            for k in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)).tolist():
                lo, hi = np.searchsorted(line, [k, k + 1])
                after = np.searchsorted(np.array(places[k].as_py()), at[lo:hi], side="right")
                pick[lo:hi] = np.where(after > 0, n + after - 1, pick[lo:hi])
                pool.append(ids[k].values)
                n += len(ids[k].values)
            found = pa.concat_arrays(pool).take(pa.array(pick))
            out = pa.table([files.take(pa.array(line)), names, pa.array(at), found], ["file_id", "name", "at", "span_id"])
            yield from out.to_batches()

    kind = spans.schema["id"].dataType
    return rows.mapInArrow(run, StructType([own.schema["file_id"], StructField("name", StringType()), StructField("at", LongType()), StructField("span_id", kind)]))


def references(tokens: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = NAMED) -> DataFrame:
    """(file_id, src_symbol_id, dst_symbol_id, dst_name, relation): who names whom in a file, once each.

    A token names the first symbol of its name and of the given kinds in its file; the source is the innermost
    symbol around the token. Tokens around which there is none, and symbols that name themselves, give no edge.
    """
    first = firsts(symbols, kinds)
    return _edges(innermost(tokens.join(first, ["file_id", "name"]), symbols))


def firsts(symbols: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return symbols.where(F.col("kind").isin(*kinds)).groupBy("file_id", "name").agg(F.min("id").alias("dst_symbol_id"))


def _edges(named: DataFrame) -> DataFrame:
    named = named.where("span_id <> dst_symbol_id")
    return named.select("file_id", F.col("span_id").alias("src_symbol_id"), "dst_symbol_id", F.col("name").alias("dst_name"), F.lit("references").alias("relation")).distinct()
