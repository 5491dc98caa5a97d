"""WITH RECURSIVE: rounds over what the last round found, until it finds nothing new.

Of each recursive table the parts that do not name it are read once; the others are read with the last round's rows in
its place. With UNION rows already found are taken out by a set difference, so cycles end; with UNION ALL they stay.
Every round is cut, so neither plans nor lineage grow with the rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.scratch import cut
from codelode.sources.dialect import TOKEN

ROUNDS = 1000


class TooManyRounds(RuntimeError):
    pass


def _significant(toks: list[str], k: int) -> int:
    while k < len(toks) and (toks[k].isspace() or toks[k].startswith(("--", "/*"))):
        k += 1
    return k


def _closing(toks: list[str], k: int) -> int:
    """The place of the bracket that closes the one at k."""
    depth = 0
    for e in range(k, len(toks)):
        depth += (toks[e] == "(") - (toks[e] == ")")
        if not depth:
            return e
    raise ValueError("a bracket is not closed")


def _tables(toks: list[str]) -> tuple[list[tuple[str, list[str], list[str]]], str] | None:
    """((name, columns, tokens of the query) of every table, what follows them) of WITH RECURSIVE; None for other statements."""
    k = _significant(toks, 0)
    if k >= len(toks) or toks[k].lower() != "with":
        return None
    k = _significant(toks, k + 1)
    if k >= len(toks) or toks[k].lower() != "recursive":
        return None
    out = []
    while True:
        k = _significant(toks, k + 1)
        name, columns = toks[k], []
        k = _significant(toks, k + 1)
        if toks[k] == "(":
            end = _closing(toks, k)
            columns = [t for t in toks[k + 1 : end] if t != "," and not t.isspace()]
            k = _significant(toks, end + 1)
        if toks[k].lower() != "as":
            raise ValueError("AS is wanted after the name of a table")
        k = _significant(toks, k + 1)
        while toks[k] != "(":  # [NOT] MATERIALIZED
            k = _significant(toks, k + 1)
        end = _closing(toks, k)
        out.append((name, columns, toks[k + 1 : end]))
        k = _significant(toks, end + 1)
        if k >= len(toks) or toks[k] != ",":
            return out, "".join(toks[k:])


def _parts(toks: list[str]) -> tuple[list[list[str]], bool]:
    """The queries that UNION joins, and whether all of them are joined by UNION ALL."""
    parts, every, depth, k = [[]], True, 0, 0
    while k < len(toks):
        t = toks[k]
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.lower() == "union":
            n = _significant(toks, k + 1)
            if n < len(toks) and toks[n].lower() == "all":
                k = n
            else:
                every = False
            parts.append([])
        elif depth == 0 and t.lower() == "limit" and len(parts) > 1:
            raise ValueError("LIMIT is not taken in a recursive table")
        else:
            parts[-1].append(t)
        k += 1
    return parts, every


def run(statement: str, read: Callable[[str], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """A query whose WITH RECURSIVE tables are made round by round; read runs a statement without them.

    Columns take the types of the parts that are read once. More than ``rounds`` rounds raise TooManyRounds.
    """
    found = _tables([m[0] for m in TOKEN.finditer(statement)])
    if found is None:
        return read(statement)
    tables, rest = found
    known: list[str] = []

    def ask(query: str, *more: str) -> DataFrame:
        with_ = [*known, *more]
        return read(f"WITH {', '.join(with_)} {query}" if with_ else query)

    for name, columns, toks in tables:
        plain = name.strip('"`[]').lower()
        own = lambda part: any(t.strip('"`[]').lower() == plain for t in part)
        head = f"{name}({', '.join(columns)})" if columns else name
        if not own(toks):
            known.append(f"{head} AS ({''.join(toks)})")
            continue
        parts, every = _parts(toks)
        first, steps = [p for p in parts if not own(p)], [p for p in parts if own(p)]
        if not first:
            raise ValueError(f"{name} has no part to begin with")
        start = None
        for p in first:
            rows = ask("".join(p))
            start = rows if start is None else start.union(rows)
        if columns:
            start = start.toDF(*columns)
        start = cut(start if every else start.distinct())
        levels, last = [start], start
        while last.take(1):
            if len(levels) > rounds:
                raise TooManyRounds(f"{name} finds more rows after {rounds} rounds")
            view = f"recursive_{uuid.uuid4().hex}"
            last.createOrReplaceTempView(view)
            new = None
            for p in steps:
                rows = ask("".join(p), f"{name} AS (SELECT * FROM {view})").toDF(*start.columns)
                rows = rows.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in start.dtypes])
                new = rows if new is None else new.union(rows)
            if not every:
                new = new.subtract(_all(levels))
            last = cut(new)
            start.sparkSession.catalog.dropTempView(view)
            levels.append(last)
        view = f"recursive_{uuid.uuid4().hex}"
        _all(levels).createOrReplaceTempView(view)
        known.append(f"{name} AS (SELECT * FROM {view})")
    return ask(rest)


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out
