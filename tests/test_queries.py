"""Every registered query of the library equals its SQL."""

from collections import Counter, deque

import pytest
from conftest import DATA, same

from codelode.plans import code, graphs, places, tables  # noqa: F401
from codelode.plans.registry import ORACLE_SQL, QUERIES
from codelode.sources import views


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = same(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])
    assert got == want


def test_toposort_order(spark):
    """The one query without SQL, against a plain queue."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"toposort_order"}
    pairs = {(r.src, r.dst) for r in views.turns(spark, DATA).collect() if r.src != r.dst}
    after, open_ = {}, Counter(b for _, b in pairs)
    for a, b in sorted(pairs):
        after.setdefault(a, []).append(b)
    queue, want = deque(sorted({a for a, _ in pairs} - set(open_))), []
    while queue:
        want.append(queue.popleft())
        for b in after.get(want[-1], ()):
            open_[b] -= 1
            if not open_[b]:
                queue.append(b)
    assert [r.id for r in QUERIES["toposort_order"](spark, DATA).orderBy("place").collect()] == want


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
