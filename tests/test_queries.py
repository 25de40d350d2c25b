"""Every registered query of the tables against its SQL."""

import pytest

from archsieve.plans import tables
from tests.oracle import expected, rows

SF = "/root/testdata/sf0.001"
#: Queries that find nothing on the smallest tables.
LARGER = {"compensation": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(tables.SQL))
def test_query_equals_sql(spark, name):
    at = LARGER.get(name, SF)
    got = rows(tables.QUERIES[name](spark, at))
    want = expected(tables.SQL[name], at)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "the query should find something on this data"


def plain_components(edges):
    """Strongly connected components by two depth-first searches."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
        out.setdefault(b, []), back.setdefault(a, [])

    def search(start, graph, seen, order):
        stack = [(start, iter(graph[start]))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(graph[x])))
                    break
            else:
                order.append(node)
                stack.pop()

    order, seen = [], set()
    for n in out:
        if n not in seen:
            search(n, out, seen, order)
    found, seen = {}, set()
    for n in reversed(order):
        if n not in seen:
            members = []
            search(n, back, seen, members)
            if len(members) > 1:
                found |= dict.fromkeys(members, min(members))
    return found


def test_file_cycles_equal_a_plain_search(spark):
    edges = [tuple(r) for r in tables.file_edges(spark, SF).collect()]
    want = plain_components(edges)
    assert {r.node: r.component for r in tables.QUERIES["file_cycles"](spark, SF).collect()} == want
    assert len(set(want.values())) > 3 and len(want) > 100
