"""Greedy groups in rounds against the sequence."""

import random

import pytest

from brightfield.operators import graph


def plain(units, edges, most):
    """The sequence: units from the smallest on; each free one takes its free larger neighbours, smallest first."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    owner = {}
    for u in sorted(units):
        if u in owner:
            continue
        owner[u], total = u, units[u]
        for v in sorted(near.get(u, ())):
            if v not in owner and (most is None or total + units[v] <= most):
                owner[v], total = u, total + units[v]
    return owner


@pytest.mark.parametrize("most", [None, 12])
def test_rounds_are_the_sequence(spark, most):
    """Random graphs of several densities, a chain, a star and units without neighbours, all sessions in one call."""
    rnd = random.Random(5)
    given = {}
    for k in range(12):
        n = rnd.randint(1, 40)
        units = {u: rnd.randint(1, 9) for u in rnd.sample(range(1000), n)}
        names = list(units)
        pairs = {tuple(sorted(rnd.sample(names, 2))) for _ in range(rnd.randint(0, 3 * n))} if n > 1 else set()
        given[f"s{k}"] = (units, pairs)
    given["chain"] = ({u: 2 for u in range(12)}, {(u, u + 1) for u in range(11)})
    given["star"] = ({u: 1 for u in range(30)}, {(7, u) if u > 7 else (u, 7) for u in range(30) if u != 7})
    nodes = spark.createDataFrame([(s, u, n) for s, (units, _) in given.items() for u, n in units.items()], "session string, unit_id long, size int")
    edges = spark.createDataFrame([(s, a, b) for s, (_, pairs) in given.items() for a, b in pairs], "session string, u1 long, u2 long")
    got = {}
    for r in graph.greedy_groups(nodes, edges.unionByName(edges), "g", most).collect():
        assert (r.session, r.unit_id) not in got
        got[r.session, r.unit_id] = r.g
    assert got == {(s, u): o for s, (units, pairs) in given.items() for u, o in plain(units, pairs, most).items()}
    assert {r.g for r in graph.greedy_groups(nodes, edges.limit(0), "g", most).where("session = 'chain'").collect()} == set(range(12))
