"""Cycles of dependency graphs: every shape by hand, random graphs against a plain search, long chains and rings."""

import random

import pytest

from tabulon.operators import cycles as C
from tabulon.operators import formulas as O


def graph(spark, pairs, kind="point"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "source string, target string, kind string")


def plain(pairs):
    """{node: (smallest of its component, size)} for nodes that reach themselves."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(n):
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    r = {n: reach(n) for n in out}
    groups = {n: sorted(m for m in r[n] if n in r[m]) for n in out if n in r[n]}
    return {n: (g[0], len(g)) for n, g in groups.items()}


def answer(df):
    return {r.node: (r.component, r.size) for r in df.collect()}


def cell(i, col=1, sheet="S"):
    return f"{sheet}!R{i}C{col}"


SHAPES = {
    "none": [(cell(i), cell(i + 1)) for i in range(1, 9)],
    "self": [(cell(1), cell(1)), (cell(1), cell(2))],
    "ring": [(cell(i), cell(i % 7 + 1)) for i in range(1, 8)],
    "ring with ways in and out": [(cell(i), cell(i % 3 + 1)) for i in range(1, 4)] + [(cell(9), cell(1)), (cell(2), cell(20)), (cell(20), cell(21))],
    "two rings and a bridge": [(cell(1), cell(2)), (cell(2), cell(1)), (cell(2), cell(5)), (cell(5), cell(6)), (cell(6), cell(8)), (cell(8), cell(9)), (cell(9), cell(8))],
    "rings with a common cell": [(cell(1), cell(2)), (cell(2), cell(1)), (cell(1), cell(3)), (cell(3), cell(4)), (cell(4), cell(1))],
    "over sheets": [("A!R1C1", "B!R9C1"), ("B!R9C1", "B!R3C1"), ("B!R3C1", "C!R1C1"), ("C!R1C1", "A!R5C1"), ("A!R5C1", "A!R1C1"), ("A!R1C1", "A!R9C9"), ("B!R3C1", "B!R1C1")],
    "ladder": [(cell(i, c), cell(i - 1, d)) for i in range(2, 9) for c in (1, 2) for d in (1, 2)],
    "ladder with a way back": [(cell(i, c), cell(i - 1, d)) for i in range(2, 9) for c in (1, 2) for d in (1, 2)] + [(cell(2, 1), cell(6, 2))],
    "no cells": [("x", "y"), ("y", "x"), ("y", "z")],
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shapes(spark, name):
    assert answer(C.cycle_groups(graph(spark, SHAPES[name] * 2))) == plain(SHAPES[name])


def test_all_shapes_round_by_round(spark):
    """The same graphs side by side without the search of one task."""
    pairs = [(f"{i}{a}", f"{i}{b}") for i, name in enumerate(sorted(SHAPES)) for a, b in SHAPES[name]]
    rnd = random.Random(1)
    for k in range(6):
        names = [f"r{k}{rnd.choice('AB')}!R{rnd.randint(1, 40)}C{rnd.randint(1, 3)}" for _ in range(14)]
        pairs += [(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.choice([14, 24]))]
    assert answer(C.cycle_groups(graph(spark, pairs), small=0)) == plain(pairs)


def test_range_nodes_and_nulls_are_no_cells(spark):
    e = graph(spark, [("S!R1C1", "S!A1:A3")], "range_node").union(graph(spark, [(None, "S!R1C1"), ("S!R1C1", None)]))
    assert answer(C.cycle_groups(e)) == {}
    assert answer(C.cycle_groups(e.limit(0))) == {}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([12, 30])
    names = [f"{rnd.choice('AB')}!R{rnd.randint(1, 40)}C{rnd.randint(1, 3)}" for _ in range(n)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.choice([n, 2 * n]))]
    assert answer(C.cycle_groups(graph(spark, pairs))) == plain(pairs)


def test_long_chains_and_rings_take_few_rounds(spark):
    rounds = []

    def counted(df):
        rounds.append(1)
        return C.stored(df)

    n = 2000
    chain = [(cell(i), cell(i + 1)) for i in range(1, n)]
    assert answer(C.cycle_groups(graph(spark, chain), counted, 0)) == {} and len(rounds) < 8
    # a ring over all of it, with a shortcut: no order helps
    rounds.clear()
    ring = chain + [(cell(n), cell(1)), (cell(n // 2), cell(1))]
    got = answer(C.cycle_groups(graph(spark, ring), counted, 0))
    assert len(got) == n and set(got.values()) == {(min(got), n)} and len(rounds) < 45


def test_shortest_cycles(spark):
    pairs = SHAPES["rings with a common cell"] + [("T!R1C1", "T!R1C1")]
    e = graph(spark, pairs)
    groups = C.stored(C.cycle_groups(e))
    got = {r.component: r.cycle for r in C.shortest_cycles(e, groups).collect()}
    assert got == {"S!R1C1": ["S!R1C1", "S!R2C1"], "T!R1C1": ["T!R1C1"]}
    ring = graph(spark, SHAPES["ring"])
    few = {r.component: r.cycle for r in C.shortest_cycles(ring, C.stored(C.cycle_groups(ring)), most=3).collect()}
    assert few == {"S!R1C1": None}


def test_of_formulas(spark):
    cells = [("S", 2, 1, "=B2"), ("S", 2, 2, "=SUM(C1:C9)"), ("S", 4, 3, "=A2"), ("S", 5, 3, "=A1"), ("S", 6, 1, "=A2")]
    parsed = O.parsed(spark.createDataFrame(cells, "sheet string, row int, col int, text string"))
    assert set(answer(C.cycle_groups(O.edges(parsed)))) == {"S!R2C1", "S!R2C2", "S!R4C3"}
