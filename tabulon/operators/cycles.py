"""Cycles of a dependency graph: strongly connected components, however long the chains between them are.

Four steps leave little to search. Edges that all point one way in a sheet hold no
cycle, so nodes outside the reach of edges against the order go at once. Nodes
without a way in or out go, round by round. Chains of nodes with one way in and
one way out become one edge; their ends are found by pointer doubling, so that a
chain of n cells takes log n rounds. In the rest, nodes take the smallest node that
reaches them, and those that reach it back are its component.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rounds import stored
from .formulas import canonical_cycle

#: Edges that one task may search.
SMALL = 200_000
#: Sheet, row and column of a node's name.
NODE = r"^(.*)!R([0-9]+)C([0-9]+)$"


def _place(node: str) -> tuple[Column, Column]:
    part = lambda i: F.regexp_extract(node, NODE, i)
    return F.lower(part(1)), F.struct(part(2).try_cast("int").alias("r"), part(3).try_cast("int").alias("c"))


def against_order(edges: DataFrame) -> DataFrame:
    """The edges that may lie on a cycle by where their cells stand.

    A cycle inside a sheet has edges both ways, and lies between the ends of those
    of either way; one that leaves the sheet also lies between where it comes in
    and goes out. Names that are no cells are kept.
    """
    (s, a), (t, b) = _place("source"), _place("target")
    e = edges.withColumns({"s": s, "a": a, "t": t, "b": b})
    inside = F.col("s") == F.col("t")
    ends = e.select(F.inline(F.array(F.struct(F.col("s").alias("sheet"), F.lit(True).alias("out"), "a", "b", inside.alias("inside")), F.struct(F.col("t").alias("sheet"), F.lit(False).alias("out"), "a", "b", inside.alias("inside")))))
    once, up = F.col("inside") & F.col("out"), F.col("b") >= F.col("a")
    leaves, enters = ~F.col("inside") & F.col("out"), ~F.col("inside") & ~F.col("out")
    when = lambda c, x: F.when(c, F.col(x))
    per = ends.groupBy("sheet").agg(
        F.min(when(once & up, "a")).alias("up0"), F.max(when(once & up, "b")).alias("up1"), F.min(when(once & ~up, "b")).alias("down0"), F.max(when(once & ~up, "a")).alias("down1"),
        F.min(when(leaves, "a")).alias("out0"), F.max(when(leaves, "a")).alias("out1"), F.min(when(enters, "b")).alias("in0"), F.max(when(enters, "b")).alias("in1"),
    )
    through = F.col("out0").isNotNull() & F.col("in0").isNotNull()
    with_ = lambda f, x, y: f(F.col(x), F.when(through, F.col(y)))
    bounds = per.select("sheet", with_(F.least, "up0", "out0").alias("lo"), with_(F.greatest, "up1", "in1").alias("hi"), with_(F.least, "down0", "in0").alias("lo2"), with_(F.greatest, "down1", "out1").alias("hi2"))
    for sheet, at in (("s", "a"), ("t", "b")):
        own = bounds.select(F.col("sheet").alias(sheet), F.struct("lo", "hi", "lo2", "hi2").alias(f"{at}_in"))
        e = e.join(own, sheet)
        x = F.col(f"{at}_in")
        e = e.where((F.col(sheet) == "") | ((F.col(at) >= x["lo"]) & (F.col(at) <= x["hi"]) & (F.col(at) >= x["lo2"]) & (F.col(at) <= x["hi2"])))
    return e.select("source", "target")


def _degrees(edges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    ways = edges.select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("next"), none.alias("last")), F.struct(F.col("target").alias("node"), none.alias("next"), F.col("source").alias("last")))))
    return ways.groupBy("node").agg(F.count("next").alias("n_out"), F.count("last").alias("n_in"), F.min("next").alias("next"), F.min("last").alias("last"))


def chain_ends(links: DataFrame, store=stored) -> DataFrame:
    """links (node, next, last) of chains with the first node after and before each that is no link itself, by pointer doubling.

    ``ring``: the smallest node of the ring, for links of one; else null.
    """
    now = links.select("node", "next", "last", F.col("node").alias("low"))
    before = None
    while True:
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        behind = now.select(F.col("node").alias("last"), F.col("last").alias("last2"))
        both = now.select("node", "next", "last", "low").join(ahead, "next", "left").join(behind, "last", "left")
        low = F.least("low", "low2")
        now = store(both.select("node", F.coalesce("next2", "next").alias("next"), F.coalesce("last2", "last").alias("last"), low.alias("low"), F.col("next2").isNotNull().alias("on"), F.col("last2").isNotNull().alias("back"), (low < F.col("low")).alias("lower")))
        # either way, links of open chains on their way get fewer each time; on rings the smallest node is settled once none gets a smaller one
        on, back, lower = now.agg(F.count_if("on"), F.count_if("back"), F.count_if("lower")).first()
        if not on + back or ((on, back) == before and not lower):
            break
        before = on, back
    more = now.join(now.select(F.col("node").alias("next")), "next", "left_semi").select("node", F.lit(True).alias("on_ring"))
    return now.join(more, "node", "left").select("node", "next", "last", F.when(F.col("on_ring"), F.col("low")).alias("ring"))


def _reduced(edges: DataFrame, store) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(core edges, chains (node, next, last) round by round, (node, component) found on the way)."""
    now, before, chains, found = edges, -1, [], []
    while (n := now.count()) and n != before:
        before = n
        nodes = store(_degrees(now))
        live, link = nodes.where("n_in > 0 and n_out > 0").select("node"), nodes.where("n_in = 1 and n_out = 1")
        side = lambda c: live.select(F.col("node").alias(c))
        kept = now.join(side("source"), "source", "left_semi").join(side("target"), "target", "left_semi").select("source", "target")
        if link.limit(1).count():
            ends = store(chain_ends(link, store))
            found.append(ends.where("ring is not null").select("node", F.col("ring").alias("component")))
            open_ = ends.where("ring is null").select("node", "next", "last")
            chains.append(open_)
            gone = lambda c: ends.select(F.col("node").alias(c))
            kept = kept.join(gone("source"), "source", "left_anti").join(gone("target"), "target", "left_anti")
            kept = store(kept.select("source", "target").union(open_.select(F.col("last").alias("source"), F.col("next").alias("target"))).distinct())
            found.append(kept.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component")))
            kept = kept.where("source <> target")
        now = store(kept)
    return now, chains, found


def _least(edges: DataFrame, store) -> DataFrame:
    """node, least: the smallest node that reaches it, itself included.

    Besides the nodes right before it, a node asks the one that it has so far.
    """
    now = store(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("least", F.col("node")))
    while True:
        step = edges.join(now.select(F.col("node").alias("source"), "least"), "source").groupBy(F.col("target").alias("node")).agg(F.min("least").alias("by"))
        jump = now.select(F.col("node").alias("least"), F.col("least").alias("far"))
        new = now.select("node", "least").join(step, "node", "left").join(jump, "least", "left")
        least = F.least("least", "by", "far")
        now = store(new.select("node", least.alias("least"), (least < F.col("least")).alias("changed")))
        if not now.where("changed").limit(1).count():
            return now.select("node", "least")


def _components(edges: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """((node, component), nodes dealt with) of a core: those that the smallest node of a color reaches, and that reach it."""
    color = _least(edges, store)
    ends = lambda c: color.select(F.col("node").alias(c), F.col("least").alias(f"{c}_color"))
    same = edges.join(ends("source"), "source").join(ends("target"), "target").where("source_color = target_color")
    back = _least(store(same.select(F.col("target").alias("source"), F.col("source").alias("target"))), store)
    group = store(color.join(back.withColumnRenamed("least", "back"), "node").where("least = back").select("node", F.col("least").alias("component")))
    # the smallest node of a color that has no edge back is alone, and dealt with as well
    return group, store(group.select("node").union(color.where("node = least").select("node")).distinct())


def _searched(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, component) of a small graph by one depth-first search."""
    after: dict[str, list[str]] = {}
    for a, b in zip(edges["source"], edges["target"], strict=True):
        after.setdefault(a, []).append(b)
    at: dict[str, int] = {}
    low: dict[str, int] = {}
    open_, on, out = [], set(), []
    for root in after:
        if root in at:
            continue
        way = [(root, iter(after[root]))]
        at[root] = low[root] = len(at)
        open_.append(root)
        on.add(root)
        while way:
            node, rest = way[-1]
            for b in rest:
                if b not in at:
                    at[b] = low[b] = len(at)
                    open_.append(b)
                    on.add(b)
                    way.append((b, iter(after.get(b, ()))))
                    break
                if b in on:
                    low[node] = min(low[node], at[b])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == at[node]:
                    own = [open_.pop()]
                    while own[-1] != node:
                        own.append(open_.pop())
                    on.difference_update(own)
                    if len(own) > 1:
                        out += [(n, node) for n in own]
    return pd.DataFrame(out, columns=["node", "component"])


def cycle_groups(edges: DataFrame, store=stored, small: int = SMALL) -> DataFrame:
    """node, component (its smallest node) and size of every cell that lies on a cycle.

    ``edges``: source, target and kind as formulas.edges() gives them; range nodes
    are no cells. A cell that reads itself is a component of one. No edge gives no
    row, repeated edges count once; edges with a null end go. ``store`` writes a
    round and reads it back. Where the order of cells leaves at most ``small`` edges,
    one task searches them; the result is the same.
    """
    all_ = store(edges.where("kind <> 'range_node' and source is not null and target is not null").select("source", "target").distinct())
    found = [all_.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))]
    now, levels = store(against_order(all_.where("source <> target"))), []
    if now.count() <= small:
        found.append(now.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_searched, "node string, component string"))
        now = now.limit(0)
    while now.limit(1).count():
        now, chains, more = _reduced(now, store)
        levels += chains
        found += more
        group, seen = _components(now, store)
        found.append(group)
        done = lambda c: seen.select(F.col("node").alias(c))
        now = store(now.join(done("source"), "source", "left_anti").join(done("target"), "target", "left_anti").select("source", "target"))
    # a ring or a loop can be part of what a later round finds: the last one found counts
    ranked = reduce(DataFrame.union, [f.withColumn("k", F.lit(k)) for k, f in enumerate(found)])
    label = store(ranked.groupBy("node").agg(F.max_by("component", "k").alias("component")))
    for chain in reversed(levels):
        end = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
        on = chain.join(end("next"), "next").join(end("last"), "last").where("next_component = last_component")
        label = store(label.join(on.select("node"), "node", "left_anti").select("node", "component").union(on.select("node", F.col("next_component").alias("component"))))
    per = label.groupBy("component").agg(F.min("node").alias("smallest"), F.count("*").alias("size"))
    return label.join(per, "component").select("node", F.col("smallest").alias("component"), "size")


def shortest_cycles(edges: DataFrame, groups: DataFrame, most: int = 50, store=stored) -> DataFrame:
    """component and cycle: the shortest way from each component's smallest node back to it, smallest first, then the smallest by names.

    Ways of more than ``most`` cells aren't spelled out: cycle is then null, the component is there all the same.
    """
    own = groups.select(F.col("node"), "component")
    inside = edges.where("kind <> 'range_node'").select("source", "target").distinct()
    inside = inside.join(own.withColumnRenamed("node", "source"), "source").join(own.select(F.col("node").alias("target"), F.col("component").alias("c2")), "target")
    inside = store(inside.where("component = c2").select("component", "source", "target"))
    first = groups.select("component").distinct()
    front = first.select("component", F.col("component").alias("node"), F.array("component").alias("path"))
    seen, found = front.select("component", "node"), []
    for _ in range(most):
        step = front.withColumnRenamed("node", "source").join(inside, ["component", "source"]).groupBy("component", F.col("target").alias("node")).agg(F.min("path").alias("path"))
        step = store(step)
        found.append(step.where("node = component").select("component", F.col("path").alias("cycle")))
        front = step.where("node <> component").join(seen, ["component", "node"], "left_anti").join(found[-1], "component", "left_anti")
        front = store(front.select("component", "node", F.concat("path", F.array("node")).alias("path")))
        if not front.limit(1).count():
            break
        seen = store(seen.union(front.select("component", "node")))
    closed = reduce(DataFrame.union, found)
    return first.join(closed, "component", "left").select("component", canonical_cycle(F.col("cycle")).alias("cycle"))
