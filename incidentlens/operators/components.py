"""Connected components of an undirected graph given as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

HOPS = 2


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for nodes(node) and edges(a, b); the root is the smallest node reached.

    Each round deals the live nodes a random order and hooks every node to its first neighbour in
    that order, if it comes before the node itself. Paths of hooks are short under a random order;
    `HOPS` squarings of the hook table follow them, edges are moved along, and edges inside one node
    disappear. Of the nodes of a chain a third stay at most, so the rounds grow with the logarithm of
    the graph's size, whatever its shape; there is no limit to them. The tables of a round are stored, in
    as many files as its edges fill, and removed when the next one is there. Nodes without edges are their own root; edges to nodes
    that are not in `nodes` still connect.
    """
    return settle(nodes, edges)[0]


def settle(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """The components, and how many rounds it took."""
    live = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .filter("a <> b").distinct())
    moves, most = [], 0
    while n := live.count():
        # An edge has two nodes, and edges only disappear.
        most = max(most, 2 * n)
        once = hooks = _hooks(live, len(moves), 2 * n)
        for _ in range(HOPS):
            # A root hooks to itself, so the table squared is the path of twice the length.
            hooks = hooks.join(_renamed(hooks, "to", "further"), "to").select(
                "node", F.col("further").alias("to"))
        moved = stored(hooks, 2 * n)
        discard(once)
        moves.append(moved)
        following = stored(
            live.join(_renamed(moved, "a", "x"), "a").join(_renamed(moved, "b", "y"), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n)
        discard(live)
        live = following
    rounds = len(moves)
    if not moves:
        return nodes.select("node", F.col("node").alias("root")), rounds
    discard(live)
    whole = moves[-1]
    for step in reversed(moves[:-1]):
        whole = step.join(_renamed(whole, "to", "further"), "to", "left").select(
            "node", F.coalesce("further", "to").alias("to"))
    whole = stored(whole, most)
    discard(*moves)
    first = whole.groupBy("to").agg(F.min("node").alias("root"))
    roots = stored(whole.join(first, "to").select("node", "root"), most)
    discard(whole)
    return nodes.select("node").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")), rounds


def _hooks(live: DataFrame, turn: int, rows: int) -> DataFrame:
    """(node, to): the first neighbour in this round's order, or the node itself if that is first."""
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def place(c):
        return F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))

    first = both.groupBy("a").agg(F.min(place("b")).alias("m"))
    return stored(first.select(F.col("a").alias("node"),
                               F.least(place("a"), F.col("m"))["id"].alias("to")), rows)


def _renamed(step: DataFrame, key: str, value: str) -> DataFrame:
    return step.select(F.col("node").alias(key), F.col("to").alias(value))
