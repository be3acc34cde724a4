"""Merkle manifest of a dataset: one hash tree a group and one over the groups, built and taken apart by slot pivots."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise, small_or_salted_join, with_rank

#: Children of a node.
FANOUT = 8
#: Groups up to which their list is broadcast (some 100 bytes each).
BROADCAST_GROUPS = 20_000

STEPS = "array<struct<left:string,right:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def leaf(columns: dict[str, Column]) -> Column:
    """The leaf of a row: a hash of its values in order, each ``-`` if null, else its UTF-8 bytes' count, ``:`` and the value."""
    parts = []
    for value in columns.values():
        said = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return digest(F.concat(*parts))


def _slots(fanout: int) -> list[str]:
    return [f"c{j}" for j in range(fanout)]


def _tops(ended: list[DataFrame]) -> DataFrame:
    """(g, h): the last node of each group."""
    parts = [e.select("g", F.col("x.h").alias("h")) for e in ended]
    return functools.reduce(DataFrame.unionByName, parts)


def _climb(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The pivots of each level, from the leaves up, and per level the nodes that are the last of their group (g, x).

    ``nodes`` has g, pos (from 0 in its group), n (nodes of the group on this level) and x, a struct with the hash h. A pivot is a row a
    parent: g, parent, n and a column a slot. Rows of a level shrink to one in ``fanout``.
    """
    pivots, ended = [], [nodes.filter("n = 1").select("g", "x")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        slot = F.pmod("pos", F.lit(fanout))
        columns = [F.max(F.when(slot == j, F.col("x"))).alias(c) for j, c in enumerate(_slots(fanout))]
        dealt = nodes.filter("n > 1").groupBy("g", F.expr(f"pos div {fanout}").alias("parent"))
        pivot = materialise(dealt.agg(F.first("n").alias("n"), *columns), f"merkle-{name}-{len(pivots)}")
        pivots.append(pivot)
        h = digest(F.concat_ws("", *[F.col(c)["h"] for c in _slots(fanout)]))
        nodes = pivot.select("g", F.col("parent").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.struct(h.alias("h")).alias("x"))
        ended.append(nodes.filter("n = 1").select("g", "x"))
        most = -(-most // fanout)
    return pivots, ended


def _descend(pivots: list[DataFrame], ended: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """(g, top, x, steps) of each leaf: siblings to its left and right, level by level up to its group's top, then the steps of ``tops`` (g, top, steps).

    A level's rows meet the steps of their parents, and each slot leaves its own column out, so that steps move once for ``fanout`` children.
    """
    above = None
    for k in range(len(pivots), -1, -1):
        ends = ended[k].join(tops.hint("merge"), "g").select("g", F.lit(0).cast("long").alias("pos"), "top", "x", "steps")
        if above is None:
            rows = ends
        else:
            slots = _slots(fanout)
            hashes = [F.col(c)["h"] for c in slots]
            children = F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).alias("x"), F.concat_ws("", *hashes[:j]).alias("left"), F.concat_ws("", *hashes[j + 1 :]).alias("right")) for j, c in enumerate(slots)])
            met = pivots[k].join(above.select("g", F.col("pos").alias("parent"), "top", "steps").hint("merge"), ["g", "parent"])
            child = met.select("g", "parent", "top", "steps", F.explode(children).alias("s")).filter("s.x IS NOT NULL")
            step = F.array(F.struct(F.col("s.left").alias("left"), F.col("s.right").alias("right")))
            rows = child.select("g", (F.col("parent") * fanout + F.col("s.j")).alias("pos"), "top", F.col("s.x").alias("x"), F.concat(step, F.col("steps")).alias("steps")).unionByName(ends)
        above = materialise(rows, f"merkle-{name}-steps-{k}") if k else rows
    return above


def manifest(docs: DataFrame, *, id: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """A row a row of ``docs``: the id, leaf, subroot (of its group), root (of all), steps (siblings left and right, from the leaf up to the root)
    and altered_leaf (the leaf with the columns of ``altered`` put in the place of those of the same name).

    Leaves of a group ascend by id and then by hash, null ids first; each ``fanout`` consecutive nodes become their hash until one is left.
    Groups ascend bytewise, the null group first, and their subroots give the root likewise. Repeated rows are leaves beside each other.
    A lone leaf is its subroot, a lone group's subroot the root, and steps may be empty. An empty table gives no row. Of ``docs`` only the named columns are
    read, so others can't clash; empty and long texts are values like others.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))  # orders as the group does, null first
    other = leaf({c: (altered or {}).get(c, v) for c, v in own.items()}) if altered else F.lit(None).cast("string")
    leaves = materialise(docs.select(key.alias("g"), F.col(f"`{id}`").alias("id"), leaf(own).alias("h"), other.alias("other")), "merkle-leaves")
    ranked = with_rank(leaves, ["g", "id", "h"], "rank")
    groups = materialise(ranked.groupBy("g").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    placed = small_or_salted_join(ranked, groups, ["g"], limit=BROADCAST_GROUPS)
    nodes = materialise(placed.select("g", (F.col("rank") - F.col("first")).alias("pos"), "n", F.struct("h", "id", "other").alias("x")), "merkle-nodes")
    pivots, ended = _climb(nodes, fanout, "groups")

    subroots = with_rank(materialise(_tops(ended), "merkle-subroots"), ["g"], "rank")
    count = F.lit(subroots.count()).cast("long")
    upper, roots = _climb(subroots.select(F.lit("").alias("g"), (F.col("rank") - 1).alias("pos"), count.alias("n"), F.struct("h", F.col("g").alias("id")).alias("x")), fanout, "root")
    root = _tops(roots).select("g", F.struct(F.col("h").alias("root"), F.lit(None).cast("string").alias("subroot")).alias("top"), F.array().cast(STEPS).alias("steps"))
    paths = _descend(upper, roots, root, fanout, "root").select(F.col("x.id").alias("g"), F.struct(F.col("top.root").alias("root"), F.col("x.h").alias("subroot")).alias("top"), "steps")
    every = _descend(pivots, ended, materialise(paths, "merkle-paths"), fanout, "groups")
    return every.select(F.col("x.id").alias(id), F.col("x.h").alias("leaf"), F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), "steps", F.col("x.other").alias("altered_leaf"))


def proof_digest(steps: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(steps, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def verify(docs: DataFrame, proofs: DataFrame, *, id: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(id, verified) of each row of ``docs``: whether it gives the root of ``proofs``, rows of manifest() of the table as it was, from its own path.

    Rows with a changed column, an unknown or a null id are not verified; repeated rows all are if one of their id and content was there.
    """
    now = docs.select(F.col(f"`{id}`").alias("id"), leaf({c: F.col(f"`{c}`") for c in columns}).alias("leaf"))
    good = proofs.filter(fold(F.col("leaf"), F.col("steps")) == F.col("root")).select(F.col(f"`{id}`").alias("id"), "leaf", F.lit(True).alias("good")).distinct()
    return now.join(good.hint("merge"), ["id", "leaf"], "left").select(F.col("id").alias(id), F.coalesce("good", F.lit(False)).alias("verified"))
