"""Graphs of transforms: paths to the root, other roots, growth from seeds."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.functions.geometry import Affine
from tesselith.session import ship_package
from tesselith.staging import stage

CELLS = ("a", "b", "c", "d", "tx", "ty")


def to_root(edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, root, a .. ty, hops, cumulative_rms) from edges (node, parent, a .. ty, rms); a root's parent is null.

    Every round each node's known stretch is joined with the stretch of the node it ends at, so stretches double:
    a path of n edges takes about log2(n) rounds, where one edge a round would take n. Nodes on a cycle reach no
    root and are left out once stretches are longer than the number of nodes."""
    zero, one = F.lit(0.0), F.lit(1.0)
    identity = {"a": one, "b": zero, "c": zero, "d": one, "tx": zero, "ty": zero}
    at_root = F.col(parent).isNull()
    known = edges.select(
        F.col(node).alias("node"), F.coalesce(parent, node).alias("end"), at_root.alias("done"), *(F.when(at_root, v).otherwise(F.col(c)).alias(c) for c, v in identity.items()), F.when(at_root, 0).otherwise(1).cast("bigint").alias("hops"), F.when(at_root, zero).otherwise(F.col("rms") * F.col("rms")).alias("square")
    )
    known = stage(known, "stretches")
    total = known.count()
    reach = 1
    while not known.where("not done").isEmpty() and reach <= 2 * total:
        next_ = known.select(F.col("node").alias("end"), F.col("end").alias("n_end"), F.col("done").alias("n_done"), *(F.col(c).alias("n_" + c) for c in CELLS), F.col("hops").alias("n_hops"), F.col("square").alias("n_square"))
        m = Affine.of("n_").after(Affine.of())
        on = known.where("not done").join(next_, "end").select("node", F.col("n_end").alias("end"), F.col("n_done").alias("done"), *m.columns(), (F.col("hops") + F.col("n_hops")).alias("hops"), (F.col("square") + F.col("n_square")).alias("square"))
        known = stage(known.where("done").unionByName(on), "stretches")
        reach *= 2
    return known.where("done").select("node", F.col("end").alias("root"), *CELLS, "hops", F.sqrt("square").alias("cumulative_rms"))


def rebase(paths: DataFrame, new_root: DataFrame) -> DataFrame:
    """Transforms to other roots. ``new_root``: (root, reference), one node of each tree that shall be its root."""
    wanted = new_root.select("root", F.col("reference").alias("node"))
    reference = paths.join(wanted, ["root", "node"]).select("root", F.col("node").alias("reference"), *Affine.of().columns("r_"))
    m = Affine.of("r_").inverse().after(Affine.of())
    return paths.join(reference, "root").select("node", F.col("reference").alias("root"), *m.columns())


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges both ways; the way back has the inverse, and singular ones are left out."""
    sound = edges.where(F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c")) > 1e-12)
    there = sound.select(F.col("node").alias("source"), F.col("parent").alias("target"), *CELLS)
    back = sound.select(F.col("parent").alias("source"), F.col("node").alias("target"), *Affine.of().inverse().columns())
    return there.unionByName(back)


def seed_and_expand(nodes: DataFrame, group: list[str], order: str, seed: str, linked: str) -> DataFrame:
    """``state`` and ``hops``: seeds are direct; a node that links of neighbours in order lead to from a seed is a chain
    of so many hops; others are rejected. ``linked``: whether a node is linked to the one before it.

    Linked nodes without a break are one run; the distance to the nearest seed in it follows from the last seed
    before and the next one after, so no round per hop is needed."""
    w = Window.partitionBy(*group).orderBy(order)
    placed = nodes.withColumn("_place", F.row_number().over(w)).withColumn("_run", F.sum((~F.col(linked)).cast("int")).over(w))
    run = Window.partitionBy(*group, "_run").orderBy("_place")
    seeded = F.when(F.col(seed), F.col("_place"))
    before = F.col("_place") - F.last(seeded, ignorenulls=True).over(run)
    after = F.first(seeded, ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing)) - F.col("_place")
    hops = F.least(before, after)
    return placed.withColumn("hops", hops.cast("bigint")).withColumn("state", F.when(F.col(seed), "master_direct").when(F.col("hops").isNotNull(), "neighbor_chain").otherwise("rejected")).drop("_place", "_run")


#: Places of a block, and how many places around it its task looks at as well.
BLOCK = 8192
HALO = 4096
#: With fewer rounds than this in a pass, a round is a join over all edges instead.
LEAST_ROUNDS = 8


def grow(nodes: DataFrame, edges: DataFrame, most_candidates: int = 3, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """A forest grown from anchors: (batch, node, parent, hops, cumulative_rms); nodes that no accepted edge reaches are left out.

    ``nodes``: batch, node, place, anchor. ``edges``: batch, node, other, rms, works (tried both ways). In a round each node that
    has no parent yet looks at its nearest accepted neighbours (adjacent ones first, then fewer hops, then nearer),
    ``most_candidates`` at most and an anchor always, and takes of the edges that work the one of fewest hops, least
    accumulated error and shortest distance. All batches advance in the same round.

    A chain takes as many rounds as it is long, so a job does many of them: batches are cut into blocks of ``block`` places, a task
    has one of them with the ``halo`` places on either side, and within halo / (the longest edge's places) rounds nothing from further off can
    reach the block. What the block's own nodes find is right; the rest is another task's. Passes go over those blocks only that the one
    before changed something near. Where edges reach too far for that, or nodes lack a place, a round is a job."""
    nodes = stage(nodes, "nodes")
    # Joins with tables that grow are merged: a table that is small on disk may be too large for the driver to broadcast.
    edges = edges.join(nodes.select("batch", "node", "place").hint("merge"), ["batch", "node"])
    edges = stage(edges.join(nodes.select("batch", F.col("node").alias("other"), F.col("place").alias("other_place"), F.col("anchor").alias("other_anchor")).hint("merge"), ["batch", "other"]), "edges")
    tree = nodes.where("anchor").select("batch", "node", F.lit(None).cast(nodes.schema["node"].dataType).alias("parent"), F.lit(0).alias("hops"), F.lit(0.0).alias("square"))
    tree = new = stage(tree, "tree")
    distance = F.abs(F.col("place") - F.col("other_place"))
    reach, unplaced = edges.agg(F.max(distance), F.count_if(distance.isNull())).first()
    rounds = 1 if unplaced else int(halo // max(reach or 1, 1))
    parts = 1
    while not new.isEmpty():
        found = _pass(nodes, edges, tree, new, most_candidates, rounds, block, halo) if rounds >= LEAST_ROUNDS else _round(edges, tree, most_candidates)
        new = stage(found, "new")
        tree, parts = tree.unionByName(new), parts + 1
        if parts % 16 == 0:  # else the plan grows with the rounds
            tree = stage(tree, "tree")
    return tree.select("batch", "node", "parent", "hops", F.sqrt("square").alias("cumulative_rms"))


def _round(edges: DataFrame, tree: DataFrame, most_candidates: int) -> DataFrame:
    """What a single round adds to the tree."""
    accepted = tree.select("batch", F.col("node").alias("other"), F.col("hops").alias("o_hops"), F.col("square").alias("o_square"))
    open_ = edges.join(tree.select("batch", "node").hint("merge"), ["batch", "node"], "left_anti").join(accepted.hint("merge"), ["batch", "other"])
    distance = F.abs(F.col("place") - F.col("other_place"))
    w = Window.partitionBy("batch", "node")
    looked = open_.withColumn("distance", distance).withColumn("k", F.row_number().over(w.orderBy((F.col("distance") > 1).cast("int"), "o_hops", "distance", "other"))).where((F.col("k") <= most_candidates) | F.col("other_anchor"))
    square = F.col("o_square") + F.col("rms") * F.col("rms")
    best = looked.where("works").groupBy("batch", "node").agg(F.min(F.struct((F.col("o_hops") + 1).alias("hops"), square.alias("square"), "distance", F.col("other").alias("parent"))).alias("b"))
    return best.select("batch", "node", "b.parent", "b.hops", "b.square")


def _pass(nodes: DataFrame, edges: DataFrame, tree: DataFrame, new: DataFrame, most_candidates: int, rounds: int, block: int, halo: int) -> DataFrame:
    """What so many rounds add to the tree, block by block; ``new``: what the pass before added."""
    first, last = (F.floor((F.col("place") + i) / block).cast("bigint") for i in (-halo, halo))
    near = F.explode(F.sequence(first, last)).alias("block")
    changed = new.join(nodes.select("batch", "node", "place").hint("merge"), ["batch", "node"]).select("batch", near).distinct()
    accepted = lambda n, p: tree.select("batch", F.col("node").alias(n), F.col("hops").alias(f"{p}hops"), F.col("square").alias(f"{p}square")).hint("merge")
    known = edges.join(accepted("node", ""), ["batch", "node"], "left").join(accepted("other", "o_"), ["batch", "other"], "left")
    rows = known.select("batch", near, "node", "place", "other", "other_place", "rms", "works", "other_anchor", F.col("hops").isNotNull().alias("done"), "o_hops", "o_square").join(changed.hint("merge"), ["batch", "block"], "left_semi")
    ship_package(edges.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema if f.name in ("batch", "node")}
    schema = f"batch {kinds['batch']}, node {kinds['node']}, parent {kinds['node']}, hops int, square double"
    return rows.groupBy("batch", "block").applyInArrow(lambda key, table: _grow_block(key, table, most_candidates, rounds, block), schema)


def _grow_block(key: tuple, table: pa.Table, most_candidates: int, rounds: int, block: int) -> pa.Table:
    """Rounds over the edges of one block and its halo: a node is looked at again only after one of its neighbours was accepted."""
    number = key[1].as_py()
    around: dict = {}
    listeners: dict = {}
    accepted: dict = {}
    due: set = set()
    done: set = set()
    own: set = set()
    for e in table.select(["node", "place", "other", "other_place", "rms", "works", "other_anchor", "done", "o_hops", "o_square"]).to_batches():
        for node, place, other, other_place, rms, works, anchor, is_done, hops, square in zip(*(c.to_pylist() for c in e.columns), strict=True):
            if hops is not None:
                accepted[other] = (hops, square)
            if is_done:
                done.add(node)
                continue
            around.setdefault(node, []).append((abs(place - other_place), other, rms, works, anchor))
            listeners.setdefault(other, []).append(node)
            if place // block == number:
                own.add(node)
            if hops is not None:
                due.add(node)
    found = {}
    for _ in range(rounds):
        taken = {}
        for node in due:
            seen = sorted((((d > 1, accepted[o][0], d, o), o, rms, works, anchor) for d, o, rms, works, anchor in around[node] if o in accepted), key=lambda s: s[0])
            best = None
            for k, ((_far, hops, distance, _o), other, rms, works, anchor) in enumerate(seen):
                if works and (k < most_candidates or anchor):
                    square = None if rms is None or accepted[other][1] is None else accepted[other][1] + rms * rms
                    # As Spark sorts: null before all numbers, NaN after them.
                    option = (hops + 1, square is not None, square is not None and math.isnan(square), square if square is not None and not math.isnan(square) else 0.0, distance, other, square)
                    best = option if best is None or option[:6] < best[:6] else best
            if best:
                taken[node] = (best[5], best[0], best[6])
        if not taken:
            break
        accepted.update((n, (hops, square)) for n, (_, hops, square) in taken.items())
        found.update(taken)
        due = {n for new in taken for n in listeners.get(new, ()) if n not in accepted}
    names = [n for n in found if n in own]
    kind = table.schema.field("node").type
    columns = [pa.array([key[0].as_py()] * len(names), table.schema.field("batch").type), pa.array(names, kind)]
    columns += [pa.array([found[n][i] for n in names], t) for i, t in enumerate((kind, pa.int32(), pa.float64()))]
    return pa.table(columns, ["batch", "node", "parent", "hops", "square"])


def probe_distance(one: Affine, other: Affine, points: tuple[tuple[float, float], ...]) -> Column:
    """The root of the mean squared distance between where two transforms take the points."""
    squares = []
    for x, y in points:
        ax, ay = one.apply(F.lit(x), F.lit(y))
        bx, by = other.apply(F.lit(x), F.lit(y))
        squares.append((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    return F.sqrt(sum(squares[1:], squares[0]) / len(points))


def matrix_distance(one: Affine, other: Affine) -> Column:
    """The root of the mean squared difference of the cells of the 3 x 3 matrices."""
    cells = [(getattr(one, c) - getattr(other, c)) for c in CELLS]
    return F.sqrt(sum((c * c for c in cells[1:]), cells[0] * cells[0]) / 9)
