"""Registration of a batch's frames with each other: a chain along the sequence, or a tree grown from the anchor.

Both decide in order, and what they decide tells which pairs of frames are tried
next: the last frame that was accepted, the accepted neighbours with the fewest
hops, the recent motion that a new one has to keep to. What is costly, matching
the stars of two frames, doesn't depend on that order. So work goes in rounds over
all batches at once:

* A pass streams the frames of each batch in order through a small state (the last
  accepted frames and motions) and decides as long as it knows the pairs it needs. Where
  one is missing it asks for it, goes on as if it had an answer, and asks for what it
  would need then.
* All pairs asked for are then matched, each a row of two frames' stars, wherever the
  cluster has room; the pass starts again with all results.

Only decisions that rest on known pairs count, so the guesses save rounds and change
nothing. A frame's stars, and what was tried for a frame, are bounded (by the
detector's limit and by the number of candidates); a batch is never held as a whole.

Frames: (batch, place, stars, anchor) and, if there are any, ``image`` (an array of ``height`` x
``width`` numbers); ``stars`` is an array of (x, y, flux). ``place`` is the position in
the sequence. Defined results: of frames of equal batch and place one is taken; a
frame without batch or place is left out; null stars are none; a batch
without an anchor, or whose anchor has too few stars, has no rows; of several
anchors the first in place counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.functions.geometry import NO_RMS, Affine, Limits, validation
from tesselith.operators.kernels import hull_area, ransac, sub_pixel_shift
from tesselith.session import ship_package
from tesselith.staging import stage

CELLS = ("a", "b", "c", "d", "tx", "ty")
MEASURES = ("matches", "inliers", "ratio", "rms", "spatial", "response")
PAIRS_OF_A_TASK = 500
_PAIR = ", ".join(("matches int, inliers int", *(f"{c} double" for c in ("ratio", "rms", "spatial", "response", *CELLS))))
RESULT = f"batch bigint, place int, reference int, wide boolean, {_PAIR}"
_TRIED = f"reference:int,primary:boolean,method:string,reason:string,{_PAIR.replace(' ', ':').replace(',:', ',')}"
DECISION = (
    f"batch bigint, place int, state string, parent int, method string, reason string, hops int, {_PAIR}, "
    + ", ".join(f"m_{c} double" for c in CELLS)
    + f", cumulative_rms double, consistent boolean, wanted array<int>, sure boolean, tried array<struct<{_TRIED}>>, motions array<struct<direction:int,tx:double,ty:double,rotation:double>>"
)


@dataclass(frozen=True)
class Flow:
    """How frames are matched and what an edge must meet. ``radius`` is the first attempt's, the second has twice that."""

    height: int
    width: int
    radius: float = 25.0
    threshold: float = 4.0
    fewest: int = 4
    limits: Limits = field(default_factory=Limits)
    shift: float = 120.0
    rotation: float = 2.0
    least_motions: int = 4
    most_motions: int = 8
    window: int = 4
    candidates: int = 3
    #: Side of the map that a frame's stars make where it has no image.
    map_side: int = 128


# --- One pair of frames


def star_map(stars: np.ndarray, flow: Flow) -> np.ndarray:
    """The stars (x, y, flux) as a small image, each shared between the four cells around it."""
    side = flow.map_side
    out = np.zeros((side + 1, side + 1))
    x, y = stars[:, 0] * side / flow.width, stars[:, 1] * side / flow.height
    inside = (x >= 0) & (y >= 0) & (x < side) & (y < side)
    x, y, light = x[inside], y[inside], np.sqrt(np.maximum(stars[inside, 2], 0)) + 1
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - i, x - j
    for di, wy in ((0, 1 - fy), (1, fy)):
        for dj, wx in ((0, 1 - fx), (1, fx)):
            np.add.at(out, (i + di, j + dj), light * wy * wx)
    return out[:side, :side]


def nearest_pairs(reference: np.ndarray, target: np.ndarray, shift: tuple[float, float], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of stars that belong together: each shifted target's nearest reference within the radius, and of several targets of one reference the nearest (then the first)."""
    if not len(reference) or not len(target):
        return np.zeros(0, int), np.zeros(0, int)
    moved = target[:, :2] + np.array(shift)
    ways = np.hypot(moved[:, None, 0] - reference[None, :, 0], moved[:, None, 1] - reference[None, :, 1])
    near = ways.argmin(axis=1)
    way = ways[np.arange(len(target)), near]
    order = np.argsort(way, kind="stable")
    order = order[way[order] < radius]
    _, first = np.unique(near[order], return_index=True)
    taken = order[np.sort(first)]
    return near[taken], taken


def match(reference: np.ndarray, target: np.ndarray, shift: tuple[float, float], response: float, radius: float, flow: Flow) -> dict:
    """The similarity that takes the target's stars to the reference's, and its measures; cells are null where there is none."""
    r, t = nearest_pairs(reference, target, shift, radius)
    out = {"matches": len(r), "inliers": 0, "ratio": 0.0, "rms": NO_RMS, "spatial": 0.0, "response": response} | dict.fromkeys(CELLS)
    if len(r) < flow.fewest:
        return out
    p, q = target[t, :2], reference[r, :2]
    found = ransac(p, q, flow.threshold)
    if found is None or not found[1].any():
        return out
    m, fits = found
    moved = p @ m[:, :2].T + m[:, 2]
    error = np.hypot(*(moved - q)[fits].T)
    area = min(hull_area(moved[fits]) / (flow.height * flow.width), 1.0)
    return out | {"inliers": int(fits.sum()), "ratio": float(fits.mean()), "rms": float(np.sqrt((error**2).mean())), "spatial": area} | dict(zip(CELLS, map(float, (*m[0, :2], *m[1, :2], m[0, 2], m[1, 2])), strict=True))


def pair(reference: dict, target: dict, flow: Flow) -> list[dict]:
    """Both attempts for two frames (``stars`` and perhaps ``image``): within the radius, and within twice the radius."""
    stars = [np.array([(s["x"], s["y"], s["flux"]) for s in f["stars"] or []], float).reshape(-1, 3) for f in (reference, target)]
    if reference.get("image") is not None and target.get("image") is not None:
        images = [np.asarray(f["image"], float).reshape(flow.height, flow.width) for f in (reference, target)]
        scale = (1.0, 1.0)
    else:
        images, scale = [star_map(s, flow) for s in stars], (flow.height / flow.map_side, flow.width / flow.map_side)
    dy, dx, response = sub_pixel_shift(images[1], images[0])
    return [{"wide": wide} | match(*stars, (dx * scale[1], dy * scale[0]), response, flow.radius * (2 if wide else 1), flow) for wide in (False, True)]


def match_pairs(wanted: DataFrame, frames: DataFrame, flow: Flow) -> DataFrame:
    """Rows of RESULT with ``status`` for pairs (batch, place, reference) of ``frames``."""
    has_image = "image" in frames.columns
    content = [c for c in ("stars", "image") if c in frames.columns]
    side = lambda key, name: frames.select("batch", F.col("place").alias(key), F.struct(*content).alias(name))
    rows = wanted.join(side("place", "target_frame"), ["batch", "place"]).join(side("reference", "reference_frame"), ["batch", "reference"])
    columns = ["batch", "place", "reference", "wide", *MEASURES, *CELLS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16 if has_image else 256):
                out = []
                for row in whole.slice(at, 16 if has_image else 256).to_pylist():
                    out += [{k: row[k] for k in ("batch", "place", "reference")} | found for found in pair(row["reference_frame"], row["target_frame"], flow)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(columns, _types(columns), strict=True)], names=columns)

    # Small rows with much to do: they are dealt by number, not by size.
    tasks = max(frames.sparkSession.sparkContext.defaultParallelism, -(-wanted.count() // PAIRS_OF_A_TASK))
    rows = rows.select("batch", "place", "reference", "target_frame", "reference_frame").repartition(tasks)
    found = rows.mapInArrow(run, RESULT)
    return found.withColumn("status", validation(F.col("matches"), F.col("inliers"), F.col("rms"), Affine.of(), flow.limits))


def _types(names: list[str]) -> list[pa.DataType]:
    kinds = {"batch": pa.int64(), "wide": pa.bool_()} | dict.fromkeys(("place", "reference", "matches", "inliers"), pa.int32())
    return [kinds.get(n, pa.float64()) for n in names]


# --- Decisions in order


def rotation(m: dict) -> float:
    return math.degrees(math.atan2(m["c"], m["a"]))


def median(values: list[float]) -> float:
    ordered, half = sorted(values), len(values) // 2
    return ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2


def composed(parent: tuple, m: dict) -> tuple:
    """The cells of ``m`` and then the parent's."""
    a, b, c, d, tx, ty = parent
    return (a * m["a"] + b * m["c"], a * m["b"] + b * m["d"], c * m["a"] + d * m["c"], c * m["b"] + d * m["d"], a * m["tx"] + b * m["ty"] + tx, c * m["tx"] + d * m["ty"] + ty)


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def keeps_motion(m: dict, recent: list[tuple], flow: Flow, gap: int = 1) -> bool:
    """Whether a transform is near the median of the recent motions (tx, ty, rotation), if there are enough of them."""
    if len(recent) < flow.least_motions:
        return True
    usual = [median([r[i] for r in recent]) for i in range(3)]
    gap = max(1, gap)
    return abs(m["tx"] - usual[0]) <= flow.shift * gap and abs(m["ty"] - usual[1]) <= flow.shift * gap and abs(rotation(m) - usual[2]) <= flow.rotation * gap


def best_of(attempts: list[tuple[str, dict]], passes: Callable[[str, dict], bool]) -> tuple[str | None, dict]:
    """The first attempt (name, result) that is accepted and passes, or none and the failed one of most inliers, then least residual."""
    worst = {"matches": 0, "inliers": 0, "ratio": 0.0, "rms": NO_RMS, "spatial": 0.0, "response": 0.0} | dict.fromkeys(CELLS)
    failed = worst | {"reason": "phase_correlation_failed"}
    for name, result in attempts:
        good = result["status"] == "accepted"
        if good and passes(name, result):
            return name, result
        if (-result["inliers"], result["rms"]) < (-failed["inliers"], failed["rms"]):
            failed = result | {"reason": "temporal_validation_failed" if good else result["status"]} | dict.fromkeys(CELLS)
    return None, failed


def _decision(row: dict, state: str, **values) -> dict:
    return {"batch": row["batch"], "place": row["place"], "state": state, **values}


def _accepted(row: dict, parent: int, parent_entry: tuple, method: str, result: dict, **values) -> tuple[dict, tuple]:
    """The decision, and the entry (hops, cells, cumulative residual) of the frame."""
    hops, cells, before = parent_entry
    entry = (hops + 1, composed(cells, result), math.hypot(before, result["rms"]))
    measured = {k: result[k] for k in (*MEASURES, *CELLS)}
    return _decision(row, "accepted", parent=parent, method=method, hops=entry[0], cumulative_rms=entry[2], **measured, **{f"m_{c}": v for c, v in zip(CELLS, entry[1], strict=True)}, **values), entry


class Chain:
    """Each frame against the last accepted one, in both radii, then against the anchor; the anchor itself is passed over."""

    def __init__(self, flow: Flow, row: dict) -> None:
        self.flow, self.anchor = flow, row["anchor_place"]
        self.previous, self.entry = self.anchor, (0, IDENTITY, 0.0)
        self.recent: list[tuple] = []
        self.sure, self.lost, self.ahead, self.asked_from = True, 0, 0, self.anchor

    def step(self, row: dict) -> dict:
        if row["few"]:
            return _decision(row, "rejected", reason="insufficient_stars_or_error", sure=self.sure)
        known = {(r["reference"], r["wide"]): r for r in row["results"] or []}
        wanted = set()
        if self.ahead > 0:  # a run of lost frames may go on
            self.ahead -= 1
            wanted |= {self.asked_from, self.anchor}
        attempts = [("normal", self.previous, False), ("relaxed_radius", self.previous, True)]
        if self.previous != self.anchor:
            attempts.append(("anchor", self.anchor, True))
        passes = lambda name, m: name == "anchor" or keeps_motion(m, self.recent, self.flow)
        there = [(name, known[r, wide]) for name, r, wide in attempts if (r, wide) in known]
        method, result = best_of(there, passes)
        missing = next((r for name, r, wide in attempts if (r, wide) not in known), None)
        if missing is not None and (method is None or method == "anchor" and missing == self.previous):
            wanted.add(missing)
            if self.sure:
                self.sure, self.ahead, self.asked_from = False, 2 * self.lost, self.previous
            if missing == self.previous and not self.ahead:  # it is taken for accepted, else for lost
                self.previous = row["place"]
            return self._out(_decision(row, "open"), wanted, known)
        if method is None:
            self.lost += 1
            return self._out(_decision(row, "rejected", **{k: result[k] for k in ("reason", *MEASURES)}), wanted, known)
        parent = self.anchor if method == "anchor" else self.previous
        out, self.entry_of_row = _accepted(row, parent, self.entry if method != "anchor" else (0, IDENTITY, 0.0), method, result)
        self.previous, self.entry, self.lost = row["place"], self.entry_of_row, 0
        if method != "anchor":
            self.recent = [*self.recent, (result["tx"], result["ty"], rotation(result))][-self.flow.most_motions :]
        return self._out(out, wanted, known)

    def _out(self, decision: dict, wanted: set, known: dict) -> dict:
        place = decision["place"]
        return decision | {"wanted": sorted(r for r in wanted if r != place and (r, False) not in known), "sure": self.sure}

    def end(self) -> list[dict]:
        return []


class Tree:
    """One pass over the frames that aren't settled, from the anchor outwards: each against its nearest accepted neighbours.

    ``around`` has a row's accepted neighbours of earlier passes, ``tried`` what was tried in them: the outcome of an edge is kept."""

    def __init__(self, flow: Flow, row: dict) -> None:
        self.flow, self.anchor = flow, row["anchor_place"]
        self.near: dict[int, tuple] = {}
        self.recent = {side: [(m["tx"], m["ty"], m["rotation"]) for m in row["motions"] or [] if m["direction"] == side] for side in (-1, 1)}
        self.batch, self.sure = row["batch"], True

    def candidates(self, row: dict) -> list[tuple[int, tuple]]:
        place, window = row["place"], self.flow.window
        reach = abs(place - self.anchor)
        self.near = {p: e for p, e in self.near.items() if abs(p - self.anchor) >= reach - window}
        every = {n["place"]: (n["hops"], tuple(n[f"m_{c}"] for c in CELLS), n["cumulative_rms"]) for n in row["around"] or []} | self.near
        every = {p: e for p, e in every.items() if abs(p - place) <= window} | {self.anchor: (0, IDENTITY, 0.0)}
        order = sorted(every, key=lambda p: (abs(p - place) != 1, every[p][0], abs(p - place), p))
        most = max(2, self.flow.candidates)
        chosen = order[:most]
        if self.anchor not in chosen:
            chosen[-1] = self.anchor
        return [(p, every[p]) for p in chosen]

    def step(self, row: dict) -> dict:
        if row["few"]:
            return _decision(row, "rejected", reason="insufficient_stars_or_error", sure=self.sure)
        place, flow = row["place"], self.flow
        known = {(r["reference"], r["wide"]): r for r in row["results"] or []}
        tried = {(t["reference"], t["primary"]): t for t in row["tried"] or []}
        wanted, works, failed = [], [], None
        candidates = self.candidates(row)
        for i, (parent, entry) in enumerate(candidates):
            outcome = tried.get((parent, i == 0))
            if outcome is None:
                if (parent, True) not in known:
                    wanted.append(parent)
                    continue
                names = [("normal", False), ("relaxed_radius", True)] if i == 0 else [("anchor" if parent == self.anchor else "neighbor", True)]
                gap, recent = abs(place - parent), self.recent[1 if place > parent else -1]
                method, result = best_of([(n, known[parent, w]) for n, w in names], lambda _, m: keeps_motion(m, recent, flow, gap))  # noqa: B023
                outcome = {k: result[k] for k in (*MEASURES, *CELLS)} | {"reference": parent, "primary": i == 0, "method": method, "reason": None if method else result["reason"]}
                if self.sure:
                    tried[parent, i == 0] = outcome
            if outcome["method"] is None:
                failed = outcome
            else:
                hops, cells, before = entry
                works.append(((hops + 1, math.hypot(before, outcome["rms"]), abs(place - parent), parent), entry, outcome))
        if wanted:
            self.sure = False
            first = candidates[0][1]
            self.near[place] = (first[0] + 1, first[1], first[2])
        values = {"wanted": wanted, "sure": self.sure, "tried": list(tried.values())}
        if wanted or not works:
            why = {k: failed[k] for k in ("reason", *MEASURES)} if failed else {}
            return _decision(row, "open", **why, **values)
        works.sort(key=lambda w: w[0])
        (_, _, _, parent), entry, result = works[0]
        out, own = _accepted(row, parent, entry, result["method"], result, **values)
        out["consistent"] = all(self.apart(own[1], composed(e[1], r)) <= flow.threshold for _, e, r in works[1:])
        self.near[place] = own
        if result["method"] != "anchor":
            side = 1 if place > parent else -1
            self.recent[side] = [*self.recent[side], (result["tx"], result["ty"], rotation(result))][-flow.most_motions :]
        return out

    def apart(self, one: tuple, other: tuple) -> float:
        """The root of the mean squared difference of where both take the corners and the middle of a frame."""
        h, w = self.flow.height, self.flow.width
        points = ((0, 0), (max(0, w - 1), 0), (0, max(0, h - 1)), (max(0, w - 1), max(0, h - 1)), (w / 2, h / 2))
        a, b, c, d, tx, ty = (x - y for x, y in zip(one, other, strict=True))
        return math.sqrt(sum((a * x + b * y + tx) ** 2 + (c * x + d * y + ty) ** 2 for x, y in points) / 10)

    def end(self) -> list[dict]:
        motions = [{"direction": s, "tx": m[0], "ty": m[1], "rotation": m[2]} for s in (-1, 1) for m in self.recent[s]]
        return [{"batch": self.batch, "state": "motions", "sure": self.sure, "motions": motions, "wanted": []}]


def _decide(rows: DataFrame, order: str, walk: type, flow: Flow) -> DataFrame:
    """Stream each batch's rows in ``order`` through the walk, to rows of DECISION."""
    fields = [f.strip().split(" ")[0] for f in DECISION.split(", ")]
    schema = rows.sparkSession.createDataFrame([], DECISION).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for whole in batches:
            out = []
            for row in whole.to_pylist():
                if state is None or row["batch"] != at:
                    out += state.end() if state else []
                    at, state = row["batch"], walk(flow, row)
                out.append(state.step(row))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in out], arrow.field(f).type) for f in fields], names=fields)
        if state and (out := state.end()):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in out], arrow.field(f).type) for f in fields], names=fields)

    return rows.repartition("batch").sortWithinPartitions("batch", order, "place").mapInArrow(run, schema)


def _prepared(frames: DataFrame, flow: Flow) -> tuple[DataFrame, DataFrame]:
    """Frames as they are joined, and a light row for each: batch, place, few (stars), anchor_place, away (from the anchor)."""
    content = [c for c in ("stars", "image") if c in frames.columns]
    each = frames.where("batch IS NOT NULL AND place IS NOT NULL").select(F.col("batch").cast("bigint").alias("batch"), F.col("place").cast("int").alias("place"), F.coalesce("anchor", F.lit(False)).alias("anchor"), *content)
    each = stage(each.dropDuplicates(["batch", "place"]), "frames")
    few = F.coalesce(F.size("stars"), F.lit(0)) < flow.fewest
    light = each.select("batch", "place", "anchor", few.alias("few"))
    anchors = light.where("anchor").groupBy("batch").agg(F.min(F.struct("place", "few")).alias("a")).where("NOT a.few").select("batch", F.col("a.place").alias("anchor_place"))
    light = light.drop("anchor").join(anchors, "batch").withColumn("away", F.abs(F.col("place") - F.col("anchor_place")))
    return each, stage(light, "light")


def _rounds(rows: DataFrame, results: DataFrame | None, frames: DataFrame, order: str, walk: type, flow: Flow) -> tuple[DataFrame, DataFrame | None]:
    """Decide and match until no batch waits for a pair: the decisions, and all results so far."""
    while True:
        if results is None:
            asked = rows.withColumn("results", F.lit(None).cast("array<int>"))
        else:  # a frame has few results: those of its candidates
            kept = results.select("batch", "place", F.struct(*(c for c in results.columns if c not in ("batch", "place"))).alias("r"))
            asked = rows.join(kept.groupBy("batch", "place").agg(F.collect_list("r").alias("results")), ["batch", "place"], "left")
        decided = stage(_decide(asked, order, walk, flow), "decided")
        if decided.where("NOT sure").isEmpty():
            return decided, results
        wanted = stage(decided.select("batch", "place", F.explode("wanted").alias("reference")).distinct(), "wanted")
        fresh = stage(match_pairs(wanted, frames, flow), "results")
        results = fresh if results is None else results.unionByName(fresh)


OUT = ["batch", "place", "state", "parent", "method", "reason", "hops", *MEASURES, *CELLS, *(f"m_{c}" for c in CELLS), "cumulative_rms"]


def _with_anchors(decided: DataFrame, light: DataFrame, extra: list[str]) -> DataFrame:
    """The decisions and the anchors' own rows, which are identities."""
    own = {"state": F.lit("accepted"), "method": F.lit("reference"), "hops": F.lit(0), "rms": F.lit(0.0), "cumulative_rms": F.lit(0.0), "consistent": F.lit(True)}
    own |= {p + c: F.lit(v) for p in ("", "m_") for c, v in zip(CELLS, IDENTITY, strict=True)}
    anchors = light.where("place = anchor_place").select("batch", "place", *(own.get(c, F.lit(None)).alias(c) for c in [*OUT[2:], *extra]))
    return decided.select(*OUT, *extra).unionByName(anchors)


def chain(frames: DataFrame, flow: Flow) -> DataFrame:
    """(batch, place, state, parent, method, reason, hops, measures, a .. ty, m_a .. m_ty, cumulative_rms): each frame against the last accepted one.

    A frame is ``accepted`` by the method ``normal``, ``relaxed_radius`` or ``anchor``, or ``rejected`` for a reason; the anchor is the
    ``reference``. a .. ty take it to its parent, m_a .. m_ty to the anchor. The motion must keep to the median of the last accepted ones."""
    ship_package(frames.sparkSession)
    each, light = _prepared(frames, flow)
    decided, _ = _rounds(light.where("place <> anchor_place"), None, each, "place", Chain, flow)
    return _with_anchors(decided, light, [])


def tree(frames: DataFrame, flow: Flow) -> DataFrame:
    """The columns of ``chain`` and ``consistent``: a tree that grows from the anchor by making edges to accepted neighbours.

    In a pass, frames are visited from the anchor outwards; each tries its first candidate in both radii (``normal``, ``relaxed_radius``) and
    the others in the wider one (``neighbor``, ``anchor``), and takes the edge of fewest hops, least accumulated residual and
    shortest way. Motions are held against the accepted ones of the same direction. Frames that stay open are visited again while a pass
    settles any. ``consistent``: the other edges that work lead to the same place."""
    spark = frames.sparkSession
    ship_package(spark)
    each, light = _prepared(frames, flow)
    open_ = light.where("place <> anchor_place").withColumns({"around": F.lit(None).cast("array<int>"), "tried": F.lit(None).cast("array<int>"), "motions": F.lit(None).cast("array<int>")})
    settled, results, last = None, None, None
    while True:
        decided, results = _rounds(open_, results, each, "away", Tree, flow)
        done = decided.where("state IN ('accepted', 'rejected')")
        settled = done if settled is None else settled.unionByName(done)
        last = decided.where("state = 'open'")
        if done.isEmpty() or last.isEmpty():
            break
        # Batches without progress stay as they are; the others' open frames look at what was accepted around them.
        moved = done.select("batch").distinct()
        still = last.join(moved, "batch", "left_semi")
        if still.isEmpty():
            break
        settled_here = last.join(moved, "batch", "left_anti")
        near = settled.where("state = 'accepted'").select("batch", F.struct("place", "hops", *(f"m_{c}" for c in CELLS), "cumulative_rms").alias("n"))
        looks = near.withColumn("place", F.explode(F.sequence(F.col("n.place") - flow.window, F.col("n.place") + flow.window)))
        around = still.select("batch", "place").join(looks, ["batch", "place"]).groupBy("batch", "place").agg(F.collect_list("n").alias("around"))
        motions = decided.where("state = 'motions'").select("batch", "motions")
        open_ = stage(light.join(still.select("batch", "place", "tried"), ["batch", "place"]).join(around, ["batch", "place"], "left").join(motions, "batch"), "open")
        settled = settled.unionByName(settled_here.withColumn("state", F.lit("rejected")).withColumn("reason", F.coalesce("reason", F.lit("disconnected_from_reference"))))
        last = None
    if last is not None:
        settled = settled.unionByName(last.withColumn("state", F.lit("rejected")).withColumn("reason", F.coalesce("reason", F.lit("disconnected_from_reference"))))
    return _with_anchors(settled, light, ["consistent"])
