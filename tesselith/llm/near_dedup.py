"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

A text is the weighted set of its five-word shingles; a shingle's weight is one
plus the logarithm of its count. ProbMinHash gives each shingle a Poisson
process of arrivals at components of the signature, with a rate in proportion
to the weight; a component keeps the shingle that arrives first, and a shingle
stops as soon as its next arrival is later than the latest first arrival of the
text. Two texts agree in a component with the probability Jaccard similarity of
their weighted shingles, which for equal weights is the plain Jaccard
similarity. Links are verified by the plain one, which may be high where the
weighted one is low, so each text is signed with equal weights, and one that
repeats shingles by its weights as well, into the same buckets. Texts that agree
in all components of a band are compared exactly: they are linked if the Jaccard
similarity of their shingles is at least the threshold, and a class is what
links connect.

No bucket is expanded into its pairs. Each member is first compared with the
bucket's most central text (the one that shares most buckets with others), then
with a random member unless they are in one class by then. What may still link different classes within a bucket is found by a
prefix join: of two texts with enough shingles in common, the rarest few of
each, so many as their sizes allow to be missing, have one in common. Shingles are
ranked by how many of these texts have them, and those of one text alone take up
room in its prefix without a row in the join, so a shingle that very many texts
share is joined only for texts with next to nothing of their own. Pairs
within one class are never made there, so no link between classes is lost and
a large class costs no more than its number of texts.

Texts are read twice and not shuffled: once to sign them, and once to take the
shingles of those in shared buckets, which a bitmap of their ids picks out. Only
these shingles, as hashes, go through the joins of the comparisons.

Defined results: null and empty texts, and others without words, have no
shingles and are only in a class with equal texts; texts of fewer than five
words have one shingle; equal texts are always in one class; a repeated row
gets its own result row, and one of its copies is ``kept``; different texts of one
doc_id are in one class and stay or go together; rows without a doc_id are kept apart, each as a class
without id; other columns are not read by the operator and carried along by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm import words as W
from tesselith.session import ship_package
from tesselith.staging import stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 20
BAND_ROWS = 4
#: Bits of the map of ids whose shingles are taken: at most 2**20 rows of 64 bits. A fuller map lets more texts through.
MEMBER_BITS = 1 << 26
#: Sizes of one class in the prefix join are within this ratio.
SIZE_RATIO = 1.03


def weighted(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, their weights, and their places."""
    found, at = W.shingles(*W.hashes(column), size)
    keys, counts, lengths = [], [], np.zeros(len(at), np.int64)
    for d in range(len(at) - 1):
        own = np.sort(found[at[d] : at[d + 1]])
        if len(own):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            keys.append(own[first])
            counts.append(np.diff(np.append(first, len(own))))
            lengths[d + 1] = len(first)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0), np.cumsum(lengths)
    return np.concatenate(keys), 1 + np.log(np.concatenate(counts)), np.cumsum(lengths)


def signatures(keys: np.ndarray, weights: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash signatures, one row per text; zeros for a text without shingles."""
    n = len(at) - 1
    first = np.full(n * m, np.inf)
    signature = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    text = np.repeat(np.arange(n), np.diff(at))
    key, rate, time = keys, weights, np.zeros(len(keys))
    turn = 0
    while len(key):
        turn += 1
        drawn = W.mix(key + W.U(turn * 0xA0761D6478BD642F % (1 << 64)))
        time = time - np.log(((drawn >> W.U(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
        alive = time <= latest[text]
        key, rate, time, text, drawn = key[alive], rate[alive], time[alive], text[alive], drawn[alive]
        slot = text * m + (W.mix(drawn) % W.U(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        best = time == first[slot]
        signature[slot[best]] = key[best]
        some = np.unique(text)
        latest[some] = first.reshape(n, m)[some].max(axis=1)
    return signature.reshape(n, m)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of keys."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if common else 0.0


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The similarity that signatures estimate, of two weighted sets, each as sorted keys and weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    p, q = a[1] / a[1].sum(), b[1] / b[1].sum()
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    ratio = p[i] / q[j]
    order = np.argsort(ratio)
    ratio, pc, qc = ratio[order], p[i][order], q[j][order]
    # For a common key d: the sum over all keys of max(p/p_d, q/q_d). Keys of a alone count p/p_d, of b alone q/q_d,
    # common ones count p/p_d where their ratio is at least d's, q/q_d where it is less.
    above = np.cumsum(pc[::-1])[::-1] + (1 - pc.sum())
    below = np.concatenate([[0.0], np.cumsum(qc)[:-1]]) + (1 - qc.sum())
    return float((1 / (np.maximum(above, 0) / pc + np.maximum(below, 0) / qc)).sum())


def band_buckets(keys: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The buckets of each text, one row per text."""
    n = len(at) - 1
    bands = signatures(keys, weights, at, BANDS * BAND_ROWS).reshape(n, BANDS, BAND_ROWS)
    bucket = np.tile(W.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * W.U(0x9E6C63D0876A9A47)), (n, 1))
    for k in range(BAND_ROWS):
        bucket = W.mix(bucket * W.U(3) + bands[:, :, k])
    return bucket


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.pieces(batch):
            keys, weights, at = weighted(part.column("text"), SHINGLE_WORDS)
            lengths = np.diff(at)
            # Where no shingle is repeated, the two signatures are the same.
            text = np.repeat(np.arange(part.num_rows), lengths)
            repeats = np.bincount(text[weights > 1], minlength=part.num_rows) > 0
            own = repeats[text]
            equal = band_buckets(keys, np.ones(len(keys)), at)
            by_weight = np.zeros_like(equal)
            by_weight[repeats] = band_buckets(keys[own], weights[own], np.concatenate([[0], np.cumsum(lengths[repeats])]))
            made = np.repeat((lengths > 0)[:, None], 2 * BANDS, axis=1)
            made[:, BANDS:] &= repeats[:, None]
            offsets = np.concatenate([[0], np.cumsum(made.sum(axis=1))]).astype(np.int32)
            bucket = np.concatenate([equal, by_weight], axis=1)[made]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), lists], names=["doc_id", "h", "buckets"])


def _keys(column: pa.Array) -> list[np.ndarray]:
    """The shingles of each row of a list column."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[low:high] for low, high in zip(offsets[:-1], offsets[1:])]


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.pieces(batch):
            keys, _, at = weighted(part.column("text"), SHINGLE_WORDS)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(_keys(batch.column("a_shingles")), _keys(batch.column("b_shingles")), strict=True)
        close = np.array([similarity(x, y) for x, y in sets], np.float64)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(close)], names=["a", "b", "similarity"])


def shingle_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the texts whose id is in ``ids``, and of a few others. Nothing but the ids is shuffled."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MEMBER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    map_ = stage(ids.select(F.floor(place / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "map")
    some = texts.withColumn("word", F.floor(place / 64)).join(F.broadcast(map_), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return stage(some.select("doc_id", W.plain(F.col("text")).alias("text")).mapInArrow(_shingle_sets, "doc_id bigint, shingles array<bigint>"), "shingles")


def _size_class(size: float) -> int:
    return int(np.floor(np.log(size) / np.log(SIZE_RATIO) + 1e-9))


def prefixes(shared: np.ndarray, size: int, threshold: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The join keys of one text's rarest shingles, as the smaller and as the larger of a pair.

    ``shared``: those of its ``size`` shingles that other texts have, rarest first; its own alone come before them.
    Texts of sizes s and n, s at most n, with similarity t have at least t / (1 + t) * (s + n) shingles in
    common, so the first common one, in any order that all texts use, is among the first n - that + 1 of the larger.
    As the smaller, n is taken as s; as the larger, each class of smaller sizes gets its own keys."""
    mark = lambda some, k: W.mix(some + W.U((k + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
    first = lambda other: shared[: max(0, size - int(np.ceil(threshold / (1 + threshold) * (size + other) - 1e-6)) + 1 - (size - len(shared)))]
    smaller = [mark(first(size), _size_class(size))]
    larger = []
    for k in range(_size_class(max(1.0, threshold * size)), _size_class(size) + 1):
        larger.append(mark(first(max(threshold * size, SIZE_RATIO**k)), k))
    return smaller, larger


def _prefix_rows(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            own = [prefixes(keys, size, threshold) for keys, size in zip(_keys(batch.column("shared")), sizes, strict=True)]
            for is_larger in (False, True):
                marks = [np.concatenate(x[is_larger]) for x in own]
                row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in marks]))
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(row), batch.column("class_id").take(row), batch.column("size").take(row), pa.array(np.full(len(row), is_larger)), pa.array(np.concatenate(marks).view(np.int64))],
                        names=["doc_id", "class_id", "size", "larger", "mark"],
                    )

    return run


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, other) of all pairs of different classes in (doc_id, class_id, shingles) that may be similar enough.

    Of each key's members the class that has most is joined with the others alone, not with itself."""
    sets = stage(sets, "left")
    each = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    common = stage(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    ranked = each.join(common, "shingle").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))
    ranked = ranked.select("doc_id", F.transform("shared", lambda x: x["shingle"]).alias("shared")).join(sets.select("doc_id", "class_id", F.size("shingles").cast("bigint").alias("size")), "doc_id")
    rows = stage(ranked.select("doc_id", "class_id", "size", "shared").mapInArrow(_prefix_rows(threshold), "doc_id bigint, class_id bigint, size bigint, larger boolean, mark bigint"), "prefixes")
    per_class = rows.groupBy("mark", "class_id").agg(F.count(F.lit(1)).alias("n"))
    keys = stage(
        per_class.groupBy("mark").agg(F.max(F.struct("n", "class_id")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("mark", F.col("most.class_id").alias("main")),
        "keys",
    )
    members = stage(rows.join(keys, "mark"), "members")
    right = members.where("larger").select("mark", F.col("doc_id").alias("other"), F.col("class_id").alias("other_class"), F.col("size").alias("other_size"), "main")
    left = members.where(~F.col("larger"))
    fits = (F.col("class_id") != F.col("other_class")) & ((F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("doc_id") < F.col("other"))))
    minor = left.drop("main").join(right.where("other_class <> main"), "mark").where(fits)
    major = left.where("class_id <> main").drop("main").join(right.where("other_class = main"), "mark").where(fits)
    return minor.select("doc_id", "other").unionByName(major.select("doc_id", "other"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of those pairs of ids whose texts are close enough. ``sets``: (doc_id, shingles)."""
    a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_shingles")), "a")
    both = a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_shingles")), "b").select("a", "b", "a_shingles", "b_shingles")
    return both.mapInArrow(_verify, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold - 1e-9)


def components(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, class_id) for the ends of ``edges`` (a, b): the least id that links reach.

    Each round takes the least class among a node's own and its neighbours', then the class of that class
    (pointer jumping), so chains shrink by half and more; rounds go through tables, and their number grows
    with the logarithm of the longest chain. ``classes``: what earlier edges gave."""
    if classes is not None:
        old = classes.select("doc_id", "class_id")
        edges = edges.select("a", "b").unionByName(old.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).where("a <> b"))
    edges = edges.select("a", "b").where("a <> b")
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("doc_id"), F.least("a", "least").alias("class_id")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("doc_id", "b"), "b")
            .groupBy("a")
            .agg(F.min("class_id").alias("near"))
            .withColumnRenamed("a", "doc_id")
        )
        nearer = stage(labels.join(near, "doc_id").select("doc_id", F.col("class_id").alias("old"), F.least("class_id", "near").alias("class_id")), "nearer")
        jump = nearer.select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("jump"))
        jumped = stage(nearer.join(jump, "class_id").select("doc_id", "old", F.least("class_id", "jump").alias("class_id")), "jumped")
        labels = jumped.select("doc_id", "class_id")
        if jumped.where("old <> class_id").isEmpty():
            return labels


def near_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the least doc_id of the class), kept (whether the row stands
    for its class), similar (whether its text has a link to another one, not equal copies alone), links (how many verified
    links to other texts its text has; within a class, not all similar texts need be linked to each other) and nearest (the largest similarity of these)."""
    ship_package(docs.sparkSession)
    with_id = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    signs = with_id.select("doc_id", F.md5("text").alias("h"), W.plain(F.col("text")).alias("text")).mapInArrow(_sign, "doc_id bigint, h string, buckets array<bigint>")
    signed = stage(signs.withColumn("row", F.monotonically_increasing_id()), "signed")
    # Equal texts first: one of them stands for all, so that they cost one row from here on.
    groups = stage(signed.groupBy("h").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("h", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("rep_row")), "groups")
    reps = signed.join(groups.select(F.col("rep_row").alias("row"), F.col("h")), ["row", "h"], "left_semi").select("doc_id", "buckets")
    member = reps.select("doc_id", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = stage(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = stage(member.join(shared, "bucket").select("bucket", "doc_id", "n").distinct(), "members")
    # The text whose buckets have most members is the least changed one of its family, and near more of it than others.
    central = stage(members.groupBy("doc_id").agg(F.sum("n").alias("central")), "central")
    first = members.join(central, "doc_id").groupBy("bucket").agg(F.max(F.struct(F.col("central"), (-F.col("doc_id")).alias("id"))).alias("most"))
    leaders = stage(first.select("bucket", (-F.col("most.id")).alias("leader")), "leaders")
    sets = shingle_sets(with_id, central.select("doc_id"))

    led = members.join(leaders, "bucket").where("doc_id <> leader")
    tried = stage(led.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct(), "pairs")
    links = stage(verified(tried, sets, threshold), "links")
    classes = components(links)
    for turn in ("random", "rest"):
        labelled = members.join(classes, "doc_id", "left").select("bucket", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        labelled = stage(labelled, "labelled")
        mixed = stage(
            labelled.groupBy("bucket")
            .agg(
                F.min("class_id").alias("low"),
                F.max("class_id").alias("high"),
                F.min(F.struct(F.xxhash64("doc_id", "bucket"), "doc_id", "class_id")).alias("one"),
            )
            .where("low <> high")
            .select("bucket", F.col("one.doc_id").alias("other"), F.col("one.class_id").alias("other_class")),
            "mixed",
        )
        if turn == "random":
            pairs = labelled.join(mixed, "bucket").where("class_id <> other_class").select("doc_id", "other")
        else:  # buckets of two have had their one pair compared
            large = mixed.join(shared.where("n > 2").select("bucket"), "bucket", "left_semi").select("bucket")
            left = stage(labelled.join(large, "bucket", "left_semi").select("doc_id", "class_id").distinct(), "left")
            pairs = prefix_pairs(sets.join(left, "doc_id").select("doc_id", "class_id", "shingles"), threshold)
        pairs = pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        more = stage(verified(pairs, sets, threshold), "links")
        if not more.isEmpty():
            classes = components(more, classes)
            links = links.unionByName(more)
    ends = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("rep"), "similarity")
    per_text = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"), F.max("similarity").alias("nearest"))
    linked = groups.join(classes.withColumnRenamed("doc_id", "rep"), "rep", "left").join(per_text, "rep", "left")
    linked = stage(
        linked.select("h", "rep", "rep_row", F.coalesce("class_id", "rep").alias("class_id"), F.col("class_id").isNotNull().alias("similar"), F.coalesce("links", F.lit(0)).alias("links"), "nearest"),
        "classes",
    )
    kept = (F.col("rep") == F.col("class_id")) & (F.col("row") == F.col("rep_row"))
    out = signed.select("doc_id", "h", "row").join(linked, "h").select("doc_id", "class_id", kept.alias("kept"), "similar", "links", "nearest")
    none = docs.where("doc_id is null").select(F.col("doc_id").cast("bigint"), F.col("doc_id").cast("bigint").alias("class_id"), F.lit(True).alias("kept"), F.lit(False).alias("similar"), F.lit(0).cast("bigint").alias("links"), F.lit(None).cast("double").alias("nearest"))
    return out.unionByName(none)


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with the document of the least doc_id of each class, and of its repeated rows one."""
    found = stage(near_classes(docs, threshold).select("doc_id", "class_id").where("doc_id is not null"), "found")
    per_id = found.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("class_id")).alias("drop"), F.count(F.lit(1)).alias("n"))
    moved = stage(per_id.where("drop or n > 1").select(F.col("doc_id").alias("of"), "drop"), "moved")
    once = docs.join(moved, docs["doc_id"] == moved["of"], "left_anti")
    again = moved.where(~F.col("drop"))
    if again.isEmpty():
        return once
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("of"), F.md5("text").alias("h")).join(again, "of", "left_semi")
    return once.unionByName(rows.groupBy("of", "h").agg(F.first("doc").alias("doc")).select("doc.*"))
