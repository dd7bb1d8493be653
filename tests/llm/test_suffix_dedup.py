"""Long repeated byte strings: the built transform, and its removals against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselith.llm import queries, suffix_dedup
from tesselith.staging import stage


def by_brute_force(texts: list[bytes], window: int) -> list[tuple]:
    starts = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if starts[t[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def removals(spark, texts: list, **settings) -> list[tuple]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"row": F.lit("clash"), "found": F.lit(None), "bytes": F.lit(1)})
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, run: n + run["high"] - run["low"])
    rows = suffix_dedup.remove_repeats(docs.repartition(3), **settings).select("doc_id", F.length("bytes"), removed, F.size("removed"), F.sha2("kept", 256)).collect()
    return [tuple(r[1:]) for r in sorted(rows)]


def quilt(seed: int, alphabet: str) -> list[str]:
    """Texts sewn from parts of a few others."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(12)]
    part = lambda b: b[rng.randint(0, len(b) // 2) :][: rng.randint(0, 150)]
    return ["".join(part(rng.choice(base)) for _ in range(rng.randint(0, 4))) for _ in range(60)]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é漢"])
@pytest.mark.parametrize("most", [suffix_dedup.MOST_SEGMENTS, 3])
def test_removals_equal_brute_force(spark, alphabet, most):
    texts = quilt(len(alphabet), alphabet)
    texts += ["a" * 200, "ab" * 100, "", "a" * 39, texts[0], None, None]
    plain = [(t or "").encode() for t in texts]
    assert removals(spark, texts, window=40, anchor=10, most=most) == by_brute_force(plain, 40)


def test_a_text_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    texts = [long + long[1000:1100], long[2000:2090], "x" + long[4980:] + long[:60]]
    monkeypatch.setattr(suffix_dedup, "PIECE_WINDOWS", 700)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    whole = suffix_dedup.segments(data, np.array([0, len(data)]), 40, 10)
    assert whole[3].sum() == len(data) - 39
    assert removals(spark, texts, window=40, anchor=10) == by_brute_force([t.encode() for t in texts], 40)


def test_windows_of_400_bytes_that_differ_at_their_ends(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    texts = ["left " + passage + " right", "other_" + passage + "!", passage[:399] + "#", passage[1:] + passage[:5]]
    assert removals(spark, texts) == by_brute_force([t.encode() for t in texts], 400)
    assert [r[1] for r in removals(spark, texts)] == [400, 400, 0, 0]


def test_segments_of_one_common_anchor_are_divided(spark):
    small = {"adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "16"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        segment = F.col("id")
        kinds = stage(spark.range(0, 40_000, 1, 8).select(F.when(segment % 2 == 0, 0).otherwise(segment - segment % 3).alias("anchor"), segment.alias("segment")), "contents")
        joined = suffix_dedup._with_others(kinds, "anchor")
        got = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    anchors = [0 if i % 2 == 0 else i - i % 3 for i in range(40_000)]
    sizes = Counter(anchors)
    assert sorted(map(tuple, got)) == sorted((a, i, sizes[a]) for i, a in enumerate(anchors) if sizes[a] > 1)
    assert "skew=true" in plan


def test_no_documents(spark):
    assert removals(spark, []) == []


def test_transform_has_sorted_suffixes_and_their_common_prefixes(tmp_path: Path):
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    left = np.array([rng.randint(-5, 5) for _ in strings])
    group = np.sort(np.array([rng.randint(0, 3) for _ in strings]))
    seen = bytearray()
    for column, order, common in suffix_dedup.columns(strings, left, group, tmp_path):
        suffix = lambda i: strings[i][column - left[i] :]  # noqa: B023, E731
        reach = [i for i in range(len(strings)) if left[i] <= column < left[i] + len(strings[i])]
        assert [(group[i], suffix(i)) for i in order] == sorted((group[i], suffix(i)) for i in reach)
        for a, b, n in zip(order, order[1:], common[1:], strict=False):
            shared = next((k for k, (x, y) in enumerate(zip(suffix(a), suffix(b), strict=False)) if x != y), min(len(suffix(a)), len(suffix(b))))
            assert n == (shared if group[a] == group[b] else 0)
        seen += bytes(sorted(suffix(i)[0] for i in reach))
    assert sorted((tmp_path / "transform").read_bytes()) == sorted(seen) == sorted(b"".join(strings))


def test_query_equals_brute_force_on_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, by_brute_force([(d.text or "").encode() for d in docs], 400), strict=True)}
    got = {r[0]: tuple(r[1:]) for r in queries.op11_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
