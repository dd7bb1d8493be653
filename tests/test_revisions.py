"""Published revisions: whole or not at all, and one of two racing writers."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from tesselith.operators import edges as E
from tesselith.sources import bundles, revisions


def test_tables_of_a_revision_come_into_force_together(spark, tmp_path):
    root = str(tmp_path)
    assert revisions.head(spark, root) is None
    one = revisions.publish(spark, root, None, {"local": spark.range(3), "night": spark.range(1)}, "r1", {"by": "test"})
    two = revisions.publish(spark, root, one.version, {"local": spark.range(5)}, "r2", partition=None)
    assert (one.version, two.version, two.parent) == (1, 2, 1)
    assert revisions.read(spark, root, "local").count() == 5 and revisions.read(spark, root, "night").count() == 1
    assert revisions.read(spark, root, "local", 1).count() == 3
    assert [(r.version, r.parent, r.name, r.detail) for r in revisions.history(spark, root).orderBy("version").collect()] == [(1, None, "r1", '{"by": "test"}'), (2, 1, "r2", "{}")]
    with pytest.raises(KeyError):
        revisions.read(spark, root, "other")


def test_a_writer_that_was_overtaken_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    one = revisions.publish(spark, root, None, {"t": spark.range(1)}, "r1")
    revisions.publish(spark, root, one.version, {"t": spark.range(2)}, "r2")
    before = sorted(os.listdir(tmp_path / "_tables"))
    for parent in (one.version, None, 7):
        with pytest.raises(revisions.Conflict):
            revisions.publish(spark, root, parent, {"t": spark.range(9)}, "late")
    assert sorted(os.listdir(tmp_path / "_tables")) == before and revisions.read(spark, root, "t").count() == 2
    assert not [f for f in os.listdir(tmp_path / "_revisions") if f.endswith(".draft")]


def test_of_racing_writers_one_wins_each_round(spark, tmp_path):
    root, won, lost = str(tmp_path), [], []
    for turn in range(3):
        at = revisions.head(spark, root)
        barrier = threading.Barrier(4)

        def write(k, parent=at.version if at else None, barrier=barrier, turn=turn):
            barrier.wait()
            try:
                won.append((turn, revisions.commit(spark, root, parent, {"t": f"{turn}-{k}"}, f"{turn}-{k}")))
            except revisions.Conflict:
                lost.append(turn)

        threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    assert [t for t, _ in won] == [0, 1, 2] and sorted(lost) == [0] * 3 + [1] * 3 + [2] * 3
    assert revisions.head(spark, root).name == won[-1][1].name


def test_a_failed_write_leaves_no_tables(spark, tmp_path):
    with pytest.raises(Exception, match="wrong"):
        revisions.publish(spark, str(tmp_path), None, {"good": spark.range(1), "bad": spark.range(1).select(F.raise_error(F.lit("wrong")).alias("x"))}, "r1")
    assert revisions.head(spark, str(tmp_path)) is None and os.listdir(tmp_path / "_tables") == []


def test_a_change_of_references_is_published_once(spark, tmp_path):
    root = str(tmp_path)
    edges = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0, 1.0, 5.0, 0.0, "direct"), (1, 2, 1.0, 0.0, 0.0, 1.0, 7.0, 0.0, "direct")], "source int, target int, a double, b double, c double, d double, tx double, ty double, method string")
    change = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1.0, 2.0, 0.0)], "batch int, " + ", ".join(f"r_{c} double" for c in E.CELLS))
    first = revisions.publish(spark, root, None, {"edges": edges, "stars": spark.range(4)}, "flow")
    E.publish_reference_change(spark, root, change, first.version)
    with pytest.raises(revisions.Conflict):
        E.publish_reference_change(spark, root, change, first.version)
    assert sorted((r.source, r.tx, r.method) for r in revisions.read(spark, root, "edges").collect()) == [(0, 7.0, "reference_rebased"), (1, 5.0, "reference_rebased")]
    assert revisions.read(spark, root, "stars").count() == 4 and revisions.read(spark, root, "edges", 1).where("method = 'direct'").count() == 2


def test_bundles_go_through_revisions(spark, tmp_path):
    with pytest.raises(KeyError):
        bundles.current_revision(spark, str(tmp_path))
    bundles.write_revision(spark.range(4), str(tmp_path), "a")
    bundles.write_revision(spark.range(6), str(tmp_path), "b")
    assert bundles.current_revision(spark, str(tmp_path)) == "b" and bundles.read_current(spark, str(tmp_path)).count() == 6
