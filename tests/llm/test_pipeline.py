"""The pipeline's stages on the smallest tables, each against a plain version."""

import hashlib

import corpus_pipeline
import pytest

from tesselith.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_language_stage_drops_what_has_no_letters(stages):
    assert ids(stages[1]) == sorted(r.doc_id for r in stages[0].collect() if any(c.isalpha() for c in r.text or ""))


def test_exact_stage_keeps_the_largest_id(stages):
    keep = {}
    for r in stages[1].collect():
        key = hashlib.sha256((r.text or "").encode()).digest()
        keep[key] = max(keep.get(key, -1), r.doc_id)
    assert ids(stages[2]) == sorted(keep.values())


def test_near_stage_equals_brute_force(stages):
    from tests.llm.test_operators import brute_classes

    classes = brute_classes([(r.doc_id, r.text) for r in stages[2].collect()])
    assert ids(stages[3]) == sorted(d for d, c in classes.items() if d == c)


def test_decontamination_drops_whole_items(spark, stages):
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[3].collect() if any(i in r.text.lower() for i in items)}
    assert held and ids(stages[4]) == sorted(set(ids(stages[3])) - held)


def test_packing_has_all_documents(stages):
    assert sorted({r.doc_id for r in stages[5].select("doc_id").collect()}) == ids(stages[4])


def test_odd_rows_go_through_all_stages(spark):
    from tests.llm.test_operators import prose

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base, long = prose(80, 120), prose(81, 9000)
    near = base.replace(base.split()[60], "changed")
    rows = [(1, None), (2, ""), (3, "?! 123"), (4, base), (4, base), (5, base), (6, near), (None, prose(82, 60)), (None, prose(82, 60)), (None, item), (7, f"{prose(83, 30)} {item}"), (8, long), (None, None)]
    docs = spark.createDataFrame([(d, t, "en" if d else None, None, None, "x", 1, True, "y") for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, row int, kept boolean, class_id string")
    got = [docs]
    for name, function in corpus_pipeline.STAGES:
        got.append(stage(function(spark, got[-1], SF), name))
    assert all(df.columns == docs.columns for df in got[:5])
    at = lambda k: sorted((-1 if r.doc_id is None else r.doc_id) for r in got[k].select("doc_id").collect())
    assert at(1) == [-1, -1, -1, 4, 4, 5, 6, 7, 8]
    assert at(2) == [-1, -1, 5, 6, 7, 8]
    assert at(3) == [-1, -1, 5, 7, 8]
    assert at(4) == [-1, 5, 8]
    pieces = got[5].collect()
    assert {r.doc_id for r in pieces} == {None, 5, 8} and max(r.length for r in pieces) == 2048 and sum(r.doc_id == 8 for r in pieces) > 4
    none = docs.where("doc_id < 0")
    for _, function in corpus_pipeline.STAGES:
        none = stage(function(spark, none, SF), "empty")
    assert none.collect() == []
