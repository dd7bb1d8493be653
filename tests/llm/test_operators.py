"""The ten operators on hand-made tables: defined results in odd cases, and brute force where SQL can't say it."""

import hashlib
import json
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tesselith.llm import archives, decontaminate, exact_dedup, language_id, licenses, near_dedup, packing, quality, secret_scan, tool_calls
from tesselith.llm import words as W

DOCS = "doc_id bigint, text string, lang string, digest string, word string, bucket bigint"
LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def table(spark, rows):
    """Rows of (doc_id, text, lang), with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1)
    rows = [(1, None, None), (2, "", "en"), (3, "", None), (None, "no id here at all", "en"), (4, base, "en"), (4, base, "en"), (5, base, None), (6, base + " tail", "de"), (7, LONG, "en"), (8, "?!", "fr"), (9, "one", "en")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# --- exact dedup


def test_exact_dedup_groups(odd, empty):
    got = exact_dedup.duplicate_groups(odd).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in blank} == {1, 2, 3} and {r.keep_id for r in blank} == {3} and [r.doc_id for r in blank if r.kept] == [3]
    base = by[hashlib.sha256(prose(1).encode()).hexdigest()]
    assert [r.keep_id for r in base] == [5, 5, 5] and base[0].group_size == 3
    assert all(sum(r.kept for r in group) == 1 for group in by.values())
    assert exact_dedup.duplicate_groups(empty).count() == 0


def test_exact_dedup_keeps_columns(odd, empty):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 5, 6, 7, 8, 9]
    assert exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_full_filter(spark, monkeypatch):
    """A filter that is far too small lets more through to the exact path, and changes nothing."""
    monkeypatch.setattr(exact_dedup, "filter_words", lambda rows: 1)
    docs = table(spark, [(i, f"text {i % 150}", "en") for i in range(400)])
    got = {r.doc_id: r for r in exact_dedup.duplicate_groups(docs).collect()}
    assert all(got[i].keep_id == max(j for j in range(400) if j % 150 == i % 150) for i in range(400))


# --- near dedup


def shingle_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (t or "").lower())
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_classes(rows, threshold=0.8):
    sets, parent = shingle_sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (union and len(sets[i] & sets[j]) / union >= threshold - 1e-9):
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_classes_equal_brute_force(spark):
    r, rows = random.Random(5), []
    for family in range(6):
        words = prose(100 + family, 120).split()
        for _ in range(25):
            own = list(words)
            for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6))):
                own[r.randrange(len(own))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, prose(i, 40)) for i in range(30)]
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(table(spark, [(d, t, "en") for d, t in rows])).collect()}
    assert got == brute_classes(rows)


def test_near_classes_of_repeated_lines_equal_brute_force(spark):
    """Copies that differ in how often a line is repeated, and in words too: plain similarity is high, that by weights low."""
    rows = []
    for pair in range(40):
        words, line = prose(500 + pair, 160).split(), prose(700 + pair, 40)
        own = list(words)
        if pair % 2:
            own[80] = own[90] = "new"
        rows += [(2 * pair, " ".join(words) + f" {line}" * 300), (2 * pair + 1, " ".join(own) + f" {line}" + f" {line}" * (pair % 3))]
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(table(spark, [(d, t, "en") for d, t in rows])).collect()}
    want = brute_classes(rows)
    assert sum(d != c for d, c in want.items()) == 40 and got == want


def test_links_are_those_of_verified_pairs(spark):
    base = prose(40, 200).split()
    texts = [" ".join(base), " ".join([*base[:100], "zz", *base[101:]]), " ".join([*base[:60], "yy", *base[61:]]), prose(41, 200), prose(41, 200), ""]
    shingles = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    rows = {r.doc_id: r for r in near_dedup.near_classes(table(spark, [(d, t, "en") for d, t in enumerate(texts)])).collect()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert {rows[d].class_id for d in range(3)} == {0} and sum(rows[d].links for d in range(3)) >= 4
    for d in range(3):
        assert 1 <= rows[d].links <= 2 and any(abs(rows[d].nearest - alike(d, o)) < 1e-9 for o in range(3) if o != d)
    assert [(rows[d].links, rows[d].nearest) for d in (3, 4, 5)] == [(0, None)] * 3


def test_near_odd_cases(odd, empty):
    got = near_dedup.near_classes(odd).collect()
    assert len(got) == 11
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[1] == classes[2] == classes[3] == 1 and classes[4] == classes[5] == classes[6] == 4
    assert classes[7] == 7 and classes[8] == 8 and classes[None] is None
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 7, 8, 9]
    assert sorted((r.doc_id or 0) for r in got if r.kept) == [0, 1, 4, 7, 8, 9]
    assert near_dedup.near_classes(empty).count() == 0


def test_prefixes_miss_no_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        size = int(r.integers(2, 200))
        a = np.unique(r.integers(0, 1 << 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(np.ceil(size * r.uniform(0.85, 1)))], r.integers(0, 1 << 62, int(r.integers(0, 20))).astype(np.uint64)]))
        if near_dedup.similarity(a, b) >= 0.8:
            small, large = sorted((a, b), key=len)
            # Some shingles that a third text has too come last, each text's own are not in the list.
            both = np.intersect1d(a, b)
            rank = lambda x: np.concatenate([(y := np.intersect1d(x, both))[y % 3 > 0], y[y % 3 == 0]])  # noqa: B023, E731
            one, two = near_dedup.prefixes(rank(small), len(small), 0.8)[0], near_dedup.prefixes(rank(large), len(large), 0.8)[1]
            assert set(np.concatenate(one).tolist()) & set(np.concatenate(two).tolist())


def test_near_families_around_the_threshold(spark):
    """Many texts of one family, most pairs of which are less similar than the threshold, and a paragraph that others share."""
    r, rows = random.Random(9), []
    words, common = prose(1, 150).split(), prose(2, 60)
    for _ in range(150):
        own = list(words)
        for _ in range(r.choice((2, 3, 4, 5))):
            own[r.randrange(len(own))] = f"new{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, f"{prose(1000 + i, r.choice((10, 14, 20)))} {common}") for i in range(100)]
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(table(spark, [(d, t, "en") for d, t in rows])).collect()}
    assert got == brute_classes(rows)


def test_near_copies_in_other_scripts_and_quotes(spark):
    han = "".join(chr(0x4E00 + (i * i * 7) % 3000) for i in range(200))
    base = prose(5, 80)
    rows = [(1, han), (2, han[:100] + "。" + han[100:] + "终"), (3, f"“{base}” – end"), (4, f'"{base}" - end'), (5, "".join(reversed(han)))]
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(table(spark, [(d, t, "zh") for d, t in rows])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_signatures_estimate_probability_jaccard():
    texts = pa.array([" ".join(f"a{i % 90}" for i in range(n, n + 300)) for n in (0, 20, 45)])
    keys, weights, at = near_dedup.weighted(texts, 5)
    sets = [(keys[at[d] : at[d + 1]], weights[at[d] : at[d + 1]]) for d in range(3)]
    signs = near_dedup.signatures(keys, weights, at, 2000)
    for i in range(3):
        for j in range(3):
            assert abs((signs[i] == signs[j]).mean() - near_dedup.probability_jaccard(sets[i], sets[j])) < 0.06


def test_words_equal_a_regular_expression():
    texts = ["", "Aé b", "x", "  many   blanks ", "a,b;c", "ünï_cödé 12 3", LONG[:500], "end."]
    hashes, at = W.hashes(pa.array([t.lower() for t in texts] + [None]))
    seen = {}
    for d, t in enumerate([*texts, ""]):
        words = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", t.lower())
        own = hashes[at[d] : at[d + 1]]
        assert len(words) == len(own)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, own, strict=True))
    assert len(set(seen.values())) == len(seen)


# --- decontamination


def test_overlaps(spark, empty):
    item = prose(7, 30).split()
    changed = list(item)
    for i in (4, 9, 15, 22, 27):
        changed[i] = "other"
    docs = table(spark, [(1, f"{prose(8)} {' '.join(item)} {prose(9)}", "en"), (2, f"{prose(10)} {' '.join(changed)}", "en"), (3, prose(11, 200), "en"), (4, None, "en"), (5, " ".join(item[:6]), "en"), (6, f"{LONG} {' '.join(item)}", None), (6, "again " + " ".join(item), None)])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, prose(12, 20)), (None, "x"), (4, "two words")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 1)}
    assert got[1, 1].matched_words == 30 and got[2, 1].matched_words == 25 and got[2, 1].overlap_words == 30
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(docs, bench.where("item_id < 0")).count() == 0


@pytest.mark.parametrize("size", range(1, 21))
def test_masks_hit_every_overlap_that_counts(size):
    """All patterns of matches of an item of so many words: what _verify accepts has a hit of a mask."""
    needed = min(decontaminate.MIN_MATCHES, int(np.ceil(decontaminate.ITEM_SHARE * size)))
    same = np.arange(1 << size)
    same = same[np.bitwise_count(same) >= needed]
    for mask in (*decontaminate.MASKS, *decontaminate.SHORT_MASKS.get(size, ())):
        for k in range(size - len(mask) + 1):
            bits = int(mask[::-1], 2) << k
            same = same[(same & bits) != bits]
    for pattern in same.tolist():
        assert decontaminate.best_stretch(np.array([pattern >> k & 1 for k in range(size)], bool))[2] < needed


def test_overlaps_of_short_and_repeated_items(spark):
    words = [prose(900 + n, n).split() for n in range(1, 13)]
    docs, want = [], set()
    for n, item in enumerate(words, 1):
        docs.append((n, f"{prose(950 + n, 30).upper()} {' '.join(item)} zz", "en"))
        want.add((n, n))
        if n >= 8:
            docs.append((100 + n, f"zz {' '.join([*item[:4], 'zz', *item[5:]])}", "en"))
            want.add((100 + n, n))
    docs += [(200, prose(61, 20), "en"), (201, prose(62, 20), "en"), (202, prose(63, 20), "en")]
    bench = [(n, " ".join(item)) for n, item in enumerate(words, 1)] + [(50, prose(61, 20)), (50, prose(62, 20)), (None, prose(63, 20))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table(spark, docs), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    short = {(d, i) for d, i in got if i is not None and i <= 3}  # so short that other texts may hold them
    assert want | {(200, 50), (201, 50), (202, None)} == got - short | {(n, n) for n in (1, 2, 3)} and {(n, n) for n in (1, 2, 3)} <= short


def test_overlaps_equal_brute_force(spark):
    """All documents against all items along all diagonals."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.matched_words for r in decontaminate.overlaps(docs, bench).collect()}
    number = {}
    words = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (t or "").lower())], np.int64)
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        own = words(r.text)
        for item, his in items:
            needed = min(decontaminate.MIN_MATCHES, int(np.ceil(decontaminate.ITEM_SHARE * len(his))))
            if len(np.intersect1d(own, his)) == 0 or not len(his):
                continue
            for shift in np.unique((np.flatnonzero(np.isin(own, his))[:, None] - np.arange(len(his))[None, :]).ravel()):
                first, last = max(0, -shift), min(len(his), len(own) - shift)
                same = own[first + shift : last + shift] == his[first:last]
                if same.sum() >= needed and (found := decontaminate.best_stretch(same)[2]) >= needed:
                    want[r.doc_id, item] = max(found, want.get((r.doc_id, item), 0))
    assert max(len(words(r.text)) for r in docs.collect()) > 2000
    assert got == want and want


def test_documents_without_an_id_are_compared_too(spark):
    item = prose(70, 40)
    clean, dirty = prose(71, 50), f"{prose(72, 30)} {item} {prose(73, 30)}"
    docs = table(spark, [(1, clean, "en"), (2, dirty, "en"), (None, dirty, "en"), (None, dirty, "de"), (None, item, "en"), (None, clean, "en"), (None, None, "en")]).withColumnsRenamed({"bucket": "gone"})
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = decontaminate.overlaps(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.matched_words) for r in got) == [(0, 7, 40), (0, 7, 40), (0, 7, 40), (2, 7, 40)]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, clean), (1, clean)]


def test_masks_find_items_with_a_fifth_of_words_changed():
    r, hit, accepted = np.random.default_rng(4), 0, 0
    for _ in range(2000):
        size = int(r.integers(21, 60))
        same = np.ones(size, bool)
        same[r.choice(size, size // 5, replace=False)] = False
        if decontaminate.best_stretch(same)[2] < decontaminate.MIN_MATCHES:
            continue
        accepted += 1
        masks = [np.flatnonzero(np.array(list(m)) == "1") for m in decontaminate.MASKS]
        hit += any(same[k + m].all() for m in masks for k in range(size - m[-1]))
    assert accepted > 1500 and hit >= 0.99 * accepted


# --- secrets


def python_spans(text):
    found = []
    rules = [(re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), (re.compile(r"[0-9a-f]+"), 0, 24)]
    for k, (pattern, group, least) in enumerate(rules):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


SECRETS = ["password = 'abcdef12'", "API_KEY: short", "ünï𝒳 token=abcdefgh AKIA" + "A1" * 10, "f" * 24 + " " + "a" * 23, "password=token=abcdef secret:xyz.abc-", None, "", "passwd\":\"" + "x" * 40 + "\n" + "deadbeef" * 5, "Secret = token: abcdefg"]


def test_secret_spans_equal_python(spark, empty):
    docs = table(spark, [(i, t, "en") for i, t in enumerate(SECRETS)] + [(0, SECRETS[0], "en"), (50, SECRETS[2], "en")])
    _, _, found = secret_scan.scan(docs)
    rows = found.select("path", secret_scan.spans(found["findings"]).alias("s")).collect()
    assert len(rows) == len(SECRETS) + 2
    for r in rows:
        assert r.s == python_spans((SECRETS[r.path] if r.path < 50 else SECRETS[2]) or "")
    assert secret_scan.scan(empty)[2].count() == 0


def test_secret_ledger_is_incremental(spark):
    first = table(spark, [(1, SECRETS[0], "en"), (2, SECRETS[3], "en")])
    ledger, findings, _ = secret_scan.scan(first, rules=secret_scan.BASE_RULES)
    assert ledger.count() == 6 and findings.count() == 2
    # A false finding in the old table shows that a blob that was scanned isn't scanned again.
    marked = findings.where("kind = 'assign'").select("blob", "kind", "version", (findings["start"] + 1000).alias("start"), (findings["end"] + 1000).alias("end"))
    second = table(spark, [(1, SECRETS[0], "en"), (9, SECRETS[7], "en")])
    ledger2, findings2, by_path = secret_scan.scan(second, ledger=ledger, findings=marked, rules=secret_scan.BASE_RULES)
    got = {r.path: [(f.kind, f.start) for f in r.findings] for r in by_path.collect()}
    assert got[1] == [("assign", 1000)] and {k for k, _ in got[9]} == {"assign", "hex"}
    assert ledger2.count() == 9
    newer = (secret_scan.Rule("assign", 2, secret_scan.BASE_RULES[0].pattern, 2, 6), *secret_scan.BASE_RULES[1:])
    _, _, by_path = secret_scan.scan(second, ledger=ledger2, findings=findings2, rules=newer)
    assert {r.path: [f.start for f in r.findings if f.kind == "assign"] for r in by_path.collect()}[1] == [0]


def test_secret_places_are_found_in_linear_time(spark):
    text = " ".join(f"token=abcdef{i}" for i in range(100_000))
    began = time.perf_counter()
    _, _, found = secret_scan.scan(table(spark, [(1, text, "en"), (2, text, "en")]))
    rows = found.select("path", secret_scan.spans(found["findings"]).alias("s")).collect()
    assert time.perf_counter() - began < 60
    assert [r.s for r in rows] == [python_spans(text)] * 2


def test_secret_query_goes_through_the_ledger(spark, monkeypatch):
    from tesselith.llm import queries

    seen = []
    scan = secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda *a, **k: seen.append(k.get("ledger")) or scan(*a, **k))
    got = queries.op2_secret_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 2 and seen[0] is None and seen[1].count() > 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        base = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex"))
        assert base == python_spans(texts[r.doc_id]) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


# --- licences


def test_licences(spark, odd, empty):
    docs = table(spark, [(1, "Licensed under the Apache License, Version 2.0.\n" + prose(3), "en"), (2, "x\nreleased UNDER the mit license", None), (3, licenses.TEMPLATES["mit-text"], "en"), (4, None, None), (5, "Licensed under CC BY-NC 4.0.", "en"), (6, " ".join([licenses.TEMPLATES["unlicense"]] * 3), "en"), (5, "Licensed under CC BY-NC 4.0.", "en")])
    got = [(r.doc_id, r.first_word, r.words, r.license, r.dice) for r in licenses.scan(docs).collect()]
    assert {(1, 0, 8, "apache-2.0", 1.0), (2, 1, 5, "mit", 1.0)} <= set(got) and (3, 0, "mit-text", 1.0) in {(*g[:2], *g[3:]) for g in got}
    assert got.count((5, 0, 7, "cc-by-nc-4.0", 1.0)) == 2 and not any(g[0] == 4 for g in got)
    assert [g[1] for g in sorted(got) if g[0] == 6 and g[3] == "unlicense"] == [0, 11, 22]
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_licences_inside_files(spark):
    """Headers wrapped as comments, notices amid a line, full texts with a few changes, and templates beyond ASCII."""
    import textwrap

    header = textwrap.indent(textwrap.fill(licenses.TEMPLATES["apache-2.0-notice"], 60), "# ")
    full = licenses.TEMPLATES["mit-full"].replace("AUTHORS OR COPYRIGHT HOLDERS", "writers").replace("free of charge", "at no cost")
    wrapped = textwrap.fill(full, 79)
    rows = [(1, f"#!/bin/sh\n# Copyright someone\n{header}\n\n{prose(1, 3000)}"), (2, f"{prose(2, 500)}. Released under the MIT License. {prose(3, 500)}"), (3, f"{prose(4, 70)}\n{wrapped}\n{prose(5, 900)}"), (4, " ".join(licenses.TEMPLATES["apache-2.0-notice"].split()[:30])), (5, f"{prose(6, 100)} Öffentliche Lizenz für freie Werke — über alles {prose(7, 100)}")]
    own = licenses.TEMPLATES | {"oelfw": "Öffentliche Lizenz für freie Werke: über alles"}
    got = {(r.doc_id, r.license): r for r in licenses.scan(table(spark, [(*r, "en") for r in rows]), own).collect()}
    assert set(got) - {(1, "apache-2.0"), (4, "apache-2.0"), (3, "mit-text")} == {(1, "apache-2.0-notice"), (2, "mit"), (3, "mit-full"), (5, "oelfw")}
    assert got[1, "apache-2.0-notice"].dice == 1.0 and got[1, "apache-2.0-notice"].first_word == 4 and got[2, "mit"].first_word == 500
    assert 0.9 < got[3, "mit-full"].dice < 1 and got[5, "oelfw"].dice == 1.0


def test_query_licences_equals_sql(spark):
    import duckdb

    from tesselith.llm import queries

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(queries.OP5_SQL)
    assert Counter(map(tuple, queries.op5_license_scan(spark, "/root/testdata/sf0.01").select(*want.columns).collect())) == Counter(want.fetchall())


def test_licence_anchors_are_in_every_close_unit():
    anchors = set(licenses.anchors(licenses.TEMPLATES, licenses.DICE))
    r = random.Random(2)
    for text in licenses.TEMPLATES.values():
        words = licenses.template_words(text)
        for _ in range(50):
            own = [w for w in words if r.random() > 0.15]
            a, b = set(zip(own, own[1:])), set(zip(words, words[1:]))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= licenses.DICE:
                assert set(own) & anchors


# --- tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 5, "search", '{"query": "q", "limit": 3}', ["b"]),
            (1, "b", 7, "search", '{"limit": 1.5, "query": "q"}', []),
            (1, "c", 8, "lookup", '{"id": 4, "more": 1}', ["zz"]),
            (1, "d", 9, "lookup", '{"id": 4}', ["zz"]),
            (1, "d", 10, "lookup", '{"id": 5}', []),
            (1, "e", 11, "none", "{}", None),
            (1, "f", 12, "lookup", '{"id": 1, "id": 2}', []),
            (2, "a", 1, "lookup", '{"id": 7, "exact": false}', ["b"]),
            (2, "b", 2, "lookup", '{"exact":true,"id":8}', ["c"]),
            (2, "c", 3, "lookup", '{"id": 9}', ["a"]),
            (None, "a", 1, "lookup", "{}", []),
            (3, None, 1, "lookup", "{}", []),
            (4, "a", 1, None, None, []),
        ],
        "conv_id bigint, call_id string, turn bigint, tool string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([(1, "a", 6, 'said "x"\n/é'), (1, "a", 9, "later"), (1, "b", 8, None), (9, "q", 1, "lost"), (None, "a", 1, "x")], "conv_id bigint, call_id string, turn bigint, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results).collect()}
    assert set(got) == {(1, k) for k in "abcdef"} | {(2, k) for k in "abc"} | {(4, "a"), (9, "q")}
    a = got[1, "a"]
    assert (a.status, a.order_turn, a.order_hops, a.n_results, a.result_turn) == ("linked", 7, 1, 2, 6)
    assert a.line == '{"arguments":{"limit":3,"query":"q"},"id":"a","result":"said \\"x\\"\\n/é","tool":"search"}' and json.loads(a.line)
    assert got[1, "b"].status == "invalid_arguments" and got[1, "b"].problems == "limit: not integer"
    assert got[1, "c"].problems == "more: unknown" and got[1, "d"].status == "missing_dependency" and got[1, "d"].n_calls == 2
    assert got[1, "e"].problems == "tool: unknown" and got[1, "f"].status == "invalid_json" and got[4, "a"].status == "invalid_json"
    assert {got[2, k].status for k in "abc"} == {"cycle"}
    assert got[9, "q"].status == "orphan_result" and got[9, "q"].turn is None
    assert tool_calls.link(calls.where("turn < 0"), results.where("turn < 0")).count() == 0


def test_tool_call_order_is_topological(spark):
    r, rows = random.Random(4), []
    for i in range(60):
        rows.append((1, f"c{i}", i, "lookup", '{"id": 1}', [f"c{j}" for j in r.sample(range(60), 2) if (j * 7) % 60 < (i * 7) % 60]))
    calls = spark.createDataFrame(rows, "conv_id bigint, call_id string, turn bigint, tool string, arguments string, needs array<string>")
    none = spark.createDataFrame([], "conv_id bigint, call_id string, turn bigint, content string")
    got = {x.call_id: (x.order_turn, x.order_hops, x.turn) for x in tool_calls.link(calls, none).collect()}
    assert all(got[n] < got[c] for _, c, _, _, _, needs in rows for n in needs)


CALLS = "conv_id bigint, call_id string, turn bigint, tool string, arguments string, needs array<string>, place string, own string, hops int"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string, c string"


def python_order(needs):
    """(label, hops, in or behind a cycle of its label) by call; ``needs``: turn -> turns."""
    reach = {}
    for c in needs:
        seen, todo = set(), list(needs[c])
        while todo:
            d = todo.pop()
            if d not in seen:
                seen.add(d)
                todo += needs[d]
        reach[c] = seen
    label = {c: max([c, *reach[c]]) for c in needs}
    spoilt = {c for c in needs if any(d in reach[d] and label[d] == label[c] for d in {c, *reach[c]})}

    def hops(c):
        return 0 if c in spoilt else max((1 + hops(d) for d in needs[c] if label[d] == label[c]), default=0)

    return {c: (label[c], hops(c), c in spoilt) for c in needs}


@pytest.mark.parametrize("odds", [0.4, 1.2])
def test_tool_call_order_equals_brute_force(spark, odds):
    r, rows, want = random.Random(int(odds * 10)), [], {}
    for chat in range(25):
        size = r.choice((2, 3, 5, 9, 14))
        needs = {i: r.sample(range(size), min(size, int(odds * 2 * r.random() + 0.5))) for i in range(size)}
        rows += [(chat, f"c{i}", i, "lookup", '{"id": 1}', [f"c{j}" for j in needs[i]], "x", "y", 1) for i in range(size)]
        want |= {(chat, f"c{i}"): v for i, v in python_order(needs).items()}
    got = tool_calls.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS)).collect()
    assert {(x.conv_id, x.call_id): (x.order_turn, x.order_hops, x.status == "cycle") for x in got} == want


def test_tool_call_cycle_that_needs_a_later_call(spark):
    rows = [(1, "a", 1, "lookup", '{"id": 1}', ["b", "c"]), (1, "b", 2, "lookup", '{"id": 1}', ["a"]), (1, "c", 9, "lookup", '{"id": 1}', []), (1, "d", 0, "lookup", '{"id": 1}', ["a"]), (1, "e", 20, "lookup", '{"id": 1}', ["a"])]
    rows += [(2, f"x{i}", i, "lookup", '{"id": 1}', [f"x{(i + 1) % 7}"]) for i in range(7)] + [(3, "s", 1, "lookup", '{"id": 1}', ["s"])]
    rows += [(4, "n", None, "lookup", '{"id": 1}', ["m"]), (4, "m", None, "lookup", '{"id": 1}', [])]
    got = tool_calls.link(spark.createDataFrame([(*x, "x", "y", 1) for x in rows], CALLS), spark.createDataFrame([], RESULTS)).collect()
    by = {(x.conv_id, x.call_id): (x.status, x.order_turn, x.order_hops) for x in got}
    assert len(got) == len(rows) and all(by[1, k] == ("cycle", 9, 0) for k in "abd")
    assert by[1, "c"] == ("missing_result", 9, 0) and by[1, "e"] == ("missing_result", 20, 0)
    assert all(by[2, f"x{i}"] == ("cycle", 6, 0) for i in range(7)) and by[3, "s"] == ("cycle", 1, 0)
    assert by[4, "n"] == ("missing_result", None, 1) and by[4, "m"] == ("missing_result", None, 0)


def test_long_displaced_chains_take_few_rounds(spark, monkeypatch):
    n, staged = 300, []
    stage = tool_calls.stage
    monkeypatch.setattr(tool_calls, "stage", lambda df, name="stage": staged.append(name) or stage(df, name))
    rows = [(1, f"c{i}", i, "lookup", '{"id": 1}', [f"c{i + 1}"] if i + 1 < n else [], "x", "y", 1) for i in range(n)]
    got = {x.turn: (x.order_turn, x.order_hops) for x in tool_calls.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS)).collect()}
    assert got == {i: (n - 1, n - 1 - i) for i in range(n)} and len(staged) < 60


def test_braids_of_a_thousand_calls_take_few_rounds(spark, monkeypatch):
    """Each call needs the next two, in one chat as they are and in another with a need backwards now and then."""
    n, staged = 1000, []
    stage = tool_calls.stage
    monkeypatch.setattr(tool_calls, "stage", lambda df, name="stage": staged.append(name) or stage(df, name))
    needs = {i: [j for j in (i + 1, i + 2) if j < n] for i in range(n)}
    rows = [(1, f"c{i}", i, "lookup", '{"id": 1}', [f"c{j}" for j in needs[i]], "x", "y", 1) for i in range(n)]
    got = {x.turn: (x.order_turn, x.order_hops) for x in tool_calls.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS)).collect()}
    assert got == {i: (n - 1, n - 1 - i) for i in range(n)} and len(staged) <= 36


def test_query_tool_calls_equals_sql(spark):
    import duckdb

    from tesselith.llm import queries

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(queries.OP6_SQL)
    got = queries.op6_tool_calls(spark, "/root/testdata/sf0.01").select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
    assert {"cycle", "linked"} <= {r.status for r in got} and max(r.order_hops for r in got) > 0


# --- archives


def test_archives_round_trip(spark, empty, monkeypatch):
    monkeypatch.setattr(archives, "FILE_RECORDS", 2)
    rows = [(1, "http://a b/x", "<p>é</p>" * 20), (2, None, "<p>é</p>" * 20), (3, "u", None), (4, "u", ""), (5, "u", "s" * 99), (6, "u", "s" * 99), (7, "u", "a\r\n\r\nWARC/1.1\r\nb" * 20), (8, "u", "x" * 3_000_000), (9, "u", "<p>é</p>" * 20), (10, "u", "a\nb\n\n" * 40), (None, "u", "<p>é</p>" * 20)]
    pages = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], "page_id bigint, url string, html string, record string, digest string, type string, file string")
    got = archives.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {k: r.refers_to for k, r in by.items() if r.record_type == "revisit"} == {2: 1, 9: 1}
    assert by[1].url == "http://a%20b/x" and by[2].url == "urn:page:2"
    assert archives.round_trip(pages.where("page_id < 0")).count() == 0


def arc_file(version, records, note=b""):
    fields = (archives.ARC_1_FIELDS, archives.ARC_2_FIELDS)[version - 1].encode()
    block = b"%d 0 Org\n%s\n%s" % (version, fields, note)
    middle = b"" if version == 1 else b" 200 - - 0 y.arc"
    out = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain%s %d\n%s\n" % (middle, len(block), block)
    for url, kind, body in records:
        middle = b"" if version == 1 else b" 200 abc - 0 y.arc"
        out += b"%s 1.2.3.4 20010203040506 %s%s %d\n%s\n" % (url, kind, middle, len(body), body)
    return out


def test_arc_versions_are_parsed():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello\n\nworld"
    records = [(b"http://u", b"text/html", block), (b"http://a b/c  d", b"text/html; charset=utf-8", block), (b"dns:u", b"text/dns", b"20010203\nu. 1 IN A 1.2.3.4\n")]
    for version in (1, 2):
        content = arc_file(version, records) + b"odd line\nhttp://no/fields 12\nhello\nworld\n\nhttp://last 1.2.3.4 2001 text/html" + (b"" if version == 1 else b" 200 abc - 0 y.arc") + b" 999\ncut off"
        for step in (1, 7, 1 << 20):
            got = list(archives.parse_arc(archives.Stream(iter([content[i : i + step] for i in range(0, len(content), step)]))))
            assert [h[0] for h, _ in got] == ["filedesc://x.arc", "http://u", "http://a b/c  d", "dns:u", "http://no/fields", "http://last"]
            assert [b for _, b in got[1:4]] == [r[2] for r in records] and got[2][0][3] == "text/html; charset=utf-8"
            assert got[4][1] == b"hello\nworld\n" and got[5][1] == b"cut off"
    assert archives._timestamp("20010203040506") == "2001-02-03T04:05:06Z" and archives._timestamp("20010203") == "2001-02-03T00:00:00Z" and archives._timestamp("x") == "1970-01-01T00:00:00Z"


def test_foreign_archives_are_converted(spark, tmp_path):
    """Several gzip members and files, records that are no HTTP or no UTF-8, and long ones."""
    import gzip

    latin = "HTTP/1.0 200 OK\nServer: é\n\nnaïve".encode("latin-1")
    large = b"HTTP/1.1 200 OK\r\n\r\n" + b"line\n" * 400_000
    first = arc_file(1, [(b"dns:u", b"text/dns", b"20010203\nu. 1 IN A 1.2.3.4\n"), (b"http://a b", b"text/html", latin)], b"more\n")
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(first) + gzip.compress(arc_file(2, [(b"http://v", b"text/html", large)])))
    (tmp_path / "arc" / "b.arc.gz").write_bytes(gzip.compress(arc_file(2, [(b"ftp://f", b"image/png", bytes(range(256)) * 3), (b"http://v", b"text/html", large)])))
    rows = archives.read_arc(spark, f"file://{tmp_path}/arc")
    archives.write_warc(archives.convert(rows), f"file://{tmp_path}/warc")
    lines = archives.read_files(spark, f"file://{tmp_path}/warc")
    got = []
    for stream in archives._files(iter(lines.toArrow().to_batches())):
        got += list(archives.parse_warc(stream))
    kinds = sorted((h["warc-type"], h.get("warc-target-uri", ""), h["content-type"]) for h, _ in got)
    http = "application/http; msgtype=response"
    assert kinds == [("resource", "dns:u", "text/dns"), ("resource", "ftp://f", "image/png"), ("response", "http://a%20b", http), ("response", "http://v", http), ("response", "http://v", http), *[("warcinfo", "", "text/plain")] * 3]
    blocks = [b for _, b in got]
    assert latin in blocks and blocks.count(large) == 2 and bytes(range(256)) * 3 in blocks
    assert all(int(h["content-length"]) == len(b) for h, b in got)
    assert all(h["warc-payload-digest"] == "sha256:" + hashlib.sha256(archives._http(b)[1]).hexdigest() for h, b in got)


# --- quality


def test_quality_learns_and_holds_out(spark, odd, empty):
    rows = [(i, prose(i, 80) if i % 2 else "BUY!!! NOW$$$ " * 30 + str(i), "en") for i in range(200)]
    docs = table(spark, [*rows, (1000, None, None), (1001, "", None), (1, rows[1][1], "en")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None), (7777, 1)], "doc_id bigint, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.7 - 1e-12) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 200 and r.held_out)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)  # held-out labels have no say
    assert {r.score for r in quality.classify(odd, labels.where("quality = 3")).collect()} == {0.7}
    assert quality.classify(empty, labels).count() == 0


def test_quality_threshold_is_over_all_labels(spark, monkeypatch):
    """A sample that is smaller than the labelled rows, evenly of both labels, leaves the share of worse ones as it is."""
    monkeypatch.setattr(quality, "MOST_LABELLED", 30)
    docs = table(spark, [(i, prose(i, 20 + i % 61), "en") for i in range(600)])  # scores of the two labels overlap
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(600)], "doc_id bigint, quality int")
    own = [r for r in quality.classify(docs, labels).collect() if not r.held_out]
    worse = sum(r.doc_id % 6 == 0 for r in own)
    assert abs(sum(r.predicted == 0 for r in own) - worse) <= 1


@pytest.mark.parametrize("share", [0.0, 0.14, 0.5, 1.0])
def test_quality_quantile_is_exact(spark, share):
    r = random.Random(3)
    values = [r.choice((r.gauss(0, 1), 0.5, 1e6 * r.random())) for _ in range(3000)]
    assert abs(quality.quantile(spark.createDataFrame([(v,) for v in values], "v double"), share) - np.quantile(values, share)) < 1e-9


def test_quality_pairs_use_every_sampled_row(spark, monkeypatch):
    """One better row and many worse ones: the fit must see the last of them too."""
    seen = []
    fit = quality.LogisticRegression.fit
    monkeypatch.setattr(quality.LogisticRegression, "fit", lambda self, pairs: seen.append(pairs.where("label = 1").select("features").distinct().count()) or fit(self, pairs))
    rows = spark.createDataFrame([(i, [float(i + k) for k in range(len(quality.FEATURES))]) for i in range(40)], "doc_id bigint, features array<double>")
    quality.train(rows, spark.createDataFrame([(i, int(i == 0)) for i in range(40)], "doc_id bigint, quality int"))
    assert seen == [39]


def test_quality_weights_are_at_the_least_loss(spark):
    """Against the loss written out: its gradient over all pairs vanishes at the weights that training gives."""
    r = np.random.default_rng(8)
    x = r.normal(size=(90, len(quality.FEATURES)))
    label = (x @ r.normal(size=x.shape[1]) + r.normal(size=90) > 0).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "doc_id bigint, features array<double>")
    pairs = []
    fit = quality.LogisticRegression.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality.LogisticRegression, "fit", lambda self, p: pairs.extend((row.features.toArray(), row.label) for row in p.collect()) or fit(self, p))
        model = quality.train(rows, spark.createDataFrame([(i, int(label[i])) for i in range(90)], "doc_id bigint, quality int"))
    d, won = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    better, worse = x[label == 1], x[label == 0]
    known = {tuple(np.round(a - b, 9)) for a in better for b in worse}
    assert all(tuple(np.round(v if w else -v, 9)) in known for v, w in zip(d, won, strict=True))
    weights, scale = np.array(model.weights), d.std(axis=0, ddof=1)
    gradient = d.T @ (1 / (1 + np.exp(-d @ weights)) - won) / len(d) + quality.REGULARISATION * weights * scale**2
    assert np.abs(gradient).max() < 1e-3


# --- language


def test_language_mixtures(spark, odd, empty):
    vocabulary = {"aa": "bada gado dabo", "bb": "xyl wyx zyw", "cc": "miro romi rimo"}
    r = random.Random(1)
    mk = lambda lang, n=80: " ".join("".join(r.choice(vocabulary[lang].split()) for _ in range(2)) for _ in range(n))
    rows = [(i, mk(list(vocabulary)[i % 3]), list(vocabulary)[i % 3]) for i in range(150)]
    docs = table(spark, [*rows, (200, mk("aa") + " " + mk("bb", 40), None), (201, "123 !", "aa"), (202, None, "bb"), (203, "", None), (1, rows[1][1], "bb")])
    model = language_id.train(docs.where(~language_id.held_out()).select("text", "lang"))
    got = language_id.predict(docs, model).collect()
    assert len(got) == 155 and all(x.lang_pred == list(vocabulary)[x.doc_id % 3] for x in got if x.doc_id < 150)
    by = {x.doc_id: x for x in got}
    assert [x.lang for x in by[200].languages] == ["aa", "bb"] and 0.5 < by[200].languages[0].share < 0.85
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (201, 202, 203))
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 152
    assert language_id.predict(empty, model).count() == 0
    assert {x.lang_pred for x in language_id.predict(odd, language_id.train(empty.select("text", "lang"))).collect()} == {"und"}


def test_language_sets_have_no_fixed_size(spark):
    vocabulary = {"aa": "bada gado dabo", "bb": "xyl wyx zyw", "cc": "miro romi rimo", "dd": "kesu seku uske", "ee": "thun nuht huth"}
    r = random.Random(2)
    mk = lambda lang, n: " ".join("".join(r.choice(vocabulary[lang].split()) for _ in range(2)) for _ in range(n))
    model = language_id.train(spark.createDataFrame([(mk(lang, 400), lang) for lang in vocabulary], "text string, lang string"))
    texts = [" ".join(mk(lang, 60 - 5 * i) for i, lang in enumerate(list(vocabulary)[:k])) for k in range(1, 6)]
    found = language_id.infer(texts, *model)
    assert [sorted(x for x, _ in f[2]) for f in found] == [sorted(vocabulary)[:k] for k in range(1, 6)]


def test_language_inference_equals_plain_em():
    """A brute-force version: every set of languages, each by many rounds of EM, trigram by trigram."""
    from itertools import combinations

    r = random.Random(11)
    sounds = {"aa": "bada gado dabo", "bb": "xyl wyx zyw", "cc": "miro romi rimo", "dd": "kesu seku uske"}
    mk = lambda lang, n: " ".join("".join(r.choice(sounds[lang].split()) for _ in range(2)) for _ in range(n))
    langs = list(sounds)
    table = np.full((language_id.BUCKETS, 4), language_id.SMOOTHING)
    for j, lang in enumerate(langs):
        np.add.at(table[:, j], language_id.trigrams([mk(lang, 500)])[1], 1)
    table /= table.sum(axis=0)
    texts = [mk("aa", 30), mk("bb", 40) + " " + mk("cc", 15), mk("cc", 3), " ".join(mk(x, n) for x, n in zip(langs, (40, 30, 25, 20))), "ba"]
    for text, (lang, _, chosen) in zip(texts, language_id.infer(texts, langs, table), strict=True):
        chance = table[language_id.trigrams([text])[1]]
        best = None
        for k in range(1, 5):
            for some in combinations(range(4), k):
                share = np.full(k, 1 / k)
                for _ in range(200):
                    part = chance[:, some] * share
                    share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
                fit = np.log(chance[:, some] @ share).sum() - language_id.PENALTY * (k - 1) * np.log(len(chance) + 1)
                if best is None or fit > best[0] + 1e-9:
                    best = (fit, {langs[i]: s for i, s in zip(some, share, strict=True)})
        assert {x for x, _ in chosen} == set(best[1]) and lang == max(best[1], key=best[1].get)
        assert all(abs(best[1][x] - y) < 0.05 for x, y in chosen)


# --- packing


def test_packing(spark, odd, empty):
    got = packing.pack(odd, 2048).collect()
    tokenizer = packing._load(None)
    want = Counter()
    for row in odd.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[row.doc_id, k // 2048, k, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("size", [8, 61, 2048])
def test_plan_fills_every_slot_once(size):
    r = random.Random(size)
    for _ in range(40):
        histogram = {n: r.randint(1, r.choice((2, 30, 900))) for n in r.sample(range(1, size + 1), r.randint(1, min(size, 80)))}
        ranks, used = Counter(), {}
        slots = packing.plan(histogram, size)
        for length, low, high, first, begin, per in slots:
            assert low == ranks[length]
            ranks[length] = high
            for j in range(high - low):
                used.setdefault(first + j // per, []).append((begin + j % per * length, length))
        assert ranks == histogram and len(slots) <= packing.PLAN_ROWS
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size


def test_word_ids_equal_the_tokenizer():
    tokenizer = packing._load(None)
    ids = packing.WordIds(tokenizer)
    for text in ["Don't 12ab <|endoftext|> x", "É́ é ÜBER, Straße.", "a\tb  c\x1cd", "ΣΑΣ.", "x..", "日本語 テキスト", "İstanbul", "a.,", LONG[:3000]]:
        own = ids.of(text)
        assert list(struct.unpack(f"<{len(own) // 4}I", own)) == tokenizer.encode(text, add_special_tokens=False).ids
