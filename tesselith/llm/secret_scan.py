"""Secret scans over a blob ledger, DataFrame functions only.

Every historical version of a file (here: every row) is named by the digest of
its text, its blob. A ledger holds the pairs of blob and rule version that have
been scanned; a scan reads only the texts of blobs that lack a pair, one text
per blob however many paths have it, and the findings are joined back to all
paths.

A scan first names the blobs, then joins those that lack some pair with one of
their texts and matches it. On a first scan, texts that a Bloom filter shows to have no
copies pass by the join. The places of a text's matches
are running sums over the lengths of its pieces, so they cost no more than the
number of matches.

Positions count code points; the end is exclusive. Defined results: a null text
counts as empty and has no findings; a repeated row gets its own result row; an
empty table gives empty results; other columns are not read, so their names may
clash with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.llm import exact_dedup
from tesselith.staging import stage


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``group`` is the group whose length must reach ``least``."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds in their listed order, then further kinds.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def pieces(text: Column, rule: Rule) -> Column:
    """For each of the rule's leftmost non-overlapping matches in ``text``, and the end: the lengths (code points) of
    what is before it since the last one, of itself, and of the group that is tested. Null without a match."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else found
    return F.when(text.rlike(rule.pattern), F.arrays_zip(between.alias("between"), found.alias("found"), tested.alias("tested")))


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, start, end) of the findings in (blob, text, todo), where ``todo`` has the places of the rules to use."""
    made = [F.struct(F.lit(i).alias("rank"), F.when(F.array_contains("todo", i), pieces(F.col("text"), r)).alias("pieces")) for i, r in enumerate(rules)]
    each = texts.select("blob", F.explode(F.array(*made)).alias("r")).where("r.pieces is not null").select("blob", "r.rank", F.posexplode("r.pieces").alias("i", "p"))
    # A row that is repeated, path and text, is read as often; its pieces count once.
    each = each.distinct()
    order = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("p.between") + F.coalesce("p.found", F.lit(0))).over(order)
    rule = lambda field, kind: F.element_at(F.array(*(F.lit(getattr(r, field)) for r in rules)), F.col("rank") + 1).cast(kind)
    placed = each.withColumn("end", end.cast("int")).where(F.col("p.found").isNotNull() & (F.col("p.tested") >= rule("least", "int")))
    return placed.select("blob", rule("kind", "string").alias("kind"), rule("version", "int").alias("version"), (F.col("end") - F.col("p.found")).alias("start"), "end")


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rank, kind, version) of the pairs that the ledger lacks. ``blobs``: one row per blob."""
    every = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for i, r in enumerate(rules)))
    pairs = blobs.select("blob", F.explode(every).alias("rule")).select("blob", "rule.*")
    return pairs if ledger is None else pairs.join(ledger, ["blob", "kind", "version"], "left_anti")


def scan(
    versions: DataFrame,
    path: str = "doc_id",
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One incremental scan of (``path``, text): the new ledger, all findings by blob, findings by path.

    ``ledger`` (blob, kind, version) and ``findings`` (blob, kind, version, start, end) are what earlier
    scans returned; findings of rule versions that are no longer asked for are left out of the last result."""
    named = versions.select(F.col(path).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob(F.col("text")))
    paths = stage(named.select("path", "blob"), "paths")
    blobs = stage(paths.groupBy("blob").agg(F.min("path").alias("path")), "blobs")
    pairs = unseen(blobs, ledger, rules)
    if ledger is not None:
        pairs = stage(pairs, "pairs")
    todo = pairs.groupBy("blob").agg(F.collect_set("rank").alias("todo")).join(blobs, "blob")
    readers = stage(todo.select(F.col("path").alias("of"), F.col("blob").alias("of_blob"), "todo"), "readers").hint("shuffle_hash")

    def first_copies(rows: DataFrame) -> DataFrame:
        """One path of each blob. The side that is hashed has ids alone; texts stream past it unsorted. As ``todo`` is
        from that side, the matching stays above the join, and reads neither copies nor what was scanned before."""
        return rows.join(readers, F.col("path").eqNullSafe(F.col("of")) & (F.col("blob") == F.col("of_blob"))).select("blob", "text", "todo")

    if ledger is None:
        # All rules are due, and only texts that may have copies need the join: a Bloom filter tells most others.
        words = exact_dedup.filter_words(paths.count())
        bits = stage(exact_dedup.repeated_bits(paths.select(F.col("blob").alias("digest")), words), "repeated_bits")
        probed = exact_dedup.probe(named.withColumn("digest", F.col("blob")), bits, words)
        single = probed.where(~F.col("maybe_repeated")).select("blob", "text", F.array(*(F.lit(i) for i in range(len(rules)))).alias("todo"))
        rows = scan_texts(single, rules).unionByName(scan_texts(first_copies(probed.where("maybe_repeated")), rules))
    else:
        rows = scan_texts(first_copies(named), rules)
    found = stage((rows if findings is None else rows.unionByName(findings)).distinct(), "findings")
    scanned = pairs.select("blob", "kind", "version")
    ledger = scanned if ledger is None else scanned.unionByName(ledger)
    return ledger, found, by_path(paths, found, rules)


def by_path(paths: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings): findings as an array ordered by start, then kind as listed."""
    current = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))))
    rank = F.element_at(current, F.concat_ws(":", "kind", F.col("version").cast("string")))
    per_blob = stage(
        found.withColumn("rank", rank)
        .where(F.col("rank").isNotNull())
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("start", "rank", "kind", "end"))).alias("findings")),
        "per_blob",
    )
    # Both sides are tables: a blob that a third of all paths have can be split.
    return paths.join(per_blob, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(per_blob.schema["findings"].dataType)).alias("findings"))


def spans(findings: Column) -> Column:
    return F.concat_ws(",", F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
