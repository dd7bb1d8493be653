"""Linking of tool calls and results in chats, DataFrame functions only.

Calls and results are hash-joined by conversation and call identifier, calls are
put in an order in which each follows those it depends on, their arguments are
checked against the tool's schema, and each call becomes one line of canonical
JSON: keys sorted, no blanks, numbers in one form.

Order: a call's label is the latest place in the chat among its own and those of
all calls it depends on, however far; calls of one label are ordered by hops,
their longest chain of needs among calls of that label. Sorting by label, hops
and turn puts each call after those it depends on and keeps the order of the
chat except where a call stands before one it depends on. Both labels and hops
are found in rounds that halve chains and touch displaced calls only; see
``reached`` and ``levels`` for why they end on any graph.

Each call is a row of its own, with a label to sort by, so no chat, however
long, is gathered in one task.

Defined results: of several calls with one identifier in a chat that with the
smallest turn is meant, and ``n_calls`` tells how many there are; of several
results the one with the smallest turn, then the least text; results without a call are rows with status
``orphan_result``; a call without result is ``missing_result``; a dependency
that is no call of the chat is ignored for the order and makes
``missing_dependency``; calls in a cycle, or that need one whose label they
share, are ``cycle`` with no hops; a null turn is before all others;
null identifiers are no calls or results; arguments that are no JSON object, or
repeat a key, are ``invalid_json``; arguments that break the schema, or name an unknown tool, are
``invalid_arguments``; null texts count as JSON null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.staging import stage

# The tools of the query. (tool, argument, type, required, least value, allowed values)
TOOLS = (
    ("search", "query", "string", True, None, None),
    ("search", "limit", "integer", True, 1, None),
    ("translate", "text", "string", True, None, None),
    ("translate", "to", "string", True, None, ("de", "en", "es", "fr")),
    ("lookup", "id", "integer", True, 0, None),
    ("lookup", "exact", "boolean", False, None, None),
)

#: Spark's names of variant types by JSON Schema's.
TYPES = {"integer": "BIGINT", "string": "STRING", "boolean": "BOOLEAN"}

#: Calls of a block that a fold goes through in one row.
BLOCK = 512
NO_TURN = -(1 << 63)


def problems(tool: Column, arguments: Column, tools: tuple = TOOLS) -> Column:
    """The sorted problems of ``arguments`` (variant) with the schema of ``tool``, as an array of strings."""
    known = sorted({t[0] for t in tools})
    keys = F.map_keys(F.coalesce(F.try_variant_get(arguments, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    per_tool = F.array(F.lit("tool: unknown")).cast("array<string>")
    for name in known:
        own = [t for t in tools if t[0] == name]
        checks = []
        for _, field, kind, required, least, allowed in own:
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            there = F.array_contains(keys, field)
            type_ok = F.schema_of_variant(value) == TYPES[kind]
            bad = F.when(~there, F.lit(f"{field}: missing") if required else F.lit(None)).when(~F.coalesce(type_ok, F.lit(False)), F.lit(f"{field}: not {kind}"))
            if least is not None:
                bad = bad.when(F.try_variant_get(arguments, f"$.{field}", "bigint") < least, F.lit(f"{field}: below {least}"))
            if allowed is not None:
                bad = bad.when(~F.try_variant_get(arguments, f"$.{field}", "string").isin(*allowed), F.lit(f"{field}: not allowed"))
            checks.append(bad.cast("string"))
        extra = F.transform(F.array_except(keys, F.array(*(F.lit(t[1]) for t in own))), lambda k: F.concat(k, F.lit(": unknown")))
        per_tool = F.when(tool == name, F.array_sort(F.concat(F.array_compact(F.array(*checks)), extra))).otherwise(per_tool)
    return per_tool


def reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, label) of the calls that reach a later place than their own: the latest one.

    ``nodes``: conv_id, call_id, place (turn, id). ``edges``: conv_id, call_id, own, needs, needed (both places).
    A round takes the labels of the calls needed, and the label of the call that the own label names, so a
    chain takes as many rounds as the logarithm of its length. Only displaced calls and those that need them take part."""
    keys = ["conv_id", "call_id"]
    start = edges.where(F.col("needed") > F.col("own")).groupBy(*keys).agg(F.max("needed").alias("label"))
    changed = known = stage(start, "changed")
    while not changed.isEmpty():
        news = changed.select("conv_id", F.col("call_id").alias("of"), F.col("label").alias("news"))
        by_need = edges.withColumn("of", F.col("needs")).join(news, ["conv_id", "of"]).select(*keys, "own", "news")
        ahead = known.select("conv_id", F.col("call_id").alias("of"), F.col("label").alias("news"))
        by_label = known.withColumn("of", F.col("label.id")).join(ahead, ["conv_id", "of"]).select(*keys, F.lit(None).cast(edges.schema["own"].dataType).alias("own"), "news")
        best = by_need.unionByName(by_label).groupBy(*keys).agg(F.max("news").alias("news"), F.max("own").alias("own"))
        now = known.select(*keys, F.col("label").alias("now"))
        better = best.join(now, keys, "left").where(F.col("news") > F.coalesce("now", "own"))
        changed = stage(better.select(*keys, F.col("news").alias("label")), "changed")
        known = stage(known.unionByName(changed).groupBy(*keys).agg(F.max("label").alias("label")), "known")
    return known


def blocks(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, block) of calls (conv_id, call_id, at): calls of about BLOCK places in a row share a block, and a block has about BLOCK calls at most."""
    placed = calls.withColumn("block", F.floor(F.col("at") / BLOCK))
    sizes = placed.groupBy("conv_id", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    return placed.join(sizes, ["conv_id", "block"]).withColumn("block", F.struct("block", F.pmod(F.xxhash64("call_id"), F.col("parts")).alias("part"))).drop("parts")


def folded(terms: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of what a fold through each block settles, the latest call first.

    ``terms``: conv_id, call_id, at, block, terms (array of (hops, needs)): a call's level is the largest of its terms, and a term that needs another call
    has that call's level more. A call that needs one outside its block or earlier in the fold's way isn't settled."""
    order = F.reverse(F.array_sort(F.collect_list(F.struct("at", "call_id", "terms"))))  # BLOCK calls or so
    none = F.expr("cast(map() as map<string,bigint>)")

    def settle(known, call):
        each = F.transform(call["terms"], lambda t: t["hops"] + F.when(t["needs"].isNull(), F.lit(0).cast("bigint")).otherwise(F.try_element_at(known, t["needs"])))
        return F.when(F.exists(each, lambda x: x.isNull()), known).otherwise(F.map_concat(known, F.create_map(call["call_id"], F.array_max(each))))

    by_block = terms.groupBy("conv_id", "block").agg(order.alias("calls"))
    return by_block.select("conv_id", F.explode(F.aggregate("calls", none, settle)).alias("call_id", "level"))


def levels(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, hops, cycle) of the calls of ``edges`` (conv_id, call_id, needs, at): the longest chain of needs, or that there is none.

    Each call's level is the largest of levels of others plus so many hops, and of a constant. A round settles
    calls without open needs, and puts a call's one open need in the place of the call itself wherever that is
    needed, so chains shrink by half. A call that comes to need itself, or by more hops than its chat has calls,
    is in a cycle. Where nothing can be replaced, what is open needs a cycle, for the last of a chain would be
    settled. Calls with several open needs can't be shortened so; before each round a fold through blocks of calls in the
    order of their turns settles all of them whose needs come later in the block (``at``), or are settled. So rounds
    end, and their number is the logarithm of the longest chain and, where such calls need each other, the number of
    blocks that their chain passes."""
    keys = ["conv_id", "call_id"]
    state = stage(edges.select(*keys, F.col("needs").alias("needs"), F.lit(1).cast("bigint").alias("hops"), F.lit(False).alias("cycle")), "needs")
    longest = state.groupBy("conv_id").agg(F.count_distinct("call_id").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    placed = stage(blocks(edges.select(*keys, "at").distinct()), "blocks")
    open_ = F.col("needs").isNotNull() & ~F.col("cycle")
    while True:
        calls = state.groupBy(*keys).agg(
            F.count_if(F.col("needs").isNotNull()).alias("n_open"),
            F.coalesce(F.max(F.when(F.col("needs").isNull(), F.col("hops"))), F.lit(0)).alias("least"),
            F.max(F.when(F.col("needs").isNotNull(), F.struct("hops", "needs"))).alias("one"),
            F.bool_or(F.col("cycle") | F.coalesce(F.col("needs") == F.col("call_id"), F.lit(False)) | (F.col("hops") > longest)).alias("bad"),
        )
        needed = calls.select(F.col("conv_id").alias("of_chat"), F.col("call_id").alias("of"), "n_open", "least", "one", "bad")
        met = stage(state.join(needed, (F.col("conv_id") == F.col("of_chat")) & (F.col("needs") == F.col("of")), "left"), "met")
        stays = (F.col("n_open") > 1) & ~F.col("bad")
        if met.where(open_ & ~F.coalesce(stays, F.lit(False))).isEmpty():
            return state.groupBy(*keys).agg(F.max("hops").cast("int").alias("hops"), F.bool_or(F.col("cycle") | F.col("needs").isNotNull()).alias("cycle"))
        none = F.lit(None).cast("string")
        row = lambda needs, hops, cycle: F.struct(needs.alias("needs"), hops.cast("bigint").alias("hops"), cycle.alias("cycle"))
        no = F.lit(False)
        if not met.where(open_ & (F.col("n_open") > 1)).isEmpty():
            const = F.col("needs").isNull() | (F.coalesce("n_open", F.lit(0)) == 0)
            term = F.struct((F.col("hops") + F.when(const & F.col("needs").isNotNull(), F.coalesce("least", F.lit(0))).otherwise(0)).cast("bigint").alias("hops"), F.when(~const, F.col("needs")).alias("needs"))
            sound = met.groupBy(*keys).agg(F.collect_list(term).alias("terms"), F.bool_or(F.col("cycle") | F.coalesce("bad", no)).alias("spoilt"), F.count_if(F.col("needs").isNotNull()).alias("n_own"))
            found = stage(folded(sound.where("n_own > 0 AND NOT spoilt").select(*keys, "terms").join(placed, keys)), "folded")
            if not found.isEmpty():
                left = state.join(found.select(*keys), keys, "left_anti")
                state = stage(left.unionByName(found.select(*keys, none.alias("needs"), F.col("level").alias("hops"), no.alias("cycle"))), "needs")
                continue
        after = F.col("hops") + F.coalesce("least", F.lit(0))
        next_ = (
            F.when(~open_ | F.coalesce(stays, no), F.array(row(F.col("needs"), F.col("hops"), F.col("cycle"))))
            .when(F.col("bad"), F.array(row(none, F.lit(0), F.lit(True))))
            .when(F.coalesce(F.col("n_open"), F.lit(0)) == 0, F.array(row(none, after, no)))
            .otherwise(F.array(row(none, after, no), row(F.col("one.needs"), F.col("hops") + F.col("one.hops"), no)))
        )
        rows = met.select(*keys, F.explode(next_).alias("next")).select(*keys, "next.*")
        # A call that is known to be in a cycle, or to need one, has no open needs any more.
        merged = rows.groupBy(*keys, "needs").agg(F.max("hops").alias("hops"), F.bool_or(F.col("cycle") | F.coalesce(F.col("needs") == F.col("call_id"), no) | (F.col("hops") > longest)).alias("cycle"))
        bad = merged.where("cycle").select(*keys).distinct().withColumn("spoilt", F.lit(True))
        settled = merged.join(bad, keys, "left").where(F.col("spoilt").isNull()).drop("spoilt")
        spoilt = bad.select(*keys, none.alias("needs"), F.lit(0).cast("bigint").alias("hops"), F.lit(True).alias("cycle"))
        state = stage(settled.unionByName(spoilt), "needs")


def labels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, label) of the calls whose label isn't their own place alone.

    ``calls``: conv_id, call_id, turn. ``edges``: conv_id, call_id, needs (a call of the chat).
    A label is (turn, cycle, hops): the latest place that the call reaches, whether calls of that label can't be
    put in order here, and the hops among them."""
    place = F.struct(F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_TURN)).alias("turn"), F.col("call_id").alias("id"))
    nodes = calls.select("conv_id", "call_id", place.alias("own"))
    ends = nodes.select("conv_id", F.col("call_id").alias("needs"), F.col("own").alias("needed"))
    edges = stage(edges.join(nodes, ["conv_id", "call_id"]).join(ends, ["conv_id", "needs"]).select("conv_id", "call_id", "own", "needs", "needed"), "edges")
    known = reached(nodes, edges)
    mine = known.select("conv_id", "call_id", F.col("label").alias("mine"))
    theirs = known.select("conv_id", F.col("call_id").alias("needs"), F.col("label").alias("theirs"))
    within = edges.join(mine, ["conv_id", "call_id"], "left").join(theirs, ["conv_id", "needs"], "left")
    within = stage(within.where(F.coalesce("mine", "own")["turn"] == F.coalesce("theirs", "needed")["turn"]).select("conv_id", "call_id", "needs", F.coalesce("mine", "own")["turn"].alias("turn"), F.col("own.turn").alias("at")), "within")
    order = levels(within.select("conv_id", "call_id", "needs", "at"))
    own = within.select("conv_id", "call_id", "turn").distinct()
    return own.join(order, ["conv_id", "call_id"]).select(
        "conv_id", "call_id", F.struct(F.nullif(F.col("turn"), F.lit(NO_TURN)).alias("turn"), F.col("cycle").cast("int").alias("cycle"), F.when(F.col("cycle"), 0).otherwise(F.col("hops")).alias("hops")).alias("label")
    )


def link(calls: DataFrame, results: DataFrame, tools: tuple = TOOLS) -> DataFrame:
    """One row per call, and per result without one: conv_id, call_id, turn, order_turn, order_hops, status,
    problems, n_calls, n_results, result_turn, line (canonical JSON).

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON), needs (array of call_id).
    ``results``: conv_id, call_id, turn, content. Sort by conv_id, order_turn, order_hops, turn."""
    calls = calls.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", "turn", "tool", "arguments", "needs")
    results = results.where("conv_id is not null and call_id is not null")
    one = stage(
        calls.groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "tool", "arguments", "needs")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
        .select("conv_id", "call_id", "c.*", "n_calls"),
        "calls",
    )
    answer = stage(results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")), "results")
    needed = one.select("conv_id", "call_id", F.explode("needs").alias("needs")).where("needs is not null").distinct()
    there = one.select("conv_id", F.col("call_id").alias("needs"))
    edges = needed.join(there, ["conv_id", "needs"], "left_semi")
    lacks = needed.join(there, ["conv_id", "needs"], "left_anti").select("conv_id", "call_id").distinct().withColumn("lacks", F.lit(True))
    order = labels(one, edges)
    parsed = F.try_parse_json(F.col("arguments"))
    linked = (
        one.join(answer, ["conv_id", "call_id"], "left")
        .join(stage(lacks, "lacks"), ["conv_id", "call_id"], "left")
        .join(order, ["conv_id", "call_id"], "left")
        .withColumn("parsed", parsed)
        .withColumn("is_object", F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False)))
        .withColumn("problems", F.when(F.col("is_object"), problems(F.col("tool"), F.col("parsed"), tools)).otherwise(F.array().cast("array<string>")))
    )
    status = (
        F.when(~F.col("is_object"), "invalid_json")
        .when(F.size("problems") > 0, "invalid_arguments")
        .when(F.col("label.cycle") == 1, "cycle")
        .when(F.col("lacks"), "missing_dependency")
        .when(F.col("n_results").isNull(), "missing_result")
        .otherwise("linked")
    )
    quoted = lambda c: F.coalesce(F.to_json(F.try_parse_json(F.to_json(F.array(c)))), F.lit("[null]"))
    inner = lambda c: F.regexp_extract(quoted(c), r"(?s)^\[(.*)\]$", 1)
    line = F.concat(
        F.lit('{"arguments":'),
        F.when(F.col("is_object"), F.to_json("parsed")).otherwise(F.lit("null")),
        F.lit(',"id":'),
        inner(F.col("call_id")),
        F.lit(',"result":'),
        F.when(F.col("r.content").isNull(), F.lit("null")).otherwise(inner(F.col("r.content"))),
        F.lit(',"tool":'),
        F.when(F.col("tool").isNull(), F.lit("null")).otherwise(inner(F.col("tool"))),
        F.lit("}"),
    )
    out = linked.select(
        "conv_id",
        "call_id",
        "turn",
        F.when(F.col("label").isNull(), F.col("turn")).otherwise(F.col("label.turn").cast(dict(one.dtypes)["turn"])).alias("order_turn"),
        F.coalesce(F.col("label.hops"), F.lit(0)).alias("order_hops"),
        status.alias("status"),
        F.concat_ws("; ", "problems").alias("problems"),
        "n_calls",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("r.turn").alias("result_turn"),
        line.alias("line"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    orphans = answer.join(one.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select(
        "conv_id",
        "call_id",
        none(dict(one.dtypes)["turn"]).alias("turn"),
        F.col("r.turn").alias("order_turn"),
        F.lit(0).alias("order_hops"),
        F.lit("orphan_result").alias("status"),
        F.lit("").alias("problems"),
        F.lit(0).cast("bigint").alias("n_calls"),
        "n_results",
        F.col("r.turn").alias("result_turn"),
        none("string").alias("line"),
    )
    return out.unionByName(orphans)


def derived_calls(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand for a chat's (conv_id, turn, role, text): each assistant turn makes a call,
    and each user turn after the first is a result for the turn before it. The text decides on the tool, the
    arguments, and whether the call needs the assistant's next turn, its last one, both, or none."""
    n = F.length(F.coalesce("text", F.lit("")))
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    turn = lambda k: F.concat(F.lit("c"), (F.col("turn") + k).cast("string"))
    value = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("v")))
    text = F.substring(value, F.lit(6), F.length(value) - 6)
    search = F.concat(F.lit('{"query": '), text, F.lit(', "limit": '), F.when(n % 7 == 0, F.concat(F.lit('"'), words.cast("string"), F.lit('"'))).otherwise(words.cast("string")), F.lit("}"))
    translate = F.concat(F.lit('{"to": "'), F.when(n % 5 == 0, "xx").otherwise("en"), F.lit('", "text": '), text, F.lit("}"))
    lookup = F.when(n % 11 == 0, F.lit('{"exact": true, "id": ')).otherwise(F.concat(F.lit('{"exact": true, "id": '), F.col("turn").cast("string"), F.lit("}")))
    tool = F.when(n % 3 == 0, "search").when(n % 3 == 1, "translate").otherwise("lookup")
    needs = F.concat(F.when(n % 5 == 0, F.array(turn(2))).otherwise(F.array().cast("array<string>")), F.when(words % 2 == 0, F.array(turn(-2))).otherwise(F.array().cast("array<string>")))
    calls = chats.where("role = 'assistant'").select(
        "conv_id", turn(0).alias("call_id"), "turn", tool.alias("tool"), F.when(n % 3 == 0, search).when(n % 3 == 1, translate).otherwise(lookup).alias("arguments"), needs.alias("needs")
    )
    results = chats.where("role = 'user' and turn > 0").select("conv_id", turn(-1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
