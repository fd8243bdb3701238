"""The eight token-efficiency diagnostics, by slice.

Traces need: ingest_seq, model, model_name, messages (array of role, content, name, tool_calls), tools (array of names),
tools_json, retrieved_chunks, input_tokens, output_tokens, max_output_tokens, retry_of, retry_count, task_type, tenant,
workload.  Each rule gives at most one row a slice: ``keys``, rule_id, affected, measured (its token or call measure),
min_savings, max_savings.  Rules aggregate partially and never bring a slice's requests together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions.quantiles import beside, counted_broadcast
from ..functions.text import known_model, word_hashes_of
from ..functions.tokens import count_messages, count_text, count_tools
from ..sinks.tables import written

RESULT = ["rule_id", "affected", "measured", "min_savings", "max_savings"]


def _long(column: Column) -> Column:
    return column.cast("long")


def _result(df: DataFrame, keys: Sequence[str], rule: str, affected: Column, measured: Column, least: Column, most: Column) -> DataFrame:
    return df.select(*keys, F.lit(rule).alias("rule_id"), _long(affected).alias("affected"), _long(measured).alias("measured"), _long(least).alias("min_savings"), _long(most).alias("max_savings"))


def contents(messages: Column, role: str, joint: str) -> Column:
    """Contents of a role's messages, joined."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit(""))), joint)


def repeated_prefix(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL001: the most frequent system prompt (earliest among equals) of a slice."""
    prompts = traces.withColumn("prompt", F.trim(contents(F.col("messages"), "system", "\n"))).where("prompt <> ''")
    groups = prompts.groupBy(*keys, "prompt").agg(F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first"))
    top = groups.groupBy(*keys).agg(F.max_by(F.struct("prompt", "n"), F.struct(F.col("n"), (-F.col("first")).alias("early"))).alias("t"))
    found = top.select(*keys, F.col("t.n").alias("n"), (count_text(F.col("t.prompt")) * (F.col("t.n") - 1)).alias("repeated")).where("n >= 2 and repeated >= 100")
    return _result(found, keys, "TL001", F.col("n"), F.col("repeated"), F.floor(F.col("repeated") * 0.72), F.col("repeated"))


def fingerprint_prefix(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL001 from keyed fingerprints (columns fingerprint, prefix_tokens), for slices without any system prompt."""
    has_prompt = F.trim(contents(F.col("messages"), "system", "\n")) != ""
    groups = traces.groupBy(*keys, "fingerprint").agg(
        F.count_if(F.col("prefix_tokens") > 0).alias("n"), F.max_by("prefix_tokens", F.when(F.col("prefix_tokens") > 0, F.col("ingest_seq"))).alias("tokens"), F.min(F.when(F.col("prefix_tokens") > 0, F.col("ingest_seq"))).alias("first"), F.bool_or(has_prompt).alias("prompted")
    )
    usable = (F.col("fingerprint").isNotNull()) & (F.col("fingerprint") != "") & (F.col("n") > 0)
    top = groups.groupBy(*keys).agg(F.coalesce(F.bool_or("prompted"), F.lit(False)).alias("prompted"), F.max_by(F.struct("tokens", "n"), F.when(usable, F.struct(F.col("n"), (-F.col("first")).alias("early")))).alias("t"))
    found = top.where(~F.col("prompted")).select(*keys, F.col("t.n").alias("n"), (F.col("t.tokens") * (F.col("t.n") - 1)).alias("repeated")).where("n >= 2 and repeated >= 100")
    return _result(found, keys, "TL001", F.col("n"), F.col("repeated"), F.floor(F.col("repeated") * 0.72), F.col("repeated"))


def history_growth(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL002: requests of five or more messages."""
    long = traces.withColumn("context", count_messages(F.col("messages"))).where((F.size("messages") >= 5) & (F.col("context") > 0))
    found = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("context").alias("total")).where("n >= 2")
    estimate = F.bround(F.col("total") * 0.15, 0)
    return _result(found, keys, "TL002", F.col("n"), F.col("total"), F.greatest(F.lit(0.0), F.bround(estimate * 0.6, 0)), estimate)


def unused_tools(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL003: tools that are defined but never called in a slice."""
    called = F.flatten(F.transform("messages", lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<string>"))))
    names = traces.select(*keys, F.explode(F.concat(F.transform("tools", lambda t: F.struct(t.alias("name"), F.lit(True).alias("defined"))), F.transform(called, lambda t: F.struct(t.alias("name"), F.lit(False).alias("defined"))))).alias("t"))
    by_name = names.groupBy(*keys, "t.name").agg(F.bool_or("t.defined").alias("defined"), F.bool_or(~F.col("t.defined")).alias("called")).where("defined")
    counts = by_name.groupBy(*keys).agg(F.count(F.lit(1)).alias("tools"), F.count_if(~F.col("called")).alias("unused"))
    tokens = traces.groupBy(*keys).agg(F.sum(F.when(F.size("tools") > 0, count_tools(F.col("tools_json"))).otherwise(0)).alias("tokens"))
    found = (counts.join(tokens, list(keys)) if keys else counts.crossJoin(F.broadcast(tokens))).where("unused > 0 and tokens >= 100")  # without keys both have one row
    spare = F.bround(F.col("tokens") * F.col("unused") / F.greatest(F.lit(1), F.col("tools")), 0)
    return _result(found, keys, "TL003", F.col("unused"), F.col("tokens"), F.bround(spare * 0.6, 0), spare)


PAIRED_SETS = 1_000_000  # at most so many numbers of word sets (8 bytes each) are broadcast; more meet by a shuffle
SLOTS = 1 << 16  # words are told apart in so many slots where only their frequency matters


def frequency_classes(parsed: DataFrame) -> bytes:
    """One byte a slot of the words (hashes) in ``words``: the logarithm of how often its words occur, in eighths of a power of two.  SLOTS rows come to the driver."""
    slots = parsed.select(F.explode("words").alias("word")).select(F.pmod("word", F.lit(SLOTS)).cast("int").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    classes = bytearray(SLOTS)
    for slot, n in slots.select("slot", F.least(F.floor(F.log2("n") * 8), F.lit(254)) + 1).collect():
        classes[slot] = n
    return bytes(classes)


def redundant_chunk_rows(chunks: DataFrame, keys: Sequence[str] = (), threshold: float = 0.85) -> DataFrame:
    """TL004 from a row a chunk (ingest_seq, place, chunk), for requests of any number of chunks.

    Pairs of a request's chunks with Jaccard similarity of words at or over the threshold; the later chunk's tokens count.
    Chunks of equal word sets count by a running number.  Words of a set are put in order of their frequency over all chunks, rarest
    first (any fixed order gives the same pairs).  Sets of a request meet under the words of their prefixes (two sets that reach the threshold share
    one of the first ``size - ceil(threshold * size) + 1`` words), unless their sizes or the words left behind the shared one
    can't reach it; they are verified and count by running numbers too.  Chunks are parsed once, into hashes that are written;
    frequencies and prefixes are derived from these, and only the sets of pairs that met are read again.  Requests are told apart by a hash of their keys.
    """
    key = [*keys, "ingest_seq"]
    # the request's keys as one number that is never null, so that all joins below are on plain equality
    parsed = chunks.select(*key, F.xxhash64(F.to_json(F.struct(*key))).alias("k"), "place", _long(count_text(F.col("chunk"))).alias("n"), F.sort_array(word_hashes_of(F.col("chunk"))).alias("words"))
    rows = written(parsed.withColumn("set", F.xxhash64("words")), "chunk-rows")
    # the class above the hash in one number, so that a set is put in order as plain numbers
    common = F.split(F.lit(",".join(str(c << 55) for c in frequency_classes(rows))), ",").cast("array<bigint>")
    classed = lambda w: F.coalesce(F.get(common, w.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(w, 9))
    worded = rows.where(F.size("words") > 0)
    slim = worded.select(*key, "k", "set", "place", "n")
    before = Window.partitionBy("k", "set").orderBy("place")
    same = slim.withColumn("redundant", F.col("n") * (F.row_number().over(before) - 1)).select(*key, "redundant")
    size = F.size("words")
    prefix = F.slice(F.sort_array(F.transform("words", classed)), F.lit(1), (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    # half a hash is enough to bring sets together, because pairs are verified; words of one set alone, which are most, are left out before the join
    starts = worded.select("k", "set", size.alias("size"), F.posexplode(prefix).alias("at", "word"))
    under = starts.withColumn("word", F.shiftright(F.shiftleft("word", 32), 32).cast("int")).repartition("k", "word").distinct()
    alone = Window.partitionBy("k", "word")
    under = written(under.withColumn("sets", F.count(F.lit(1)).over(alone)).where("sets > 1").drop("sets"), "chunk-starts")
    shared = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))  # at most so many of both from here on
    both_sizes = F.col("a.size") + F.col("b.size")
    near = (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * threshold - 1e-9) & (shared + F.least("a.at", "b.at") >= both_sizes * (threshold / (1 + threshold)) - 1e-9)
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.set") < F.col("b.set"))
    met = under.alias("a").join(under.alias("b"), on & near)
    pairs = written(met.select(F.col("a.k").alias("k"), F.col("a.set").alias("x"), F.col("b.set").alias("y")).distinct(), "chunk-pairs")
    needed = counted_broadcast(pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct(), PAIRED_SETS)
    sets = written(worded.select("k", "set", "words").join(needed, "set", "left_semi").groupBy("k", "set").agg(F.first("words").alias("words")), "chunk-sets")
    pairs = pairs.join(sets.select("k", F.col("set").alias("x"), F.col("words").alias("x_words")), ["k", "x"])
    pairs = pairs.join(sets.select("k", F.col("set").alias("y"), F.col("words").alias("y_words")), ["k", "y"])
    overlap = F.size(F.array_intersect("x_words", "y_words"))
    pairs = pairs.where(overlap / (F.size("x_words") + F.size("y_words") - overlap) >= threshold)
    sides = pairs.select("k", "x", "y", F.explode(F.array(F.struct(F.col("x").alias("set"), F.lit(0).alias("side")), F.struct(F.col("y").alias("set"), F.lit(1).alias("side")))).alias("s")).select("k", "x", "y", "s.*")
    both = slim.join(sides, ["k", "set"]).select(*key, "k", "x", "y", "side", "place", "n")
    so_far = Window.partitionBy("k", "x", "y").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = F.when(F.col("side") == 0, F.sum("side").over(so_far)).otherwise(F.sum(1 - F.col("side")).over(so_far))
    cross = both.withColumn("redundant", F.col("n") * others).select(*key, "redundant")
    requests = rows.select(*key).distinct().withColumn("redundant", F.lit(0).cast("long"))
    each = requests.unionByName(same).unionByName(cross).groupBy(*key).agg(F.sum("redundant").alias("redundant"))
    found = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("redundant").alias("total")).where("n >= 2 and total >= 100")
    return _result(found, keys, "TL004", F.col("n"), F.col("total"), F.bround(F.col("total") * 0.5, 0), F.col("total"))


def retry_amplification(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL005: explicit retries; where a slice has none, all requests whose text occurs more than once.  Aggregated by text first, so copies of one text are one row."""
    explicit = (F.coalesce(F.col("retry_of"), F.lit("")) != "") | (F.coalesce(F.col("retry_count"), F.lit(0)) > 0)
    text = F.trim(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n"))
    cost = F.coalesce(F.col("input_tokens"), count_messages(F.col("messages")))
    rows = traces.select(*keys, explicit.alias("explicit"), cost.alias("cost"), F.when(text != "", F.sha2(text, 256)).alias("text"))
    groups = rows.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.count_if("explicit").alias("e_n"), F.sum(F.when(F.col("explicit"), F.col("cost"))).alias("e_cost"))
    again = F.col("text").isNotNull() & (F.col("n") > 1)
    found = groups.groupBy(*keys).agg(F.sum("e_n").alias("e_n"), F.sum("e_cost").alias("e_cost"), F.sum(F.when(again, F.col("n"))).alias("r_n"), F.sum(F.when(again, F.col("cost"))).alias("r_cost"))
    found = found.select(*keys, F.when(F.col("e_n") > 0, F.col("e_n")).otherwise(F.col("r_n")).alias("n"), F.when(F.col("e_n") > 0, F.col("e_cost")).otherwise(F.col("r_cost")).alias("total")).where("n > 0")
    return _result(found, keys, "TL005", F.col("n"), F.col("total"), F.bround(F.col("total") * 0.6, 0), F.col("total"))


def nearest_p99(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, top, used): nearest-rank 99th percentiles of limits and outputs, from their values' counts (keys, kind, x, n)."""
    up_to = Window.partitionBy(*keys, "kind").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"to": F.sum("n").over(up_to), "of": F.sum("n").over(Window.partitionBy(*keys, "kind"))}).where(F.col("to") >= F.ceil(F.col("of") * 0.99))
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("x")))
    return ranked.groupBy(*keys).agg(least("limit").alias("top"), least("output").alias("used"), F.max(F.when(F.col("kind") == "limit", F.col("of"))).alias("n"))


def output_budget(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL006: nearest-rank 99th percentile of the limit over twice that of the output; requests are counted by value first."""
    pairs = traces.where(F.col("max_output_tokens").isNotNull() & F.col("output_tokens").isNotNull())
    values = F.array(F.struct(F.lit("limit").alias("kind"), F.col("max_output_tokens").cast("long").alias("x")), F.struct(F.lit("output").alias("kind"), F.col("output_tokens").cast("long").alias("x")))
    counts = pairs.select(*keys, F.explode(values).alias("v")).groupBy(*keys, "v.kind", "v.x").agg(F.count(F.lit(1)).alias("n"))
    found = nearest_p99(counts, keys).where("n >= 2 and top > used * 2")
    gap = F.col("top") - F.col("used")
    return _result(found, keys, "TL006", F.col("n"), gap, F.bround(gap * F.col("n") * 0.1, 0), gap * F.col("n"))


def repeated_intents(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL007: last user messages, white space and case aside, that recur within tenant and workload."""
    users = F.filter("messages", lambda m: m["role"] == "user")
    prompt = F.lower(F.trim(F.regexp_replace(F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.lit("")), r"\s+", " ")))
    rows = traces.withColumns({"prompt": prompt, "t": F.coalesce("tenant", F.lit("default")), "w": F.coalesce("workload", F.lit("default"))}).where("prompt <> ''")
    groups = rows.groupBy(*keys, "t", "w", "prompt").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("again"))
    found = found.where("groups > 0")
    return _result(found, keys, "TL007", F.col("groups"), F.col("again"), F.col("again"), F.col("again"))


def model_sizing(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TL008: bounded work on larger models; both shares must reach a fifth of what could be judged."""
    text = F.lower(contents(F.col("messages"), "user", " "))
    shape = F.lower(F.coalesce("task_type", F.lit("")))
    rows = traces.where(known_model(F.col("model_name"))).withColumns({"text": text, "shape": shape}).where("trim(text) <> '' or shape <> ''")
    pattern = "|".join(fixed.BOUNDED_TERMS)
    bounded = F.col("text").rlike(pattern) | F.col("shape").rlike(pattern) | ((F.length("text") < 120) & F.coalesce(F.col("output_tokens") < 160, F.lit(False)))
    large = ~F.lower("model").rlike("mini|nano")
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bounded).alias("bounded"), F.count_if(large).alias("large"))
    found = found.where("n > 0 and bounded / n >= 0.2 and large / n >= 0.2")
    null = F.lit(None)
    return _result(found, keys, "TL008", F.col("bounded"), F.col("n"), null, null)


def evidence(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FLT7: the kinds of evidence that a slice's traces have, as a sorted list ``available``, and whether all are buckets."""
    some = lambda cond, *names: [F.when(F.coalesce(F.bool_or(cond), F.lit(False)), F.lit(n)) for n in names]
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    flags = [
        *some(F.size("messages") > 0, "messages"),
        *some(F.size("tools") > 0, "tools"),
        *some(F.size("retrieved_chunks") > 0, "retrieved_chunks"),
        *some(F.col("max_output_tokens") > 0, "max_output_tokens"),
        *some(F.col("output_tokens").isNotNull(), "output_tokens"),
        *some(filled("retry_of"), "retry_of"),
        *some(F.col("retry_count") > 0, "retry_count"),
        *some((F.size("messages") > 0) | filled("task_type"), "task_shape_evidence"),
        *some(F.col("prefix_tokens").isNotNull(), "system_prompt_tokens"),
        *some(filled("fingerprint"), "system_prompt_fingerprint"),
        *some((F.size("messages") > 0) | filled("fingerprint"), "request_fingerprint"),
        *some(known_model(F.col("model_name")), "model_identity"),
    ]
    buckets = F.bool_and(F.coalesce(F.col("record_type") == "foundry_metric_bucket", F.lit(False))).alias("only_buckets")
    return traces.groupBy(*keys).agg(F.array_sort(F.array_compact(F.array(*flags))).alias("available"), buckets)


def applicability(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FLT8, FLT9: for each slice and rule whether it can run, and the closest unmet evidence if not."""
    arrays = lambda sets: F.array(*[F.array(*[F.lit(x) for x in s]) for s in sets])
    rules = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("title"), F.lit(b).alias("takes_buckets"), arrays(s).alias("sets")) for r, t, b, s in fixed.RULES])
    rows = found.select(*keys, "available", "only_buckets", F.explode(rules).alias("r")).select(*keys, "available", "only_buckets", "r.*")
    unmet = F.transform("sets", lambda s: F.array_except(s, F.col("available")))
    fewest = F.array_min(F.transform(unmet, lambda u: F.size(u)))
    closest = F.filter(unmet, lambda u: F.size(u) == fewest)[0]
    barred = F.col("only_buckets") & ~F.col("takes_buckets")
    missing = F.when(barred, F.col("sets")[0]).otherwise(closest)
    return rows.select(*keys, "rule_id", "title", missing.alias("missing"), (~barred & (F.size(closest) == 0)).alias("runs"))


def request_facts(traces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A narrow row a request: what the rules and the evidence need, with hashes in place of texts."""
    messages, users = F.col("messages"), F.filter("messages", lambda m: m["role"] == "user")
    prompt = F.trim(contents(messages, "system", "\n"))
    text = F.trim(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n"))
    intent = F.lower(F.trim(F.regexp_replace(F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.lit("")), r"\s+", " ")))
    asked, shape, pattern = F.lower(contents(messages, "user", " ")), F.lower(F.coalesce("task_type", F.lit(""))), "|".join(fixed.BOUNDED_TERMS)
    named = lambda c: F.coalesce(F.col(c), F.lit("default"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    context = count_messages(messages)
    judged = known_model(F.col("model_name")) & ((F.trim(asked) != "") | (shape != ""))
    return traces.select(
        *keys,
        "ingest_seq",
        F.when(prompt != "", F.sha2(prompt, 256)).alias("prompt"),
        F.when(prompt != "", count_text(prompt)).alias("prompt_tokens"),
        F.when(filled("fingerprint") & (F.col("prefix_tokens") > 0), F.col("fingerprint")).alias("fingerprint"),
        "prefix_tokens",
        F.when((F.size("messages") >= 5) & (context > 0), context).alias("long_context"),
        F.array_distinct("tools").alias("defined"),
        F.array_distinct(F.flatten(F.transform("messages", lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<string>"))))).alias("called"),
        F.when(F.size("tools") > 0, count_tools(F.col("tools_json"))).otherwise(0).alias("tools_tokens"),
        (filled("retry_of") | (F.coalesce(F.col("retry_count"), F.lit(0)) > 0)).alias("explicit"),
        F.coalesce(F.col("input_tokens"), context).alias("cost"),
        F.when(text != "", F.sha2(text, 256)).alias("text"),
        "max_output_tokens",
        "output_tokens",
        F.when(intent != "", F.sha2(F.to_json(F.struct(named("tenant"), named("workload"), intent)), 256)).alias("intent"),
        judged.alias("judged"),
        (judged & (asked.rlike(pattern) | shape.rlike(pattern) | ((F.length(asked) < 120) & F.coalesce(F.col("output_tokens") < 160, F.lit(False))))).alias("bounded"),
        (judged & ~F.lower("model").rlike("mini|nano")).alias("large"),
        F.coalesce(F.size("messages") > 0, F.lit(False)).alias("has_messages"),
        F.coalesce(F.size("retrieved_chunks") > 0, F.lit(False)).alias("has_chunks"),
        filled("retry_of").alias("has_retry_of"),
        (F.coalesce(F.col("retry_count"), F.lit(0)) > 0).alias("has_retry_count"),
        filled("task_type").alias("has_task_type"),
        F.col("prefix_tokens").isNotNull().alias("has_prefix_tokens"),
        filled("fingerprint").alias("has_fingerprint"),
        known_model(F.col("model_name")).alias("has_model"),
        F.coalesce(F.col("record_type") == "foundry_metric_bucket", F.lit(False)).alias("is_bucket"),
    )


def slice_evidence(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, available, only_buckets) and the slice's own sums, from ``request_facts``."""
    some = lambda cond, *names: [F.when(F.coalesce(F.bool_or(cond), F.lit(False)), F.lit(n)) for n in names]
    flags = [
        *some(F.col("has_messages"), "messages"),
        *some(F.size("defined") > 0, "tools"),
        *some(F.col("has_chunks"), "retrieved_chunks"),
        *some(F.col("max_output_tokens") > 0, "max_output_tokens"),
        *some(F.col("output_tokens").isNotNull(), "output_tokens"),
        *some(F.col("has_retry_of"), "retry_of"),
        *some(F.col("has_retry_count"), "retry_count"),
        *some(F.col("has_messages") | F.col("has_task_type"), "task_shape_evidence"),
        *some(F.col("has_prefix_tokens"), "system_prompt_tokens"),
        *some(F.col("has_fingerprint"), "system_prompt_fingerprint"),
        *some(F.col("has_messages") | F.col("has_fingerprint"), "request_fingerprint"),
        *some(F.col("has_model"), "model_identity"),
    ]
    return facts.groupBy(*keys).agg(
        F.array_sort(F.array_compact(F.array(*flags))).alias("available"),
        F.bool_and("is_bucket").alias("only_buckets"),
        F.count("long_context").alias("long_n"),
        F.sum("long_context").alias("long_total"),
        F.sum("tools_tokens").alias("tools_tokens"),
        F.count_if("explicit").alias("explicit_n"),
        F.sum(F.when(F.col("explicit"), F.col("cost"))).alias("explicit_cost"),
        F.count_if(F.col("max_output_tokens").isNotNull() & F.col("output_tokens").isNotNull()).alias("pairs"),
        F.count_if("judged").alias("judged"),
        F.count_if("bounded").alias("bounded"),
        F.count_if("large").alias("large"),
    )


def repeated_things(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, value, n, first, tokens, last_tokens, defined, called): everything that rules count by, counted in one pass.

    Kinds are prompts, fingerprints, whole texts, intents, tools, output limits and outputs.
    """
    thing = lambda kind, value, tokens=F.lit(None), defined=F.lit(False): F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), tokens.cast("long").alias("tokens"), defined.alias("defined"))
    pair = F.col("max_output_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    single = F.array(
        thing("prompt", F.col("prompt"), F.col("prompt_tokens")),
        thing("fingerprint", F.col("fingerprint"), F.col("prefix_tokens")),
        thing("text", F.col("text"), F.col("cost")),
        thing("intent", F.col("intent")),
        thing("limit", F.when(pair, F.col("max_output_tokens")), F.col("max_output_tokens")),
        thing("output", F.when(pair, F.col("output_tokens")), F.col("output_tokens")),
    )
    tools = F.concat(F.transform("defined", lambda t: thing("tool", t, defined=F.lit(True))), F.transform("called", lambda t: thing("tool", t)))
    things = facts.select(*keys, "ingest_seq", F.explode(F.concat(F.filter(single, lambda x: x["value"].isNotNull()), F.coalesce(tools, F.array().cast(tools_type())))).alias("x")).select(*keys, "ingest_seq", "x.*")
    return things.groupBy(*keys, "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first"), F.sum("tokens").alias("tokens"), F.max_by("tokens", "ingest_seq").alias("last_tokens"), F.bool_or("defined").alias("defined"), F.bool_or(~F.col("defined")).alias("called")
    )


def tools_type() -> str:
    return "array<struct<kind:string,value:string,tokens:bigint,defined:boolean>>"


def evaluate(traces: DataFrame, keys: Sequence[str] = (), chunks: DataFrame | None = None) -> DataFrame:
    """TLRUN, TLALL: each slice's rules with status finding, no_issue or not_evaluated, and what a finding says.

    Traces are read once; the rules share one aggregation by what recurs and one by slice.  ``chunks`` (a row a chunk, for
    ``redundant_chunk_rows``) are the retrieved chunks of the slices; without them, those in the traces are.
    """
    facts = written(request_facts(traces, keys), "request-facts")
    if chunks is None:
        held = traces.where(F.size("retrieved_chunks") > 0)
        chunks = held.select(*keys, "ingest_seq", F.posexplode("retrieved_chunks").alias("place", "chunk"))
    slices = written(slice_evidence(facts, keys), "slices")
    things = written(repeated_things(facts, keys), "repeated")
    redundant = written(redundant_chunk_rows(chunks, keys), "redundant")

    sizes = things.where("kind in ('limit', 'output')").withColumnRenamed("last_tokens", "x")
    p99 = nearest_p99(sizes, keys).drop("n")

    kind = lambda name, also=F.lit(True): (F.col("kind") == name) & also
    leader = lambda name: F.max_by(F.struct("n", "last_tokens"), F.when(F.col("kind") == name, F.struct(F.col("n"), (-F.col("first")).alias("early"))))
    again = F.col("n") > 1
    sums = things.groupBy(*keys).agg(
        leader("prompt").alias("prompt"),
        leader("fingerprint").alias("mark"),
        F.count_if(kind("tool", F.col("defined"))).alias("tools"),
        F.count_if(kind("tool", F.col("defined") & ~F.col("called"))).alias("unused"),
        F.sum(F.when(kind("text", again), F.col("n"))).alias("text_n"),
        F.sum(F.when(kind("text", again), F.col("tokens"))).alias("text_cost"),
        F.count_if(kind("intent", again)).alias("intents"),
        F.sum(F.when(kind("intent", again), F.col("n") - 1)).alias("intents_again"),
    )
    facts_of = beside(beside(slices, sums, keys), p99, keys)

    c, none = F.col, F.lit(None).cast("long")
    lead = F.when(c("prompt.n").isNotNull(), c("prompt")).otherwise(c("mark"))
    repeated = lead["last_tokens"] * (lead["n"] - 1)
    estimate = F.bround(c("long_total") * 0.15, 0)
    spare = F.bround(c("tools_tokens") * c("unused") / F.greatest(F.lit(1), c("tools")), 0)
    retries = F.when(c("explicit_n") > 0, c("explicit_n")).otherwise(c("text_n"))
    retry_cost = F.when(c("explicit_n") > 0, c("explicit_cost")).otherwise(c("text_cost"))
    gap = c("top") - c("used")
    rows = [
        ("TL001", (lead["n"] >= 2) & (repeated >= 100), lead["n"], repeated, F.floor(repeated * 0.72), repeated),
        ("TL002", c("long_n") >= 2, c("long_n"), c("long_total"), F.greatest(F.lit(0.0), F.bround(estimate * 0.6, 0)), estimate),
        ("TL003", (c("unused") > 0) & (c("tools_tokens") >= 100), c("unused"), c("tools_tokens"), F.bround(spare * 0.6, 0), spare),
        ("TL005", retries > 0, retries, retry_cost, F.bround(retry_cost * 0.6, 0), retry_cost),
        ("TL006", (c("pairs") >= 2) & (c("top") > c("used") * 2), c("pairs"), gap, F.bround(gap * c("pairs") * 0.1, 0), gap * c("pairs")),
        ("TL007", c("intents") > 0, c("intents"), c("intents_again"), c("intents_again"), c("intents_again")),
        ("TL008", (c("judged") > 0) & (c("bounded") / F.greatest(F.lit(1), c("judged")) >= 0.2) & (c("large") / F.greatest(F.lit(1), c("judged")) >= 0.2), c("bounded"), c("judged"), none, none),
    ]
    said = F.array(*[F.when(fires, F.struct(F.lit(rule).alias("rule_id"), *[_long(x).alias(n) for n, x in zip(RESULT[1:], values, strict=True)])) for rule, fires, *values in rows])
    found = facts_of.select(*keys, F.explode(F.array_compact(said)).alias("f")).select(*keys, "f.*").unionByName(redundant)

    held = chunks.select(*keys).distinct() if keys else chunks.limit(1).select(F.lit(1).alias("one")).drop("one")
    with_chunks = slices.select(*keys, "available", "only_buckets").unionByName(held.withColumns({"available": F.array(F.lit("retrieved_chunks")), "only_buckets": F.lit(True)}))
    available = with_chunks.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("available")))).alias("available"), F.bool_and("only_buckets").alias("only_buckets"), F.count(F.lit(1)).alias("sides"))
    # a slice of chunks alone isn't one of buckets
    available = available.withColumn("only_buckets", F.col("only_buckets") & ~((F.col("sides") == 1) & (F.col("available") == F.array(F.lit("retrieved_chunks")))))
    can = applicability(available, keys)
    out = beside(can, found, [*keys, "rule_id"])
    status = F.when(~F.col("runs"), "not_evaluated").when(F.col("affected").isNotNull(), "finding").otherwise("no_issue")
    values = [F.when(F.col("runs"), F.col(c)).alias(c) for c in RESULT[1:]]
    return out.select(*keys, "rule_id", status.alias("status"), F.array_join("missing", ",").alias("missing"), *values)


def with_impact(findings: DataFrame, totals: DataFrame, keys: Sequence[str] = (), min_percent: float = 1.0, min_tokens: int = 100_000) -> DataFrame:
    """TLIMP, TLCAT, FLT10: impact in percent of input tokens (of requests for calls), capped at 100, its category and whether it is material.

    ``totals`` has keys, input_tokens and requests.
    """
    facts = totals.select(*keys, "input_tokens", "requests")
    rows = findings.where("status = 'finding'")
    rows = rows.join(facts, list(keys)) if keys else rows.crossJoin(F.broadcast(facts))  # one row without keys
    base = F.when(F.col("rule_id") == "TL007", F.col("requests")).otherwise(F.coalesce("input_tokens", F.lit(0)))
    share = lambda c: F.least(F.lit(100.0), F.round(F.col(c) / F.greatest(F.lit(1), base) * 100, 1))
    top, calls = F.col("impact_max_percent"), F.col("rule_id") == "TL007"
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in fixed.SEVERITY.items() for x in pair]), F.col("rule_id"))
    return rows.withColumns({"impact_min_percent": share("min_savings"), "impact_max_percent": share("max_savings"), "severity": severity}).withColumn(
        "material", (F.coalesce(top, F.lit(0.0)) >= min_percent) | (calls & (F.col("max_savings") > 0)) | (~calls & (F.coalesce(F.col("max_savings"), F.lit(0)) >= min_tokens))
    )


def finding_order() -> list[Column]:
    """The order of findings: impact, savings, severity, id."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in {"high": 0, "medium": 1, "low": 2, "info": 3}.items() for x in pair]), F.col("severity"))
    return [F.coalesce("impact_max_percent", F.lit(0.0)).desc(), F.coalesce("max_savings", F.lit(0)).desc(), rank, F.col("rule_id")]


def top_findings(findings: DataFrame, keys: Sequence[str] = (), n: int = 3) -> DataFrame:
    """SRT2, SRT3: a slice's ``n`` first material findings."""
    order = Window.partitionBy(*keys).orderBy(*finding_order())
    return findings.where("material").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
