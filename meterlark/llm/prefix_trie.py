"""The trie of conversations' prefixes, by names of blocks that double.

Turns are named: equal (role, text) have equal dense numbers.  Blocks of 2, 4, 8, ... turns that begin at multiples of their
length are named from the names of their halves, one join a doubling.  A prefix of ``d`` turns is the sequence of
blocks that ``d``'s binary digits name: its name comes from the name of the prefix without the lowest digit and that digit's
block, one join for each further digit.  Equal (depth, name) are one node.  So a conversation of a million turns takes
20 rounds and 19 more, and no row ever holds a sequence of turns.

What holds for a whole subtree (leaves, tokens) is summed by doubling too: what a node has gathered from fewer than
2^k levels below goes to the ancestor 2^k levels above, which its smallest member names.

No conversation, node or turn is gathered in a task: places within a conversation come from a global sort,
keys of joins are (conversation, place) or names, whose repetitions adaptive execution splits, and counts are combined
before they travel.  A node's ending conversations must pass one SHA-256 in order: sorted ids are joined to
pieces in many tasks, and one task streams a node's pieces.

Defined results: rows without a conv_id take no part; null role or text is empty text; turns come in ascending order, null
first, equal turns by role and content hash; repeated rows are turns of their own; an empty table gives an empty result;
other columns are ignored.  Contents are told apart by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize

IN_TASK = 33  # bits of monotonically_increasing_id() that count within a task
IDS = 4096  # ids that travel in a piece


def written_in_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with ``pt_number``: 0, 1, 2, ... in the order of its partitions and rows."""
    table = materialize(df.withColumn("pt_at", F.monotonically_increasing_id()), name)
    task, within = F.shiftright("pt_at", IN_TASK), F.col("pt_at").bitwiseAND(F.lit((1 << IN_TASK) - 1))
    sizes = table.groupBy(task.alias("pt_task")).agg(F.count("*").alias("pt_n"))
    before = F.coalesce(F.sum("pt_n").over(Window.orderBy("pt_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a task that wrote the table
    offsets = F.broadcast(sizes.select("pt_task", before.alias("pt_before")))
    return table.withColumn("pt_task", task).join(offsets, "pt_task").withColumn("pt_number", F.col("pt_before") + within).drop("pt_at", "pt_task", "pt_before")


def named(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name`` in place of ``keys``: a dense number that rows with equal keys share."""
    names = written_in_order(rows.select(*keys).distinct(), "names").withColumnRenamed("pt_number", name)
    return rows.join(names, list(keys)).drop(*keys)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, at, content, words): turns of each conversation from 0 in their order."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("content"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
    )
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]
    turns = written_in_order(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "content", "words"), "turns")
    firsts = turns.groupBy("c").agg(F.min("pt_number").alias("first"))
    return turns.join(firsts, "c").select("c", (F.col("pt_number") - F.col("first")).alias("at"), "content", "words")


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which conversation c begins with the first h turns of conversation c - c % ``group``, followed by its own after its first h; h is c's crc32 modulo ``most``."""
    c = F.col("c")
    every = turns.groupBy("c").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(c.cast("string").cast("binary")) % most, "b": c - c % group})
    sizes = every.select(F.col("c").alias("b"), F.col("n").alias("b_n"))
    plan = materialize(every.join(sizes, "b", "left").select("c", "b", "h", F.least("h", F.coalesce("b_n", F.lit(0).cast("long"))).alias("head")), "conversations")
    own = turns.join(plan.select("c", "h", "head"), "c").where(F.col("at") >= F.col("h")).select("c", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "content", "words")
    heads = turns.where((c % group == 0) & (F.col("at") < most - 1)).withColumnRenamed("c", "b")
    taken = plan.where("head > 0").join(heads, "b").where(F.col("at") < F.col("head")).select("c", "at", "content", "words")
    return plan.select("c"), materialize(own.unionByName(taken), "rebuilt")


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(c, d, name): the name of each conversation's first d turns, unique among prefixes of d turns."""
    blocks = [materialize(named(turns.select("c", F.col("at").alias("k"), "content"), ["content"], "name"), "blocks")]
    while 2 << (len(blocks) - 1) <= longest:
        side = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.col("name")))
        halves = blocks[-1].groupBy("c", F.shiftright("k", 1).alias("half")).agg(side(0).alias("left"), side(1).alias("right")).withColumnRenamed("half", "k")
        blocks.append(materialize(named(halves.where("left is not null and right is not null"), ["left", "right"], "name"), "blocks"))
    # a block at an even place ends exactly one prefix: the one whose lowest digit it is
    ends = [b.where("k % 2 = 0").select("c", F.shiftleft(F.col("k") + 1, j).alias("d"), F.shiftleft("k", j).alias("rest"), "name") for j, b in enumerate(blocks)]
    last = ends[0]
    for more in ends[1:]:
        last = last.unionByName(more)
    known = [last.where("rest = 0").select("c", "d", "name")]
    for digits in range(2, longest.bit_length() + 1):
        shorter = known[-1].select("c", F.col("d").alias("rest"), F.col("name").alias("left"))
        pairs = last.where(F.bit_count("d") == digits).withColumnRenamed("name", "right").join(shorter, ["c", "rest"]).drop("rest")
        pairs = pairs.withColumn("depth", F.col("d"))
        known.append(materialize(named(pairs, ["depth", "left", "right"], "name").select("c", "d", "name"), "prefixes"))
    out = known[0]
    for more in known[1:]:
        out = out.unionByName(more)
    return out


def joined_ids(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, c): SHA-256 of a node's ids c, ascending, with commas between."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def piece():
            out.append((*node, ids[0], ",".join(map(str, ids))))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])], ["conv_id", "depth", "first", "ids"])

        for b in batches:
            for owner, depth, c in zip(*(b.column(n).to_pylist() for n in ("conv_id", "depth", "c")), strict=True):
                if (owner, depth) != node or len(ids) == IDS:
                    if ids:
                        piece()
                    node, ids = (owner, depth), []
                ids.append(c)
            if len(out) >= IDS or sum(len(r[3]) for r in out) > 1 << 20:
                yield batch()
                out.clear()
        if ids:
            piece()
        if out:
            yield batch()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for owner, depth, ids in zip(*(b.column(n).to_pylist() for n in ("conv_id", "depth", "ids")), strict=True):
                if (owner, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], ["conv_id", "depth", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])

    pieces = rows.repartitionByRange("conv_id", "depth", "c").sortWithinPartitions("conv_id", "depth", "c").mapInArrow(join, "conv_id long, depth long, first long, ids string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node of the prefix trie of ``conversations`` (c) and their ``turns`` (c, at, content, words).

    conv_id (smallest member) and depth name a node; parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    conversations = materialize(conversations, "members")
    longest = (turns.agg(F.max("at")).first()[0] or 0) + 1
    found = materialize(prefixes(turns, longest), "prefixes")
    root = conversations.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").withColumn("depth", F.lit(0).cast("long"))
    top = root.select("conv_id").first()
    top = F.lit(top[0] if top else None).cast("long")
    groups = materialize(found.groupBy("d", "name").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    # the node that each conversation passes at each depth, named by its smallest member
    passed = materialize(found.join(groups.select("d", "name", "conv_id"), ["d", "name"]).select("c", "d", "conv_id"), "passed")
    nodes = groups.select("conv_id", F.col("d").alias("depth"), "n_convs")

    def above(rows: DataFrame, levels: int) -> DataFrame:
        """``rows`` (conv_id, depth, ...) deep enough, with ``above``: the smallest member of the node ``levels`` above."""
        deep = rows.where(F.col("depth") >= levels).withColumn("d", F.col("depth") - levels)
        under_root = deep.where("d = 0").withColumn("above", top)
        return under_root.unionByName(deep.where("d > 0").join(passed.select(F.col("c").alias("conv_id"), "d", F.col("conv_id").alias("above")), ["conv_id", "d"]))

    last = turns.select(F.col("c").alias("conv_id"), (F.col("at") + 1).alias("depth"), "words")
    nodes = materialize(above(nodes.join(last, ["conv_id", "depth"]), 1).drop("d"), "nodes")
    children = nodes.groupBy(F.col("above").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    everyone = nodes.unionByName(root.withColumns({"words": F.lit(0).cast("long"), "above": F.lit(None).cast("long")}))
    everyone = everyone.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    everyone = materialize(everyone, "nodes")

    sums = everyone.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    levels = 1
    while levels <= longest:
        upward = above(sums, levels).select(F.col("above").alias("conv_id"), F.col("d").alias("depth"), "n_leaves", "saved_tokens")
        both = sums.unionByName(upward).groupBy("conv_id", "depth")
        sums = materialize(both.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "subtrees")
        levels *= 2

    lengths = conversations.join(turns.groupBy("c").agg(F.count("*").alias("d")), "c", "left")
    turnless = lengths.where("d is null").select(top.alias("conv_id"), F.lit(0).cast("long").alias("depth"), "c")
    ending = lengths.where("d is not null").join(passed, ["c", "d"]).select("conv_id", F.col("d").alias("depth"), "c").unionByName(turnless)
    none = hashlib.sha256(b"").hexdigest()
    return (
        everyone.join(sums, ["conv_id", "depth"])
        .join(joined_ids(ending), ["conv_id", "depth"], "left")
        .select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )


def trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = materialize(numbered_turns(conversations), "turns")
    return trie(turns.select("c").distinct(), turns)


def trie_of_rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations that begin with another's first turns (``with_shared_heads``)."""
    return trie(*with_shared_heads(materialize(numbered_turns(conversations), "turns"), group, most))
