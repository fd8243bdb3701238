"""Quality rules: counts over a text, and cross-document line frequency within a host.

A line is normalised (trimmed, lower-cased, runs of white space one space, runs of digits one zero) and hashed.  For every host
the different texts that hold a line are counted; a line is over the limits if it stands in more than ``most_texts``
texts and in more than ``most_share`` of the host's texts.  Such lines are removed, and a document is rejected when
what remains has fewer than ``least_words`` words or less than ``least_left`` of its words.  Counting texts instead of rows keeps a
copied document from making its own lines common.

All of it is column expressions.  Texts are read once: what the second pass needs (counts, one hash and one number of
words a line) is written.  A common line is counted by (host, line, text) before it is counted by (host, line),
and where its rows are looked up, each line over the limits stands in ``salts`` parts, so no key's rows meet in a task.

Defined results: null and empty texts have no lines and fail the base rules; a null host is a host of its own; repeated
rows are judged alike; a line without a word is no line; an empty table gives an empty result; all columns of ``docs``
are carried and none may begin with ``lf_``.  Lines are told apart by 64 bits within a host.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8  # words of a window that counts as repeated


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in windows of ``width`` words that a text holds at least twice, the first such window included.

    Windows are compared by 64-bit hashes.  Only texts that hold a window twice are sorted.
    """

    def covered(places: Column) -> Column:
        until = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
        return F.aggregate(until, F.lit(0).cast("long"), lambda total, n: total + n)

    def twice(pairs: Column) -> Column:
        same = lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])
        return F.array_sort(F.transform(F.filter(pairs, lambda p, i: F.coalesce(same(p, i), F.get(pairs, i + 1)["h"] == p["h"], F.get(pairs, i - 1)["h"] == p["h"], F.lit(False))), lambda p: p["p"]))

    def of_windows(windows: Column) -> Column:
        sorted_pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        found = bind(bind(sorted_pairs, twice), covered)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)

    def doubled(spans: Column, step: int, use: Callable[[Column], Column]) -> Column:
        """Hashes of spans twice as long as ``step`` words, from those of ``step`` words."""
        if step == width:
            return use(spans)
        left, right = F.slice(spans, F.lit(1), F.size(spans) - F.lit(step)), F.slice(spans, F.lit(step + 1), F.size(spans) - F.lit(step))
        return bind(F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)), lambda longer: doubled(longer, 2 * step, use))

    if width & (width - 1):
        raise ValueError("the window's width must be a power of two")
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: doubled(hashes, 1, of_windows)))


def normalized(line: Column) -> Column:
    """A line as it is compared between documents."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), r"[0-9]+", "0"), " +", " "))


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without its text, with base counts ``lf_words``, ``lf_chars``, ``lf_symbols``, ``lf_dup_lines``, ``lf_repeats``, ``lf_base_failed`` and, for
    the second pass, ``lf_host``, ``lf_text`` (a hash of the text) and ``lf_lines``: hash and words of its lines with a word."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def facts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), F.char_length(F.array_join(words, "")).cast("long").alias("chars"), repeated_words(words).alias("repeats"))

    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    of_lines = bind(
        lines,
        lambda found: F.struct(
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"),
            F.transform(found, lambda line: F.struct(F.xxhash64(normalized(line)).alias("h"), F.regexp_count(line, F.lit(WORD)).alias("n"))).alias("lines"),
        ),
    )
    rows = docs.withColumns(
        {
            "lf_facts": bind(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), facts),
            "lf_of_lines": of_lines,
            "lf_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
            "lf_text": F.xxhash64(whole),
            "lf_host": F.when(F.col(host).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(host).cast("string"))),
        }
    )
    n, repeats = F.col("lf_facts.n"), F.col("lf_facts.repeats")
    failed = (n < 20) | (100 * repeats > 30 * n)
    return rows.select(
        *[c for c in docs.columns if c != text],
        n.alias("lf_words"),
        F.col("lf_facts.chars").alias("lf_chars"),
        "lf_symbols",
        F.col("lf_of_lines.dup").alias("lf_dup_lines"),
        repeats.alias("lf_repeats"),
        failed.alias("lf_base_failed"),
        "lf_host",
        "lf_text",
        F.col("lf_of_lines.lines").alias("lf_lines"),
    )


def common_lines(rows: DataFrame, most_texts: int, most_share: float) -> DataFrame:
    """(lf_host, lf_line, lf_texts): the lines over the limits, with the number of different texts of the host that hold each."""
    lines = rows.select("lf_host", "lf_text", F.explode(F.array_distinct(F.transform("lf_lines", lambda x: x["h"]))).alias("lf_line"))
    held = lines.groupBy("lf_host", "lf_line").agg(F.count_distinct("lf_text").alias("lf_texts")).where(F.col("lf_texts") > most_texts)
    sizes = rows.groupBy("lf_host").agg(F.count_distinct("lf_text").alias("lf_size"))
    return held.join(sizes, "lf_host").where(F.col("lf_texts") > F.col("lf_size") * F.lit(float(most_share))).drop("lf_size")


def in_common_lines(rows: DataFrame, common: DataFrame, salts: int) -> DataFrame:
    """(lf_row, lf_line, lf_n) of each occurrence of a line over the limits."""
    lines = rows.select("lf_row", "lf_host", F.explode("lf_lines").alias("lf_x")).select("lf_row", "lf_host", F.col("lf_x.h").alias("lf_line"), F.col("lf_x.n").alias("lf_n"))
    parts = common.select("lf_host", "lf_line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("lf_salt"))
    return lines.withColumn("lf_salt", F.pmod(F.xxhash64("lf_row"), F.lit(salts)).cast("int")).join(parts, ["lf_host", "lf_line", "lf_salt"]).select("lf_row", "lf_line", "lf_n")


def judge(docs: DataFrame, text: str = "text", host: str = "source", most_texts: int = 10, most_share: float = 0.01, least_words: int = 20, least_left: float = 0.5, salts: int = 32) -> DataFrame:
    """``docs`` without its text, with the base counts, ``lf_removed`` (words in lines over the limits) and ``lf_kept``."""
    rows = materialize(measured(docs, text, host).withColumn("lf_row", F.monotonically_increasing_id()), "line-rows")
    common = materialize(common_lines(rows, most_texts, most_share), "common-lines")
    removed = in_common_lines(rows, common, salts).groupBy("lf_row").agg(F.sum("lf_n").cast("long").alias("lf_removed"))
    left = F.col("lf_words") - F.col("lf_removed")
    kept = ~F.col("lf_base_failed") & (left >= least_words) & (left >= F.col("lf_words") * F.lit(float(least_left)))
    return (
        rows.drop("lf_lines", "lf_host", "lf_text")
        .join(removed, "lf_row", "left")
        .withColumn("lf_removed", F.coalesce("lf_removed", F.lit(0).cast("long")))
        .withColumn("lf_kept", kept)
        .drop("lf_row")
    )


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", most_texts: int = 10, most_share: float = 0.01, least_words: int = 20, least_left: float = 0.5, salts: int = 32) -> DataFrame:
    """The documents that pass, with the lines over the limits taken out of their texts; columns of ``docs``."""
    numbered = materialize(docs.withColumn("lf_row", F.monotonically_increasing_id()), "line-texts")
    rows = materialize(measured(numbered, text, host), "line-rows")
    common = materialize(common_lines(rows, most_texts, most_share), "common-lines")
    gone = in_common_lines(rows, common, salts).groupBy("lf_row").agg(F.sum("lf_n").cast("long").alias("lf_removed"), F.collect_set("lf_line").alias("lf_gone"))
    left = F.col("lf_words") - F.coalesce("lf_removed", F.lit(0))
    passed = rows.join(gone, "lf_row", "left").where(~F.col("lf_base_failed") & (left >= least_words) & (left >= F.col("lf_words") * F.lit(float(least_left)))).select("lf_row", "lf_gone")
    without = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(WORD) | ~F.array_contains("lf_gone", F.xxhash64(normalized(line)))), "\n")
    return numbered.join(passed, "lf_row").withColumn(text, F.when(F.col("lf_gone").isNull(), F.col(text)).otherwise(without)).select(*docs.columns)
