"""Line-first quality rules: judge each line, remove the failures, reject documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import WORD_SPLIT

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated three-word windows
MAX_LOST = 30  # percent of a document's word characters that removed lines may hold
BOILERPLATE = ("all rights reserved|licensed under|released under the|cookie (policy|settings)|privacy policy|"
               "terms of (use|service)|enable javascript|lorem ipsum")
SHORT_LINE = 20  # words up to which a line is judged as boilerplate


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPLIT), "")


def line_fails(line: Column, words: Column) -> Column:
    """Punctuation, navigation, symbols and boilerplate, each on one line of ``words`` words; a blank line never fails.

    Fails: no sentence mark at the end of a word; more than one doubled exclamation or question mark in five words;
    more than one navigation separator in ten words; more than one symbol in five words; a short boilerplate line.
    """
    unmarked = ~line.rlike("[.!?…。][\"'”»)\\]]*([\\x20\\x09-\\x0D]|$)")
    shouted = F.regexp_count(line, F.lit("[!?]{2,}")) * 5 > words
    navigation = F.regexp_count(line, F.lit("[|»›•]")) * 10 > words
    symbols = F.regexp_count(line, F.lit("[#*$%&<>]")) * 5 > words
    boilerplate = (words <= SHORT_LINE) & F.lower(line).rlike(BOILERPLATE)
    return (words > 0) & (unmarked | shouted | navigation | symbols | boilerplate)


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base measures, ``base_failed``, ``cleaned`` (the lines that pass) and ``kept``.

    ``kept`` is false where the base rules fail, or where the lines removed hold more than MAX_LOST percent of the
    word characters. One row per row; a null text counts as the empty one, which fails. Work per row follows the
    text, sorted once; columns named like the results are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "kept"]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = (df.drop(*(c for c in made if c != text))
            .withColumn("__text", whole)
            .withColumns({"__words": words_of(F.col("__text")), "__lines": F.split("__text", "\n", -1)})
            .withColumn("__n", F.size("__words")))
    n, some = F.col("__n"), F.greatest(F.col("__n") - 2, F.lit(0))
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.arrays_zip(F.arrays_zip(*(F.slice("__words", k, some).alias(f"w{k}") for k in (1, 2, 3))).alias("w"), places.alias("at"))
    counted = F.transform("__lines", lambda line: F.struct(line.alias("line"), F.size(words_of(line)).alias("n")))
    step = (step.withColumns({
        "__sorted": F.sort_array(windows),
        "__counted": counted}))
    # equal windows are neighbours; both of each equal pair are repeats, and each covers three words
    step = step.withColumns({
        "__pairs": F.filter(F.arrays_zip(F.col("__sorted").alias("x"), F.slice("__sorted", 2, some).alias("y")), lambda p: p["x"]["w"] == p["y"]["w"]),
        "__worded": F.filter("__counted", lambda x: x["n"] > 0).getField("line"),
        "__good": F.filter("__counted", lambda x: ~line_fails(x["line"], x["n"])).getField("line")})
    repeats = F.array_distinct(F.concat(F.col("__pairs").getField("x").getField("at"), F.col("__pairs").getField("y").getField("at")))
    step = (step.withColumn("__repeats", repeats)
            .withColumns({
                "n_words": n.cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
                "n_repeat_words": F.size(F.array_distinct(F.concat(
                    "__repeats", F.transform("__repeats", lambda p: p + 1), F.transform("__repeats", lambda p: p + 2)))).cast("long"),
                "cleaned": F.array_join("__good", "\n"),
                # a filter on the result would otherwise be pushed below these columns, and compute them anew in itself
                "__fixed": F.rand(0)}))
    left = F.when(F.size("__good") == F.size("__lines"), F.col("word_chars")).otherwise(F.length(F.array_join(words_of(F.col("cleaned")), "")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (step.withColumn("base_failed", failed)
            .withColumn("kept", (F.col("__fixed") >= 0) & ~F.col("base_failed") & (100 * (F.col("word_chars") - left) <= MAX_LOST * F.col("word_chars")))
            .select(*[c for c in df.columns if c not in made or c == text], *made))
