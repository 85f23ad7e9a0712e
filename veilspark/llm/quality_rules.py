"""Quality rules: a threshold table compiled into one projection, without user functions.

``measure`` adds counts of a text, ``compile_rules`` turns the table into one boolean column.  Only
built-in functions are used and each row is judged by itself: no shuffle, whatever the skew.

Defined results: a null or empty text has zero counts and fails; repeated rows get the same verdict
each; an empty table stays empty; columns of the input that clash with a result column are replaced
by it, other extra columns are dropped by ``judge`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bind, count_of, space_words

# Common function words of English, German, French and Spanish, ASCII only.
STOP_WORDS = ("a an and are as at be but by for from has have he in is it not of on or that the this to was with you "
              "auch auf aus das dem den der des die ein eine er es ist mit nicht sich sie und von zu "
              "au avec ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une "
              "al como con del el las los no para por se su una y").split()
STOP_FORMS = sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})


class Rule(NamedTuple):
    """A text passes if ``low <= metric <= high``; ``None`` leaves a side open."""

    metric: str
    low: float | None
    high: float | None


RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.03, None),
    Rule("upper_ratio", None, 0.5),
    Rule("stutter_ratio", None, 0.2),
    Rule("duplicate_line_ratio", None, 0.6),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)
WINDOW = 8


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` (a power of two) words that occur at least twice in the array.

    Window hashes come from doubling (pairs of pairs of pairs), so the work is linear; only texts
    with a repeated window are sorted.
    """
    def doubled(hashes: Column, step: int) -> Column:
        return bind(hashes, lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)))

    hashes, step = words, 1
    while step < window:
        hashes, step = doubled(hashes, step), step * 2

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.array_sort(F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
                lambda x: x["i"]))

        def length(at: Column) -> Column:
            reach = F.zip_with(at, F.slice(at, 2, F.size(at)),
                               lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
            return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

        return bind(bind(ordered, twice), length)

    def total(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(windows)).otherwise(F.lit(0))

    enough = F.size(words) >= window
    return F.when(enough, bind(F.slice(hashes, 1, F.size(words) - (window - 1)), total)).otherwise(0).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of each text that the rules need."""
    column = F.coalesce(F.col(text), F.lit(""))
    words, lines = F.col("_words"), F.col("_lines")
    return (df.withColumn("_words", space_words(column))
            .withColumn("_lines", F.filter(F.split(column, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
            .withColumns({
                "n_words": F.size(words).cast("long"),
                "word_chars": F.length(F.array_join(words, "")).cast("long"),
                "n_symbols": count_of(column, r"[^#*$%&|<>]+"),
                "n_lines": F.size(lines).cast("long"),
                "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                "n_repeat_words": repeated_words(words),
                "n_stop": F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))).cast("long"),
                "n_stutter": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b),
                                             lambda same: same)).cast("long"),
                "n_upper": count_of(column, "[^A-Z]+"),
                "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*+] "))).cast("long"),
                "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
            }).drop("_words", "_lines"))


def share(part: str, *whole: str) -> Column:
    return F.col(part) / F.greatest(sum((F.col(c) for c in whole), F.lit(0)), F.lit(1))


METRICS = {
    "n_words": lambda: F.col("n_words"),
    "mean_word_length": lambda: share("word_chars", "n_words"),
    "symbol_ratio": lambda: share("n_symbols", "n_words"),
    "stop_ratio": lambda: share("n_stop", "n_words"),
    "upper_ratio": lambda: share("n_upper", "word_chars"),
    "stutter_ratio": lambda: share("n_stutter", "n_words"),
    "duplicate_line_ratio": lambda: share("n_dup_lines", "n_lines"),
    "bullet_line_ratio": lambda: share("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": lambda: share("n_ellipsis_lines", "n_lines"),
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: the text keeps every threshold of the table."""
    passed = F.lit(True)
    for rule in rules:
        value = METRICS[rule.metric]()
        if rule.low is not None:
            passed &= value >= F.lit(rule.low)
        if rule.high is not None:
            passed &= value <= F.lit(rule.high)
    return passed


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key with counts, the base verdict and the verdict of the table."""
    counted = measure(df.select(key, text), text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (counted.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)).drop(text))


def filter_documents(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the input's columns."""
    names = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    apart = df.toDF(*names.values())
    kept = measure(apart, names[text])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return kept.filter(~failed & compile_rules(rules)).select([F.col(n).alias(c) for c, n in names.items()])
