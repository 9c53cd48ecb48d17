"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

A rule rejects texts whose figure lies beyond its cutoff. The cutoffs of all rules form one path of
levels from lenient to strict: a text that a level rejects is rejected by every stricter one. Per
stratum (the text's language) a level of the path is chosen on labelled texts: level after level, an
exact binomial test must reject, at level ERROR divided by the number of strata, that all rules together
falsely reject more than RISK of the stratum's good texts; the first level that fails ends the walk, and
the level before it is taken. Hypotheses that are tested in a fixed order up to the first failure need no
correction among each other, and Bonferroni's over the strata makes the whole family: with probability
1 - ERROR at most RISK of the good texts of every stratum are rejected. A stratum whose first level fails
has no rules; with four strata and no false rejection 86 good labelled texts are enough for a rule.

Null and empty texts have no words and fail the base rules. A null language is a stratum of its own;
strata without labelled texts have no rules. Repeated rows are judged alike; texts with contradicting
labels count as bad; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize

RISK = 0.05
ERROR = 0.05
WINDOW = 5
LEVELS = 6
#: Rule -> (figure as SQL over the columns of `figures`, the LEVELS cutoffs from lenient to strict). Figures are
#: per 1000 (long_words: hundredths of a character); a text is rejected if its figure exceeds the cutoff.
RULES = {
    "symbols": ("1000 * n_symbols div n_words", (500, 250, 100, 50, 20, 5)),
    "bars": ("1000 * n_bars div n_words", (500, 250, 100, 50, 20, 5)),
    "capitals": ("1000 * n_upper div greatest(word_chars, 1)", (700, 500, 300, 200, 150, 100)),
    "marks": ("1000 * n_marks div n_words", (1000, 500, 250, 100, 50, 25)),
    "repeated_words": ("1000 * n_repeat_words div n_words", (175, 150, 125, 100, 50, 20)),
    "repeated_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (500, 400, 300, 200, 100, 50)),
    "long_words": ("100 * word_chars div n_words", (1200, 1000, 900, 800, 700, 650)),
}
_BLANKS = " \t\n\x0b\f\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated(hashes: Column, words: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order of their start."""

    def covered(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda x, i: (x["h"] == F.get(sorted_, i - 1)["h"]) | (x["h"] == F.get(sorted_, i + 1)["h"]))
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-words).cast("int").alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(words), i - s["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(starts, state, step, lambda s: s["n"])

    # A text without any repeated window, the usual case, needs no sorting.
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(ordered, covered))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, the stratum and the figures of every whole text: no shuffle, one pass."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"))
    parts = base.withColumn("words", F.filter(F.split("text", _SPLIT), lambda w: w != ""))
    first = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    span = F.sequence(F.lit(0), F.size("words") - WINDOW)
    windows = lambda h: F.transform(span, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, _BLANKS)) > 0)
    tight = F.length(_without(F.col("text"), _BLANKS))
    return (
        parts.withColumn("hashes", F.when(F.size("words") >= WINDOW, _let(first, windows)).otherwise(none))
        .withColumn("lines", lines)
        .select(
            "doc_id",
            "stratum",
            F.size("words").cast("long").alias("n_words"),
            tight.cast("long").alias("word_chars"),
            (F.length("text") - F.length(_without(F.col("text"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeated(F.col("hashes")).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.length("text") - F.length(_without(F.col("text"), "|"))).cast("long").alias("n_bars"),
            (F.length("text") - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_marks"),
            (F.length("text") - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial with n trials of chance p, summed in logarithms; n is at least 1."""
    odds = math.log(p / (1 - p))
    state = F.struct((n * F.lit(math.log1p(-p))).cast("double").alias("term"), (n * F.lit(math.log1p(-p))).cast("double").alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.cast("double").alias("term"), (high + F.log1p(F.exp(low - high))).cast("double").alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, state, step, lambda s: s["sum"]))


def rejected_at(level: Column) -> Column:
    """Whether any rule rejects a text with `figures` columns at a level of the path, 1 to LEVELS; level 0 rejects nothing."""
    parts = [F.expr(sql) > F.element_at(F.array(*map(F.lit, cuts)), level) for sql, cuts in RULES.values()]
    any_ = parts[0]
    for part in parts[1:]:
        any_ = any_ | part
    return F.when((level > 0) & (F.col("n_words") > 0), any_).otherwise(F.lit(False))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, level): the strictest level of the path that each stratum's labels allow, from figures and labels (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = measured.where(~base_failed()).join(known.where("quality = 1").select("doc_id"), "doc_id")
    over = [F.count_if(rejected_at(F.lit(level))).alias(f"k{level}") for level in range(1, LEVELS + 1)]
    counts = materialize(good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over), "quality-counts")  # a row per stratum
    tests = [F.struct(F.lit(level).alias("level"), F.col(f"k{level}").alias("k")) for level in range(1, LEVELS + 1)]
    long = counts.select("stratum", "n", F.explode(F.array(*tests)).alias("t")).select("stratum", "n", "t.*")
    alpha = error / max(1, counts.count())
    # binomial_tail is walked only where k can pass at all
    passes = F.when(F.col("k") <= F.col("n") * risk, binomial_tail(F.col("k"), F.col("n"), risk) <= alpha).otherwise(F.lit(False))
    failing = F.min(F.when(~passes, F.col("level")))
    return long.groupBy("stratum").agg((F.coalesce(failing, F.lit(LEVELS + 1)) - 1).alias("level"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The base columns of every row, base_failed and kept."""
    measured = materialize(figures(docs), "quality-figures")  # narrow: eleven numbers per text
    # A row per language; whether it is broadcast is decided by its size as written.
    chosen = materialize(thresholds(measured, labels, risk, error).withColumnRenamed("stratum", "s"), "quality-levels")
    judged = measured.join(chosen, F.col("s") == F.col("stratum"), "left").withColumn("base_failed", base_failed())
    rejected = rejected_at(F.coalesce("level", F.lit(0)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
