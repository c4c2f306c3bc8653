"""Operator 7: quality rules as a learned decision list.

Text statistics are Spark expressions. From the statistics of labelled documents,
sequential covering learns an ordered list of rules: each grows a conjunction of threshold
tests by information gain on one part of the rows, is pruned on the other part, and takes
away the rows it covers. The list becomes one chain of conditional expressions, so applying
it is a projection. Only DataFrame functions run on the executors; the driver learns from
at most ``max_labelled`` rows of numbers, picked by hash (a documented bound of the fit).

Defined cases: null and empty texts have no words and fail the base rule; with no bad or no
good label the list is empty and keeps what the base rule keeps; null labels and labels of
unknown documents are ignored; a null id gets statistics and no label; repeated rows get
equal results; an empty table gives an empty result; columns beside those named are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, staged

#: Signs counted, and words in a window.
SIGNS = "#*$%&|<>"
WINDOW = 8
#: What rules test: shares and means, so that a threshold means the same at any length.
FEATURES = ("mean_word", "sign_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "stop_share")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each text."""
    text = F.coalesce("text", F.lit(""))
    # A run of white space is one separator; line feeds are told apart below.
    cut = F.filter(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " ", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    one = docs.select("doc_id", text.alias("text"), cut.alias("words"), lines.alias("lines"))
    return one.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SIGNS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_marks"),
        (F.size("words") - F.size(F.array_distinct("words"))).cast("long").alias("n_again"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows found twice or more.

    Windows of word hashes are hashed and sorted with their places; equal neighbours are
    repeats, and the places of repeats in ascending order give the words they cover together.
    """

    def ordered(hashes: Column) -> Column:
        n = F.size(hashes) - (window - 1)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        hashed = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])
        return F.sort_array(F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))

    def twice(rows: Column) -> Column:
        same = F.transform(
            rows,
            lambda x, k: F.when(
                (F.get(rows, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(rows, k - 1)["h"] == x["h"])), x["i"]
            ),
        )
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashes, lambda h: _let(ordered(h), lambda rows: _let(twice(rows), covered)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def features(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns(
        {
            "mean_word": F.col("word_chars") / words,
            "sign_share": F.col("n_symbols") / chars,
            "dup_line_share": F.col("n_dup_lines") / words,
            "repeat_share": F.col("n_repeat_words") / words,
            "upper_share": F.col("n_upper") / chars,
            "mark_share": F.col("n_marks") / chars,
            "stop_share": F.col("n_again") / words,
        }
    )


# ---------------------------------------------------------------- learning


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def holds(self, row) -> bool:
        return row[self.feature] > self.limit if self.above else row[self.feature] <= self.limit

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)


@dataclass(frozen=True)
class Rule:
    """Documents that pass all tests are rejected."""

    tests: tuple[Test, ...]

    def holds(self, row) -> bool:
        return all(t.holds(row) for t in self.tests)

    def column(self) -> Column:
        out = F.lit(True)
        for test in self.tests:
            out &= test.column()
        return out


def _split(rows: list, feature: str):
    """(gain, test) of the best threshold of one feature for telling bad (0) rows from good (1)."""
    ordered = sorted((r[feature], r["quality"] == 0) for r in rows)
    bad, good = sum(b for _, b in ordered), sum(not b for _, b in ordered)
    before = math.log2(bad / (bad + good))
    low_bad = low_good = 0
    best = (0.0, None)
    for (value, is_bad), (after, _) in zip(ordered, ordered[1:]):
        low_bad, low_good = low_bad + is_bad, low_good + (not is_bad)
        if after == value:
            continue
        limit = (value + after) / 2
        for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
            if b:
                gain = b * (math.log2(b / (b + g)) - before)
                if gain > best[0]:
                    best = (gain, Test(feature, above, limit))
    return best


def _grown(rows: list, most: int) -> Rule:
    tests: list[Test] = []
    while len(tests) < most and any(r["quality"] for r in rows) and any(not r["quality"] for r in rows):
        gain, test = max((_split(rows, f) for f in FEATURES), key=lambda x: x[0])
        if test is None:
            break
        tests.append(test)
        rows = [r for r in rows if test.holds(r)]
    return Rule(tuple(tests))


def _worth(rule: Rule, rows: list) -> float:
    covered = [r["quality"] for r in rows if rule.holds(r)]
    good = sum(covered)
    return (len(covered) - 2 * good) / max(1, len(covered))


def _pruned(rule: Rule, rows: list) -> Rule:
    """Drop final tests as long as that is no worse on the rows kept for pruning."""
    best = rule
    while len(best.tests) > 1 and _worth(shorter := Rule(best.tests[:-1]), rows) >= _worth(best, rows):
        best = shorter
    return best


def learned(rows: list, most_tests: int = 4, most_rules: int = 24, precision: float = 0.95) -> list[Rule]:
    """Sequential covering over labelled rows; ends when a rule is not precise on unseen rows."""
    grow, prune = [r for r in rows if r["part"]], [r for r in rows if not r["part"]]
    rules: list[Rule] = []
    while len(rules) < most_rules and any(not r["quality"] for r in grow) and any(r["quality"] for r in grow):
        rule = _pruned(_grown(grow, most_tests), prune)
        seen = [r["quality"] for r in [*grow, *prune] if rule.holds(r)] if rule.tests else []
        if not seen or 1 - sum(seen) / len(seen) < precision:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not rule.holds(r)] for part in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that rejects, else null."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(number)).otherwise(out)
    return out


def fitted(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    rows = features(stats.join(labels, "doc_id")).where(~base_failed())
    part = (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) > 0).cast("int").alias("part")
    return learned(rows.select(F.col("quality").cast("int").alias("quality"), part, *FEATURES).orderBy("doc_id").collect())


def judged(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (number of the rule that rejects) and ``kept``."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labels")
    stats = staged(statistics(docs), "statistics")  # texts are read once; what follows is numbers
    rules = fitted(stats, picked)
    told = features(stats).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return told.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judged(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
