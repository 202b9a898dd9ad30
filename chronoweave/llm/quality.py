"""Quality verdicts by learned decision lists. DataFrame functions only.

Each text is reduced to a few statistics in one pass. From the statistics of labelled rows, sequential covering learns
an ordered list of rules that describe low quality: a rule grows by the threshold condition with the largest
information gain until it is pure, is then pruned (conditions are dropped from its end) on rows that growing didn't see, and is
accepted if it holds there; the rows that it covers leave, and the next rule is grown. At most ``MOST_RULES`` rules of
``MOST_CONDITIONS`` conditions are learned. Thresholds are exact quantiles of the statistics, these rounded to three significant
digits so that their counts are few, so verdicts don't depend on the order in which rows arrive; one aggregate over (statistic, bin) gives all candidates of a step at once and no row reaches the driver.
The list is emitted as one conditional expression, and each rejected row names the rule that applies.

Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and wordless texts have all counts 0 and fail the base. Repeated doc_ids
keep their rows; labels of a doc_id that disagree count as the lower quality. Without labels there are no rules and the
base decides. Other columns are ignored. Repeated 8-word windows are found by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, let, materialize

SPACE, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_bangs"]
#: The statistics that rules may test, each from the counts.
STATISTICS = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_windows": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "upper_case": "n_upper / greatest(word_chars, 1)",
    "exclamations": "n_bangs / greatest(n_words, 1)",
}
MOST_RULES, MOST_CONDITIONS, PURE, ACCEPT, SUPPORT = 6, 3, 0.98, 0.9, 5
QUANTILES = [0.01, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5, 0.7, 0.75, 0.8, 0.85, 0.9, 0.92, 0.95, 0.98, 0.99]


@dataclass(frozen=True)
class Condition:
    """statistic >= threshold, or below it."""

    statistic: int
    bin: int
    above: bool
    threshold: float

    def on_bins(self) -> Column:
        b = F.element_at("bins", self.statistic + 1)
        return b >= self.bin if self.above else b < self.bin

    def on_values(self) -> Column:
        v = F.expr(list(STATISTICS.values())[self.statistic])
        return v >= self.threshold if self.above else v < self.threshold

    def __str__(self) -> str:
        return f"{list(STATISTICS)[self.statistic]} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _all(conditions: list[Condition], side: str) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & getattr(c, side)()
    return out


def _repeated(words: Column) -> Column:
    """Words in windows of eight that stand in the text twice or more."""

    def joined(h: Column, step: int) -> Column:
        return let(h, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))

    def covered(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(tagged, lambda a: F.filter(a, lambda p, j: (p["h"] == F.get(a, j - 1)["h"]) | F.coalesce(p["h"] == F.get(a, j + 1)["h"], F.lit(False))))
        at = F.array_sort(F.transform(twice, lambda p: p["i"]))
        steps = let(at, lambda a: F.transform(a, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(a, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    hashes = joined(joined(joined(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    windows = F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    found = let(windows, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0)).otherwise(covered(a)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(found)


def text_counts(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, ...). Returns doc_id and COUNTS, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), _repeated(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    chars = F.struct(F.length(F.translate(text, SPACE, "")).alias("word"), without(SYMBOLS).alias("symbols"), without(UPPER).alias("upper"), without("!").alias("bangs"))
    found = docs.select("doc_id", F.struct(of_words.alias("w"), of_lines.alias("l"), chars.alias("c")).alias("s"))
    places = {"n_words": "w.n", "word_chars": "c.word", "n_symbols": "c.symbols", "n_dup_lines": "l.d", "n_repeat_words": "w.r", "n_lines": "l.n", "n_distinct": "w.d", "n_upper": "c.upper", "n_bangs": "c.bangs"}
    return found.select("doc_id", *(F.col(f"s.{p}").cast("long").alias(c) for c, p in places.items()))


def _quantiles(rows: DataFrame) -> list[list[float]]:
    """Of each statistic its values at QUANTILES, without repeats; at most some 900 rounded values a decade reach the driver."""

    def rounded(s: str) -> Column:
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.col(s))) - 2)
        return F.when(F.col(s) > 0, F.round(F.col(s) / unit) * unit).otherwise(0.0)

    each = rows.select(F.posexplode(F.array(*map(rounded, STATISTICS))).alias("s", "v")).groupBy("s", "v").agg(F.count("*").alias("n")).collect()
    out = []
    for k in range(len(STATISTICS) if each else 0):
        own = sorted((r["v"], r["n"]) for r in each if r["s"] == k)
        total, seen, found, wanted = sum(n for _, n in own), 0, [], list(QUANTILES)
        for v, n in own:
            seen += n
            while wanted and seen >= wanted[0] * total:
                found.append(v)
                wanted.pop(0)
        out.append(sorted(set(found)))
    return out


def learn_rules(counts: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """counts: of text_counts; labels: (doc_id, quality, ...). Returns the rules for low quality, in order."""
    marks = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") <= 0).cast("int").alias("low"))
    rows = counts.join(marks, "doc_id").select(F.pmod(crc_of_id(), F.lit(3)).alias("part"), "low", *(F.expr(e).alias(s) for s, e in STATISTICS.items()))
    rows = materialize(rows, "labelled")
    thresholds = _quantiles(rows)
    if not thresholds:
        return []

    def bin_of(s: str, t: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, t)), lambda x: x <= F.col(s)))

    bins = [bin_of(s, t) for s, t in zip(STATISTICS, thresholds, strict=True)]
    rows = materialize(rows.select("part", "low", F.array(*bins).alias("bins")), "bins")
    growing, pruning = F.col("part") != 2, F.col("part") == 2
    rules: list[list[Condition]] = []

    def tally(df: DataFrame) -> tuple[int, int]:
        n, p = df.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0))).first()
        return p, n - p

    while len(rules) < MOST_RULES:
        left = rows
        for r in rules:
            left = left.where(~_all(r, "on_bins"))
        rule: list[Condition] = []
        p0, n0 = tally(left.where(growing))
        while len(rule) < MOST_CONDITIONS and p0 >= SUPPORT and n0 and p0 / (p0 + n0) < PURE:
            at = left.where(growing & _all(rule, "on_bins")).select(F.posexplode("bins").alias("s", "b"), "low")
            cells = {(r["s"], r["b"]): (r["p"], r["n"] - r["p"]) for r in at.groupBy("s", "b").agg(F.sum("low").alias("p"), F.count("*").alias("n")).collect()}
            best: tuple = (0.0,)
            for s, t in enumerate(thresholds):
                below = [0, 0]
                for b in range(1, len(t) + 1):
                    for k in (0, 1):
                        below[k] += cells.get((s, b - 1), (0, 0))[k]
                    for above, (p, n) in ((True, (p0 - below[0], n0 - below[1])), (False, tuple(below))):
                        if p >= SUPPORT:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(s, b, above, t[b - 1]), p, n)
            if len(best) == 1 or best[1] in rule:
                break
            rule.append(best[1])
            p0, n0 = best[2:]
        worth: tuple = (-2.0, None)
        for k in range(1, len(rule) + 1):
            p, n = tally(left.where(pruning & _all(rule[:k], "on_bins")))
            if p + n and (p - n) / (p + n) > worth[0] + 0.005:
                worth = ((p - n) / (p + n), rule[:k], p, n)
        if worth[1] is None or worth[2] < SUPPORT or worth[2] < ACCEPT * (worth[2] + worth[3]):
            break
        rules.append(worth[1])
    return rules


def decide(counts: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Adds base_failed, rule (the number of the first rule that applies, else null) and kept."""
    rule = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        rule = F.when(_all(rules[k], "on_values"), F.lit(k + 1)).otherwise(rule)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("rule", rule).withColumn("kept", ~failed & F.col("rule").isNull())


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: (doc_id, text, ...); labels: (doc_id, quality, ...). One row per row of docs."""
    counts = materialize(text_counts(docs), "counts")
    return decide(counts, learn_rules(counts, labels))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
