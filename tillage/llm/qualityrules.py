"""Quality rules with risk-controlled cutoffs (operator 5).

Fixed rules fail a document outright. Further rules compare a measure with a cutoff, chosen separately for every stratum (language)
and rule. Labelled documents say how many good documents a cutoff would reject: for a cutoff to be used, the exact (Clopper-Pearson)
upper bound of that rate must stay within the rule's share of the allowed rate. Half of the labels, by hash of the id, proposes
the ladder of cutoffs (quantiles of the measure), the other half tests it from lenient to strict and stops at the first failure
(fixed-sequence testing needs no correction inside a ladder). Of the cutoffs that pass, the one is taken that in the first half rejects most bad
documents beyond good ones, so a rule that only costs good documents stays unused. Across strata and rules the error is divided by their number (Bonferroni).
So with the given confidence no stratum loses more than ``max_false_rejection`` of its good documents to the fitted rules. A stratum with too few
labels gets no cutoff and rejects nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import may_broadcast, settle
from tillage.plans.lookup import lookup

from .batches import ASCII_SPACE, id_and_text, map_batches

SYMBOLS = "#*$%&|<>"
# measure -> columns; larger is worse
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}
LADDER = 24  # cutoffs tried for a stratum and rule
_SPACES = str.maketrans("", "", ASCII_SPACE)


def measure_text(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            lines += 1
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    covered = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = {w for w, k in Counter(windows).items() if k > 1}
        end = 0  # first word not yet counted
        for at, w in enumerate(windows):
            if w in often:
                covered += at + 3 - max(at, end)
                end = at + 3
    return n, len(text.translate(_SPACES)), symbols, repeated, covered, lines


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """The measures of every text, next to ``_id`` and any further columns."""
    rows = id_and_text(docs, id_col, text_col, *more)
    kept = [f for f in rows.schema if f.name != "_text"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batch: pa.RecordBatch) -> dict:
        found = [measure_text(t) for t in batch.column("_text").to_pylist()]
        columns = list(zip(*found)) if found else [()] * len(names)
        return {f.name: batch.column(f.name) for f in kept} | dict(zip(names, columns))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} bigint" for n in names)])
    return map_batches(rows, run, schema)


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact one-sided upper bound of a rate of which ``k`` of ``n`` were seen."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:  # P(X <= k)
        log = math.lgamma(n + 1)
        return math.fsum(
            math.exp(log - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)
        )

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid < 1 and tail(max(mid, 1e-300)) > error else (low, mid)
    return high


def fit_cutoffs(measured: DataFrame, labels: DataFrame, max_false_rejection: float, confidence: float, id_col: str, label_col: str) -> DataFrame:
    """The certified cutoffs as rows (stratum, rule, cutoff). Every stratum and rule is judged in a task; nothing but their number reaches the driver.

    Labels of an id that occur with both values count as bad; null labels and ids are left out.
    """
    truth = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_good")).dropna().groupBy("_id").agg(F.min("_good").alias("_good"))
    known = measured.filter(~F.col("base_failed")).join(truth, "_id")
    long = known.select(
        "_stratum", (F.col("_good") == 1).alias("good"), (F.crc32(F.concat(F.lit("half "), F.col("_id").cast("string"))) % 2).alias("_half"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _rate(r).alias("value")) for r in RULES])).alias("m"),
    ).select("_stratum", "good", "_half", "m.*")
    long = settle(long.groupBy("_stratum", "good", "_half", "rule", "value").count())  # equal values are counted once
    steps = [1 - 0.5 ** (1 + i / 2) for i in range(LADDER)]
    ladder = long.filter("_half = 0 AND good").groupBy("_stratum", "rule").agg(F.percentile("value", F.array(*map(F.lit, steps)), F.col("count")).alias("cuts"))
    ladder = settle(ladder.select("_stratum", "rule", F.array_distinct("cuts").alias("cuts")))  # strata x rules rows
    ladder = F.broadcast(ladder) if may_broadcast(ladder, ladder.count()) else ladder
    tests = settle(
        long.join(ladder, ["_stratum", "rule"])
        .select("_stratum", "rule", "good", "_half", "count", F.explode("cuts").alias("cutoff"), (F.col("value") > F.col("cutoff")).alias("hit"))
        .groupBy("_stratum", "rule", "cutoff").pivot("_half", [0, 1]).agg(
            F.sum(F.when(F.col("good") & F.col("hit"), F.col("count")).otherwise(0)).alias("k"), F.sum(F.when(F.col("good"), F.col("count")).otherwise(0)).alias("n"),
            F.sum(F.when(~F.col("good") & F.col("hit"), F.col("count")).otherwise(0)).alias("bad"),
        )
        .na.fill(0)
    )
    families = tests.select("_stratum", "rule").distinct().count()
    most, error = max_false_rejection / len(RULES), (1 - confidence) / max(1, families)

    def certify(key: tuple, steps: pd.DataFrame) -> pd.DataFrame:
        """From the highest cutoff down, as long as each is certified; of those the one that rejects the most bad documents. At most ``LADDER`` rows."""
        best, gain = None, 0
        for r in steps.sort_values("cutoff", ascending=False).to_dict("records"):
            if upper_bound(int(r["1_k"]), int(r["1_n"]), error) > most:
                break
            if (more := r["0_bad"] - r["0_k"]) > gain:
                best, gain = r["cutoff"], more
        return pd.DataFrame({"_stratum": [key[0]], "rule": [key[1]], "cutoff": [best]}).dropna()

    return settle(tests.groupBy("_stratum", "rule").applyInPandas(certify, "_stratum string, rule string, cutoff double"))


def _rate(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def apply_rules(
    docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", min_words: int = 50, max_repeat_percent: int = 50,
    max_false_rejection: float = 0.03, confidence: float = 0.95, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """Measures and verdict of every document: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules).

    A null text has no words and fails; a null stratum is a stratum of its own; rows with equal ids are judged one by one. Without labels
    only the fixed rules reject. An empty table gives an empty result.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00null")).alias("_stratum")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = settle(measures(docs, id_col, text_col, stratum).withColumn("base_failed", failed))
    cutoffs = fit_cutoffs(measured, labels, max_false_rejection, confidence, id_col, label_col)
    wide = cutoffs.groupBy("_stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])
    rows = measured.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"))
    joined = lookup(measured, wide.join(rows, "_stratum"), ["_stratum"], [f"_cut_{r}" for r in RULES], weight="_rows")
    broken = F.filter(F.array(*[F.when(_rate(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return joined.withColumn("_broken", broken).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("_broken") == 0)).alias("kept"), F.array_join("_broken", ",").alias("failed_rules"),
    )
