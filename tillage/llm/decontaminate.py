"""Benchmark decontamination (operator 10), by DataFrame functions only.

Spaced seeds: a mask says which words of a short stretch are hashed and which are ignored, so a substitution at an ignored place does not hide a
match. All stretches of the benchmark items and of the documents are hashed with every mask. The masks cover the rule below: whichever words of a
window are changed, as far as it allows, some mask lies on equal words only. Equal hashes propose a diagonal (document, item, shift). On each
proposed diagonal the words are then compared as they are, and the pair counts if some window of ``window`` aligned words has at most
``substitutions`` different ones (items shorter than the window are compared whole, with the same share).

Words are compared in lower case without punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import may_broadcast, settle

from .batches import let

# Offsets of the words that a seed hashes. Three masks of five words are the fewest that cover 11 of 13 words and the same share of 6 to 12.
WINDOW, SUBSTITUTIONS, MIN_WORDS = 13, 2, 6
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5))
STRIDE = 1


def covering(window: int, substitutions: int, min_words: int) -> tuple[tuple[int, ...], ...]:
    """Masks that find every overlap of the rule at stride 1. For another rule than the fixed one: the run of words that any allowed changes leave."""
    if (window, substitutions) == (WINDOW, SUBSTITUTIONS) and min_words >= MIN_WORDS:
        return MASKS
    spans = ((n, n * substitutions // window) for n in range(max(1, min(window, min_words)), window + 1))
    return (tuple(range(max(1, min(-(-(n - changed) // (changed + 1)) for n, changed in spans)))),)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(words: Column, masks: tuple[tuple[int, ...], ...], stride: int) -> Column:
    """Array of (mask's hash of the words at its places, place), places being multiples of ``stride``."""
    def of(hashes: Column, number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(hashes) - 1 - mask[-1]
        places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        one = lambda i: F.struct(F.xxhash64(F.lit(number), *[hashes[i + o] for o in mask]).alias("seed"), i.alias("place"))
        return F.transform(places, one)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*[of(h, n, m) for n, m in enumerate(masks)]))


def hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks: tuple[tuple[int, ...], ...] | None = None, stride: int = STRIDE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS,
) -> DataFrame:
    """Contaminated pairs (id, item, start, matched, compared): where the best window starts in the document (in words) and how many of its words match.

    One row per document and item. Null or empty texts, and items with fewer than ``min_words`` words, match nothing. Rows with equal ids count as
    one document that holds all their texts, rows with equal item ids as variants of one item; null ids are equal to each other.
    """
    masks = covering(window, substitutions, min_words) if masks is None else masks
    # Every text is one variant of its id; ids are joined null-safe through a hash that is verified by comparing the words.
    corpus = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    items = benchmark.select(F.col(item_col).alias("_item"), _words(F.coalesce(F.col(item_text_col), F.lit(""))).alias("_passage"))
    items = settle(items.filter(F.size("_passage") >= min_words).distinct())

    index = items.select("_item", F.explode(seeds(F.col("_passage"), masks, 1)).alias("s")).select("_item", F.col("s.seed").alias("_seed"), F.col("s.place").alias("_at"))
    index = settle(index.distinct())
    found = corpus.select("_id", F.explode(seeds(_words(F.col("_text")), masks, stride)).alias("s")).select("_id", F.col("s.seed").alias("_seed"), F.col("s.place").alias("_place"))
    # The seeds of the benchmark are counted, rows and bytes; where they are too many, both sides are shuffled by seed.
    met = found.join(F.broadcast(index) if may_broadcast(index, index.count()) else index.hint("shuffle_hash"), "_seed")
    diagonals = met.groupBy("_id", "_item", (F.col("_place") - F.col("_at")).alias("_shift")).agg(F.count(F.lit(1)).alias("_seeds"))
    # What is looked at of a document depends on its words only: the hits are few, and they travel to the texts by id.
    wanted = diagonals.groupBy(F.col("_id").alias("_want")).agg(F.collect_set(F.struct("_item", "_shift")).alias("_looks"))
    texts = corpus.join(wanted, F.col("_id").eqNullSafe(F.col("_want"))).select("_id", _words(F.col("_text")).alias("_words"), "_looks")
    pairs = texts.select("_id", "_words", F.explode("_looks").alias("l")).select("_id", "_words", "l._item", "l._shift")
    whole = may_broadcast(items, items.count())
    right = items.withColumnRenamed("_item", "_item2")
    pairs = pairs.join(F.broadcast(right) if whole else right, F.col("_item").eqNullSafe(F.col("_item2")))

    def best(words: Column, passage: Column, shift: Column) -> Column:
        """The best window on a diagonal: (matched, minus its start, compared)."""
        first, last = F.greatest(F.lit(0), -shift), F.least(F.size(passage), F.size(words) - shift)
        span = F.least(F.lit(window), F.size(passage))
        equal = F.zip_with(F.slice(passage, first + 1, last - first), F.slice(words, first + shift + 1, last - first), lambda a, b: F.when(a == b, 1).otherwise(0))
        windows = lambda e: F.transform(
            F.sequence(F.lit(0), F.size(e) - span), lambda i: F.struct(F.aggregate(F.slice(e, i + 1, span), F.lit(0), lambda s, x: s + x).alias("n"), (-(i + first + shift)).alias("at"), span.alias("span"))
        )
        return F.when(last - first >= span, let(equal, lambda e: F.array_max(windows(e))))

    scored = pairs.select("_id", "_item", best(F.col("_words"), F.col("_passage"), F.col("_shift")).alias("b"))
    enough = F.col("b.n") * window >= F.col("b.span") * (window - substitutions)
    top = scored.filter(enough).groupBy("_id", "_item").agg(F.max("b").alias("b"))
    return top.select(
        F.col("_id").alias(id_col), F.col("_item").alias("item" if item_col == id_col else item_col), (-F.col("b.at")).cast("long").alias("start"),
        F.col("b.n").cast("long").alias("matched"), F.col("b.span").cast("long").alias("compared"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that hold no benchmark passage, all columns as they were. Null ids are kept or dropped together, as one document."""
    bad = settle(hits(docs, benchmark, id_col=id_col, **how).select(F.col(id_col).alias("_bad")).distinct())
    bad = F.broadcast(bad) if may_broadcast(bad, bad.count()) else bad
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_bad")), "left_anti")
