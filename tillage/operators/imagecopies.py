"""Exact and near copies in an image set."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import LEVELS, NEAR_BITS, deeper_keys, distance, first_keys, is_first_key
from ..plans.groups import components
from ..plans.lineage import pinned, settle
from ..plans.lookup import lookup

# A blocking key with more hashes than this is split by more bits.
FULL_BUCKET = 4_000
# Rounds before the rest is solved by component, and the pairs of a component that one task remembers at most.
ROUNDS_FIRST = 4
WHOLE_COMPONENT = 500_000


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    return F.md5(content) if algorithm == "md5" else F.sha2(content, 256)


def exact_copies(df: DataFrame, content: str = "content", path: str = "path", algorithm: str = "sha256", point_to: str | None = None) -> DataFrame:
    """Add ``dup_of``: the first image (by path) with the same content, null for the first one and for unreadable images.

    ``point_to`` names the column to show of the first image (its path by default). The contents themselves are never
    shuffled: the grouping carries hash and path.
    """
    hashed = df.withColumn("_hash", F.when(F.col(content).isNotNull(), content_hash(F.col(content), algorithm)))
    shown = point_to or path
    groups = (
        hashed.filter(F.col("_hash").isNotNull())
        .groupBy("_hash")
        .agg(F.min(F.struct(F.col(path).alias("p"), F.col(shown).alias("s"))).alias("_f"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select("_hash", F.col("_f.p").alias("_first"), F.col("_f.s").alias("_shown"), "_n")
    )
    found = lookup(hashed, groups, ["_hash"], ["_first", "_shown"], weight="_n")
    return found.withColumn("dup_of", F.when(F.col("_first") != F.col(path), F.col("_shown"))).drop("_hash", "_first", "_shown")


def live_links(df: DataFrame, link: str, path: str = "path") -> DataFrame:
    """Keep a link (dup_of, near_of) only while its target is still in the set."""
    wanted = df.filter(F.col(link).isNotNull()).groupBy(F.col(link).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    alive = wanted.join(df.select(F.col(path).alias("_t")), "_t", "left_semi").withColumn("_ok", F.lit(True))
    found = lookup(df.withColumn("_t", F.col(link)), alive, ["_t"], ["_ok"], weight="_n")
    return found.withColumn(link, F.when(F.col("_ok"), F.col(link))).drop("_t", "_ok")


def distinct_hashes(df: DataFrame, dhash: str = "dhash", order: str = "path") -> DataFrame:
    """One row per hash: ``h``, ``first`` (smallest order value) and ``n``."""
    return df.filter(F.col(dhash).isNotNull()).groupBy(F.col(dhash).alias("h")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def similar_hashes(
    hashes: DataFrame, keep: tuple[str, ...] = ("first", "n"), max_bits: int = NEAR_BITS, full: int = FULL_BUCKET, settled: bool = False
) -> DataFrame:
    """Pairs of different hashes that differ in at most ``max_bits`` bits: ``h_a < h_b`` by value, ``bits``, kept columns.

    Input is one row per hash (equal hashes are collapsed first, so a popular picture cannot make a large block).
    Hashes meet on blocking keys that cover every such pair (``functions.bits``). A key with more than ``full`` hashes
    is split by more bits, level by level, which loses no pair. A pair that meets on several keys is kept on the first
    only, so no distinct step is needed. ``settled`` says that the input is stored already and need not be written
    before it is read several times.
    """
    if max_bits > NEAR_BITS:
        raise ValueError(f"the blocking keys cover at most {NEAR_BITS} bits")
    if not settled:
        hashes, _ = pinned(hashes.select("h", *keep))
    h = F.col("h")
    blocks = hashes.select("h", *keep, F.explode(first_keys(h)).alias("_k")).select("h", *keep, "_k.path", "_k.v")
    many = hashes.limit(full + 1).count() > full
    found = None
    for level in range(1, LEVELS + 1):
        crowded = None
        if many and level < LEVELS:
            sizes = blocks.groupBy("path", "v").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > full)
            crowded, _ = pinned(sizes.withColumn("_full", F.lit(True)))
            crowded = crowded if crowded.take(1) else None
        if crowded is not None:
            marked = lookup(blocks, crowded, ["path", "v"], ["_full"], weight="_n")
            blocks = marked.filter("_full IS NULL").drop("_full")
        pairs = _meet(blocks, keep, max_bits, level)
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None:
            break
        full_ones = marked.filter("_full").select("h", *keep, F.explode(deeper_keys(h, F.col("path"), level + 1)).alias("_k"))
        blocks, _ = pinned(full_ones.select("h", *keep, "_k.path", "_k.v"))
    return found


def _meet(blocks: DataFrame, keep: tuple[str, ...], max_bits: int, level: int) -> DataFrame:
    """Join hashes on equal keys; both sides are the same rows, so their exchange is shared."""
    columns = ("h", *keep, "path", "v")
    a = blocks.select(*[F.col(c).alias(f"{c}_a") for c in columns])
    b = blocks.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    x = F.col("h_a").bitwiseXOR(F.col("h_b"))
    # The cheap bit count decides first; only the few pairs that are near look at their other keys.
    near = F.when((F.col("h_a") < F.col("h_b")) & (F.bit_count(x) <= max_bits), is_first_key(x, F.col("path_a"), level)).otherwise(False)
    return a.join(b, (F.col("path_a") == F.col("path_b")) & (F.col("v_a") == F.col("v_b")) & near).select(
        "h_a", "h_b", *[f"{c}_{s}" for c in keep for s in "ab"], distance(F.col("h_a"), F.col("h_b")).alias("bits")
    )


def similar_groups(hashes: DataFrame, max_bits: int = NEAR_BITS, settled: bool = False) -> DataFrame:
    """For every hash that follows an earlier anchor: ``h`` and ``near_of`` (``first`` of that anchor).

    In order of ``first``, a hash is an anchor unless an anchor before it is within ``max_bits``; it then belongs to
    the smallest such anchor. Rounds: hashes without an undecided earlier neighbour are anchors, their neighbours
    are decided, and both leave. What a few rounds leave hangs together in chains: each of its connected components passes a task in order, and only
    components of more than ``WHOLE_COMPONENT`` pairs go on in rounds. Many pairs are written to the shared folder between rounds.
    """
    pairs = similar_hashes(hashes, ("first",), max_bits, settled=settled)
    a_first = F.col("first_a") < F.col("first_b")
    edges, _ = pinned(pairs.select(
        F.when(a_first, F.col("h_a")).otherwise(F.col("h_b")).alias("src"),
        F.when(a_first, F.col("h_b")).otherwise(F.col("h_a")).alias("dst"),
        F.when(a_first, F.col("first_a")).otherwise(F.col("first_b")).alias("src_first"),
    ))
    left, decided, rounds = edges, edges.select("dst").limit(0), 0
    while left.take(1):
        if rounds == ROUNDS_FIRST:
            near, left = _walk_components(left)
            decided = decided.union(near)
            rounds += 1
            continue
        roots = left.select("src").distinct().join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
        near = left.join(roots, "src", "left_semi").select("dst").distinct()
        near, _ = pinned(near)
        decided = decided.union(near)
        left, _ = pinned(
            left.join(roots, "src", "left_anti")
            .join(near, "dst", "left_anti")
            .join(near.select(F.col("dst").alias("src")), "src", "left_anti")
            .select("src", "dst", "src_first")
        )
        rounds += 1
    anchors = edges.join(decided.select(F.col("dst").alias("src")), "src", "left_anti")
    return anchors.groupBy(F.col("dst").alias("h")).agg(F.min("src_first").alias("near_of"), F.count(F.lit(1)).alias("_n"))


def _walk_components(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decided hashes, pairs of the components that are too large). A component passes one task in the order of its hashes."""
    named = left.join(components(left).select(F.col("node").alias("src"), F.col("root").alias("_c")), "src")
    sizes = named.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    large, _ = pinned(sizes.filter(F.col("_n") > WHOLE_COMPONENT).withColumn("_large", F.lit(True)))
    marked = lookup(named, large, ["_c"], ["_large"], weight="_n")
    kind = dict(left.dtypes)["src_first"]
    small = marked.filter("_large IS NULL").select("_c", "src", "dst", "src_first")
    walked = small.repartition("_c").sortWithinPartitions("_c", "src_first", "src").mapInArrow(_walk, "dst bigint")
    near = settle(walked.distinct())
    rest, _ = pinned(marked.filter("_large").select("src", "dst", F.col("src_first").cast(kind).alias("src_first")))
    return near, rest


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that follow an anchor, the pairs of each component coming in the order of their earlier hash. Remembers one component."""
    component, following = None, set()
    for batch in batches:
        out = []
        for c, src, dst in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != component:
                component, following = c, set()
            if src not in following:
                if dst not in following:
                    out.append(dst)
                following.add(dst)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["dst"])


def mark_similar(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``near_of``: the earlier image that this one looks like. Copies, blank and unreadable images are skipped."""
    counts = F.when(F.col("dup_of").isNull() & (F.col("state") != "Blank") & ~F.col("corrupted"), F.col("dhash"))
    ready = df.withColumn("_h", counts)
    hashes, _ = pinned(distinct_hashes(ready, "_h", path))
    groups = similar_groups(hashes, settled=True)
    # Equal hashes follow the first image with that hash, or what that image follows.
    table = hashes.join(groups.drop("_n"), "h", "left").select(
        F.col("h").alias("_h"), F.coalesce("near_of", "first").alias("_near"), F.col("n").alias("_n")
    )
    found = lookup(ready, table, ["_h"], ["_near"], weight="_n")
    return found.withColumn("near_of", F.when(F.col("_near") != F.col(path), F.col("_near"))).drop("_h", "_near")
