"""Similarity join on word n-grams by chosen paths (operator 7).

Documents are sets of hashed word 5-grams; equal sets form one class and meet as one. A set is embedded as ``COORDINATES`` min-hash tokens (number,
minimum), of which two sets share a share equal to their Jaccard similarity. In every run a set walks down a tree: the node says which
token is taken next, sets that share it go on together, and deeper nodes sometimes take two (about 1 / threshold on average), so that a
similar pair survives in expectation. Nodes of at most ``SMALL`` sets are compared by brute force on sketches; larger ones are split
further, level by level; what stays together to the last level is compared whole, in pairs of blocks, each its own task. ``RUNS`` runs from different roots bring the
recall of a pair at the threshold above ``RECALL`` for nodes at the first level. A pair in a larger node has to survive more levels, so the sets of
such nodes take as many more runs as ``RECALL`` needs at the deepest level reached (``runs_for``).

Sets whose sketches look similar form clumps; the clumps of all runs are united to components, and in each component all pairs are verified
on the real 5-grams, again in blocks. Links are counted where they are verified and pairs are never written out, so a group of many different near
copies costs comparisons but no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import may_broadcast, settle

from .batches import id_and_text, map_batches
from .components import components

NGRAM = 5
COORDINATES = 128
RUNS = 10  # at least
RECALL = 0.99
FIRST_LEVEL, LAST_LEVEL = 3, 12
SMALL = 1500  # sets compared by brute force in one node
BLOCK = 400  # sets of one block of a component
SLACK = 0.16  # sketches this much below the threshold are still verified: four standard errors
_FACTORS = (np.random.default_rng(2024).integers(1, 1 << 31, COORDINATES, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the word 5-grams of a text. A text of one to four words has itself as its only one."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest, join = xxhash.xxh3_64_intdigest, b" ".join
    return np.unique(np.array([digest(join(words[i : i + NGRAM])) for i in range(max(1, len(words) - NGRAM + 1))], dtype=np.uint64))


def class_key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def minima(grams: np.ndarray) -> np.ndarray:
    """The min-hash tokens of a set; long sets are taken in blocks."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (low[i : i + 4096, None] * _FACTORS).min(axis=0), out=out)
    return out


def step(path: np.ndarray, tokens: np.ndarray, branch: int) -> np.ndarray:
    """Child nodes of nodes (uint64) for sets with the given tokens (rows): the node chooses the coordinate, the token the child."""
    mixed = _mix(path + np.uint64(0x9E3779B97F4A7C15) * np.uint64(branch + 1))
    pick = (mixed % np.uint64(COORDINATES)).astype(np.int64)
    return _mix(mixed ^ (tokens[np.arange(len(path)), pick].astype(np.uint64) << np.uint64(7)) ^ pick.astype(np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _binary(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _embed(batch: pa.RecordBatch) -> dict:
    keys, tokens = [], []
    for text in batch.column("_text").to_pylist():
        grams = shingles(text)
        keys.append(class_key(grams))
        tokens.append(minima(grams).tobytes() if len(grams) else None)
    return {"_id": batch.column("_id"), "_k": keys, "_tokens": tokens}


def recall(level: int, runs: int, similarity: float) -> float:
    """Chance that two sets share a node at ``level`` in some run; their common tokens are a draw of COORDINATES at ``similarity``."""
    n = COORDINATES
    share = np.arange(n + 1) / n
    weight = np.array([math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(n + 1)])
    alive = np.ones(n + 1)
    for _ in range(level - FIRST_LEVEL):
        alive = 0.75 * share * alive + 0.25 * (1 - (1 - share * alive) ** 2)
    return float((weight * (1 - (1 - share**FIRST_LEVEL * alive) ** runs)).sum())


def runs_for(level: int, similarity: float, least: int) -> int:
    """Runs, at least ``least``, that bring the recall to ``RECALL`` of what any number of them could find."""
    most = RECALL * (1 - (1 - similarity) ** COORDINATES)
    while recall(level, least, similarity) < most:
        least += 1
    return least


def _roots(numbers: range):
    def run(batch: pa.RecordBatch) -> dict:
        keys, tokens = batch.column(0).to_pylist(), _binary(batch.column(1), COORDINATES, np.uint32)
        paths = []
        for number in numbers:
            path = _mix(np.full(len(keys), number + 1, dtype=np.uint64))
            for _ in range(FIRST_LEVEL):
                path = step(path, tokens, 0)
            paths.append(path)
        return {"_path": np.concatenate(paths).view(np.int64), "_k": keys * len(numbers)}

    return run


def _deeper(batch: pa.RecordBatch) -> dict:
    path, keys = batch.column("_path").to_numpy().view(np.uint64), batch.column("_k").to_pylist()
    tokens = _binary(batch.column("_tokens"), COORDINATES, np.uint32)
    twice = np.flatnonzero(_mix(path ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(4) == 0)  # a quarter of the nodes take two tokens
    more = step(path[twice], tokens[twice], 1) if len(twice) else np.empty(0, np.uint64)
    return {"_path": np.concatenate([step(path, tokens, 0), more]).view(np.int64), "_k": keys + [keys[i] for i in twice]}


class Forest:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def unite(self, a: np.ndarray, b: np.ndarray, close: np.ndarray) -> None:
        """Join a[x] and b[y] wherever ``close`` holds."""
        for x, y in np.argwhere(close).tolist():
            self.join(int(a[x]), int(b[y]))


def _stars(keys: list[bytes], forest: Forest) -> tuple[list[bytes], list[bytes]]:
    """One edge from every member of a clump to its root."""
    roots = [forest.root(i) for i in range(len(keys))]
    out = [(keys[i], keys[r]) for i, r in enumerate(roots) if i != r]
    return [a for a, _ in out], [b for _, b in out]


def clumps(keys: list[bytes], sketches: np.ndarray, side: np.ndarray, least: float) -> tuple[list[bytes], list[bytes]]:
    """Edges that connect the sets of one node whose sketches agree in a share of at least ``least`` of the bytes.

    With two sides only pairs across them are looked at; the other pairs of the node are another task's.
    """
    forest, need = Forest(len(keys)), least * COORDINATES
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    other = two if len(two) else one
    for i in range(0, len(one), 64):
        for j in range(0 if len(two) else i, len(other), 512):
            a, b = one[i : i + 64], other[j : j + 512]
            close = (sketches[a][:, None, :] == sketches[b][None, :, :]).sum(axis=2, dtype=np.int16) >= need
            if not len(two):
                close &= a[:, None] < b[None, :]
            forest.unite(a, b, close)
    return _stars(keys, forest)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in a sorted partition, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(key)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compare_nodes(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[bytes] = []
        b: list[bytes] = []
        for group in _groups(batches, "_task"):
            keys = group.column("_k").to_pylist()
            if len(keys) > 1:
                more = clumps(keys, _binary(group.column("_sketch"), COORDINATES, np.uint8), group.column("_side").to_numpy(), least)
                a += more[0]
                b += more[1]
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], dtype=np.int64).reshape(len(left), len(right))
    sides = [np.concatenate(s) if s else np.empty(0, np.uint64) for s in (left, right)]
    shared = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    places = [np.searchsorted(shared, v) if len(shared) else np.zeros(len(v), np.int64) for v in sides]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(shared), 2048):
        dense = []
        for v, row, place, s in zip(sides, rows, places, (left, right)):
            ok = (place >= at) & (place < min(at + 2048, len(shared)))
            ok[ok] = shared[place[ok]] == v[ok]
            m = np.zeros((len(s), 2048), dtype=np.float32)
            m[row[ok], place[ok] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    both = intersections(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return both >= threshold * (sizes - both) - 1e-9


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "_task"):
            keys, copies = group.column("_k").to_pylist(), np.array(group.column("_n").to_pylist(), dtype=np.int64)
            sets = [shingles(t) for t in group.column("_text").to_pylist()]
            side = np.array(group.column("_side").to_pylist())
            forest, links = Forest(len(keys)), np.zeros(len(keys), dtype=np.int64)
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            within = not len(two)
            other = one if within else two
            for i in range(0, len(one), 256):
                for j in range(0, len(other), 256):
                    a, b = one[i : i + 256], other[j : j + 256]
                    if within and j < i:
                        continue
                    close = linked([sets[x] for x in a], [sets[x] for x in b], threshold)
                    if within and i == j:
                        close = np.triu(close, 1)
                    np.add.at(links, a, close @ copies[b])
                    np.add.at(links, b, close.T @ copies[a])
                    forest.unite(a, b, close)
            roots = [keys[forest.root(x)] for x in range(len(keys))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(roots, pa.binary()), pa.array(links)], names=["_k", "_root", "_links"])

    return run


def _of_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; the table is broadcast where its counted size allows."""
    return rows.join(F.broadcast(table) if may_broadcast(table, table.count()) else table, key)


def _descend(classes: DataFrame, numbers: range, small: int) -> tuple[DataFrame, DataFrame | None, int]:
    """The leaves of some runs, the sets that were in a node too large to be one at the first level, and the deepest level."""
    found: DataFrame | None = None
    split: DataFrame | None = None
    frontier = settle(map_batches(classes.select("_k", "_tokens"), _roots(numbers), "_path bigint, _k binary"))
    for level in range(FIRST_LEVEL, LAST_LEVEL + 1):
        sizes = frontier.groupBy("_path").agg(F.count(F.lit(1)).alias("_size"))
        sizes = settle(sizes.filter(F.col("_size") > 1))
        done = sizes if level == LAST_LEVEL else sizes.filter(F.col("_size") <= small)
        leaf = frontier.join(done, "_path").select("_path", "_k", "_size")
        found = leaf if found is None else found.union(leaf)
        crowded = sizes.filter(F.col("_size") > small).select("_path")
        if level == LAST_LEVEL or crowded.isEmpty():
            break
        inside = _of_key(frontier, crowded, "_path")
        split = settle(inside.select("_k").distinct()) if split is None else split
        rows = inside.join(classes.select("_k", "_tokens"), "_k")
        frontier = settle(map_batches(rows, _deeper, "_path bigint, _k binary"))
    return found, split, level


def leaves(classes: DataFrame, runs: int = RUNS, small: int = SMALL, threshold: float = 0.8) -> DataFrame:
    """(_path, _k, _size): the sets of every leaf with at least two. ``classes`` has _k and _tokens."""
    want = runs_for(FIRST_LEVEL, threshold, runs)
    found, split, deepest = _descend(classes, range(want), small)
    if split is None:
        return found
    # Two sets that were never split together have met at the first level, or not, in all runs so far: the others run again.
    again = settle(classes.select("_k", "_tokens").join(split, "_k", "left_semi"))
    done = want
    while done < (want := runs_for(deepest, threshold, done)):
        more, _, level = _descend(again, range(done, want), small)
        found, deepest, done = found.union(more), max(deepest, level), want
    return found


def _blocked(rows: DataFrame, group: str, size: str, block: int, key: str) -> DataFrame:
    """Every row once per pair of blocks of its group: (_task, _side). A group of one block is one task."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(key), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(
        F.xxhash64(F.col(group), F.least(own, j), F.greatest(own, j)).alias("task"), F.when(own <= j, 0).otherwise(1).alias("side")))
    return rows.withColumn("_p", F.explode(pairs)).withColumns({"_task": F.col("_p.task"), "_side": F.col("_p.side")}).drop("_p")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, runs: int = RUNS, small: int = SMALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row.

    ``class_id`` is the smallest id of the connected group of documents linked by a Jaccard similarity of at least ``threshold`` of their word
    5-grams; ``n_links`` counts the documents linked to this one, ``n_copies`` those with an equal set, itself included. Texts without words (null,
    empty, white space) are linked to nothing and are their own class. Repeated rows are copies of each other; null ids are larger than any other.
    """
    kind = dict(docs.dtypes)[id_col]
    embedded = settle(map_batches(id_and_text(docs, id_col, text_col), _embed, f"_id {kind}, _k binary, _tokens binary"))
    grouped = embedded.filter(F.col("_k").isNotNull()).groupBy("_k")
    classes = settle(grouped.agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n"), F.max("_tokens").alias("_tokens")))

    # The lowest byte of every token makes the sketch; different tokens agree in it once in 256.
    sketch = map_batches(classes.select("_k", "_tokens"), _sketches, "_k binary, _sketch binary")
    members = _blocked(leaves(classes, runs, small, threshold).join(sketch, "_k"), "_path", "_size", small, "_k").select("_task", "_side", "_k", "_sketch")
    sorted_ = members.repartition("_task").sortWithinPartitions("_task")
    close = components(sorted_.mapInArrow(_compare_nodes(threshold - SLACK), "a binary, b binary"))

    sizes = close.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    chosen = close.join(sizes, "root").select(F.col("node").alias("_k"), F.col("root").alias("_group"), "_size").join(classes.select("_k", "_rep", "_n"), "_k")
    chosen = settle(chosen)
    texts = id_and_text(docs, id_col, text_col)
    picked = texts.join(F.broadcast(chosen) if may_broadcast(chosen, chosen.count()) else chosen, texts["_id"].eqNullSafe(F.col("_rep")))
    # Rows that share the id of a representative but not its words are left out, repeated rows are taken once.
    same = map_batches(picked.select("_k", "_group", "_size", "_n", "_text"), _own_text, "_k binary, _group binary, _size bigint, _n bigint, _text string")
    one = same.groupBy("_k", "_group", "_size", "_n").agg(F.max("_text").alias("_text"))
    tasks = _blocked(one, "_group", "_size", block, "_k").select("_task", "_side", "_k", "_n", "_text")
    verified = settle(tasks.repartition("_task").sortWithinPartitions("_task").mapInArrow(_verify(threshold), "_k binary, _root binary, _links bigint"))

    group = components(verified.select(F.col("_k").alias("a"), F.col("_root").alias("b"))).select(F.col("node").alias("_k"), F.col("root").alias("_root"))
    links = verified.groupBy("_k").agg(F.sum("_links").alias("_links"))
    joined = classes.select("_k", "_rep", "_n").join(group, "_k", "left").join(links, "_k", "left").withColumn("_root", F.coalesce("_root", "_k"))
    first = joined.groupBy("_root").agg(F.min("_rep").alias("_first"))
    verdict = settle(joined.join(first, "_root").select("_k", "_first", (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), "_n"))
    out = embedded.select("_id", "_k").join(verdict, "_k", "left")
    return out.select(
        F.col("_id").alias(id_col), F.when(F.col("_links").isNull(), F.col("_id")).otherwise(F.col("_first")).alias("class_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_n", F.lit(1)).cast("long").alias("n_copies"),
    )


def _sketches(batch: pa.RecordBatch) -> dict:
    tokens = (_binary(batch.column(1), COORDINATES, np.uint32) & np.uint32(255)).astype(np.uint8)
    return {"_k": batch.column(0), "_sketch": [t.tobytes() for t in tokens]}


def _own_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    fits = [class_key(shingles(t)) == k for t, k in zip(batch.column("_text").to_pylist(), batch.column("_k").to_pylist())]
    return batch.filter(pa.array(fits, pa.bool_()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with the smallest id of their near-duplicate group, all columns as they were.

    Rows that share an id are versions of one document: it stays if any of them is first in its group, and repeated rows (equal id and text) stay once.
    """
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit(""))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    first = found.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).select(name.alias("_name")).distinct()
    return docs.withColumn("_name", name).join(first, "_name", "left_semi").dropDuplicates(["_name", text_col]).select(*docs.columns)
