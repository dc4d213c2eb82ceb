"""Merkle manifest of a dataset (operator 12): one tree per source, one tree over the sources, a proof for every row.

Leaves are ranked once over the whole table, by source and id. Every node carries the interval of leaf ranks that it covers, and the level tells
the bucket of its parent: the interval's place in the tree divided by the width of that level. Ancestors are attached level by level: a node
joins the parent of its bucket that contains its interval. The siblings of a node are what is left of the parent's interval
without the node's own: the children that end before it and those that begin after it.

Groups hold at most ``fan`` nodes, so a source with any share of the rows is spread over all tasks. The loop over levels runs
once per power of ``fan``, each time over ``fan`` times fewer nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import settle
from tillage.plans.lookup import lookup
from tillage.plans.rows import with_row_id

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(texts: Column) -> Column:
    """Lowercase hex SHA-256 of an array of texts, one after the other."""
    return F.sha2(F.encode(F.array_join(texts, ""), "UTF-8"), 256)


def field(value: Column) -> Column:
    """One column of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    return joined_hash(F.array(*[field(v) for v in values]))


def _bucket(level: int, fan: int) -> Column:
    """Which interval of this level the node lies in, counted inside its tree."""
    return F.floor(F.col("lo") / F.lit(fan**level)).cast("long")


def grow(leaves: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """All levels of a forest. ``leaves``: (tree, size, lo = hi = rank in the tree, hash, carried).

    Returns the groups of every level, (tree, size, bucket, lo, hi, hash, kids), and the roots (tree, size, root, depth).
    ``hash`` is that of the parent that the group forms. A tree has a level while more than one node remains.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels: list[DataFrame] = []
    nodes = leaves
    roots = leaves.filter(F.col("size") == 1).select("tree", "size", F.col("hash").alias("root"))
    while fan ** len(levels) < largest:
        k = len(levels)
        kid = F.struct("lo", "hi", "hash", "carried") if k == 0 else F.struct("lo", "hi", "hash")
        groups = nodes.filter(F.col("size") > fan**k).groupBy("tree", "size", _bucket(k + 1, fan).alias("bucket")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        lo, hi = F.array_min("kids.lo").alias("lo"), F.array_max("kids.hi").alias("hi")
        levels.append(settle(groups.select("tree", "size", "bucket", lo, hi, joined_hash(F.col("kids.hash")).alias("hash"), "kids")))
        nodes = levels[-1].select("tree", "size", "lo", "hi", "hash")
        done = nodes.filter((F.col("size") > fan**k) & (F.col("size") <= fan ** (k + 1)))
        roots = roots.unionByName(done.select("tree", "size", F.col("hash").alias("root")))
    return levels, settle(roots)


def _siblings() -> Column:
    """What the parent's interval holds besides the node: the hashes before it and behind it, each joined."""
    before = F.filter("kids", lambda o: o["hi"] < F.col("kid.lo"))
    behind = F.filter("kids", lambda o: o["lo"] > F.col("kid.hi"))
    return F.struct(*[F.array_join(F.transform(part, lambda o: o["hash"]), "").alias(name) for part, name in ((before, "left"), (behind, "right"))])


def descend(levels: list[DataFrame], leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """(tree, lo, hash, carried, path) of every leaf; ``path`` holds the siblings (left, right) from its own level up to the root of its tree."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        groups = levels[k]
        if paths is None:
            above = groups.withColumn("up", empty)
        else:
            up = paths.select(F.col("tree").alias("_tree"), _bucket(k + 1, fan).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("path").alias("_up"))
            same = (groups["tree"] == up["_tree"]) & (groups["bucket"] == up["_bucket"])
            above = groups.join(up, same & (groups["lo"] >= up["_lo"]) & (groups["hi"] <= up["_hi"]), "left")
            above = above.withColumn("up", F.coalesce("_up", empty))  # no match: the group forms the root of its tree
        kids = above.select("tree", "kids", "up", F.explode("kids").alias("kid"))
        more = [F.col("kid.carried").alias("carried")] if k == 0 else []
        paths = kids.select("tree", F.col("kid.lo").alias("lo"), F.col("kid.hi").alias("hi"), F.col("kid.hash").alias("hash"), *more, F.concat(F.array(_siblings()), "up").alias("path"))
    lone = leaves.filter(F.col("size") == 1).select("tree", "lo", "hash", "carried", empty.alias("path"))
    return lone if paths is None else paths.select("tree", "lo", "hash", "carried", "path").unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf hash and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.encode(F.concat(s["left"], h, s["right"]), "UTF-8"), 256))


def manifest(
    docs: DataFrame, tampered: dict[str, Column] | None = None, changed: Column | None = None, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, fan: int = FAN
) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` gives other values for some columns in the rows where ``changed`` is true; their folded root starts from the hash of those
    values, with the original siblings. Nulls in any column have a text of their own (``-``); a null source is a source and comes first, a
    null id comes first in its source. Rows that share source and id are ordered by their leaf hash, so repeated rows are all
    leaves, next to each other. A table of one row has that leaf as its root and an empty proof; an empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    kept = docs.select(id_col, source_col, *[c for c in dict.fromkeys(fields) if c not in (id_col, source_col)])
    leaf = leaf_hash([kept[c] for c in fields])
    other = leaf_hash([(tampered or {}).get(c, kept[c]) for c in fields])
    marked = F.when(changed, other) if changed is not None else F.lit(None).cast("string")
    rows = kept.select(kept[source_col].alias("_source"), kept[id_col].alias("_id"), leaf.alias("_leaf"), marked.alias("_other"))
    # Written once: the range sort below reads its input twice, and the texts need hashing only once.
    ranked = with_row_id(settle(rows), [F.col("_source").asc_nulls_first(), F.col("_id").asc_nulls_first(), "_leaf", "_other"], "_rank")
    # The first rank of a source names its tree; in order, these numbers are the order of the sources.
    trees = settle(ranked.groupBy("_source").agg(F.min("_rank").alias("tree"), F.count(F.lit(1)).alias("size")))
    placed = lookup(ranked, trees, ["_source"], ["tree", "size"], weight="size", null_safe=True)
    at = F.col("_rank") - F.col("tree")
    leaves = placed.select("tree", "size", at.alias("lo"), at.alias("hi"), F.col("_leaf").alias("hash"), F.struct(F.col("_id").alias("id"), F.col("_other").alias("other")).alias("carried"))
    levels, subroots = grow(leaves, fan)

    above = with_row_id(subroots.select("tree", "root"), ["tree"], "_spot")
    count = subroots.count()
    tops = above.select(
        F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("_spot").alias("lo"), F.col("_spot").alias("hi"), F.col("root").alias("hash"),
        F.struct(F.col("tree").alias("id")).alias("carried"),
    )
    top_levels, top = grow(tops, fan)
    root = next(iter(top.select("root").collect()), [None])[0]  # one row: the root of all
    by_tree = settle(descend(top_levels, tops, fan).select(F.col("carried.id").alias("_tree"), F.col("hash").alias("subroot"), F.col("path").alias("_top")))

    weighted = by_tree.join(trees.select(F.col("tree").alias("_tree"), F.col("size").alias("_size")), "_tree")
    rows = lookup(descend(levels, leaves, fan).withColumnRenamed("tree", "_tree"), weighted, ["_tree"], ["subroot", "_top"], weight="_size")
    path = F.concat("path", "_top")
    proof = joined_hash(F.transform(path, lambda s: F.concat(s["left"], s["right"])))
    found = rows.select(
        F.col("carried.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"),
        fold(F.coalesce("carried.other", "hash"), path).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def digest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, a fifth of the rows (by the CRC-32 of their id) checked against a text in lower case."""
    return manifest(docs, {"text": lower_ascii(F.col("text"))}, F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0)


ORACLE = """WITH RECURSIVE
  crc AS (SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS c FROM documents),
  f AS (SELECT documents.doc_id, source, coalesce(strlen(documents.doc_id::VARCHAR) || ':' || documents.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS h, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, c FROM documents LEFT JOIN crc USING (doc_id)),
  leaf AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS r, sha256(h || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN c % 5 = 0 THEN sha256(h || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(h || coalesce(strlen(text) || ':' || text, '-')) END AS changed FROM f),
  up AS (SELECT source, 0 AS k, list(leaf ORDER BY r) AS l FROM leaf GROUP BY source
    UNION ALL SELECT source, k + 1, list_transform(range((len(l) + 15) // 16), lambda i: sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], ''))) FROM up WHERE len(l) > 1),
  sub AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r FROM up WHERE len(l) = 1),
  top AS (SELECT 0 AS k, list(subroot ORDER BY r) AS l FROM sub
    UNION ALL SELECT k + 1, list_transform(range((len(l) + 15) // 16), lambda i: sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], ''))) FROM top WHERE len(l) > 1),
  node AS (SELECT leaf.doc_id, leaf.source, up.k, leaf.r // (16 ** up.k)::BIGINT AS pos, up.l FROM leaf JOIN up ON up.source IS NOT DISTINCT FROM leaf.source WHERE len(up.l) > 1
    UNION ALL SELECT leaf.doc_id, leaf.source, 1000 + top.k, sub.r // (16 ** top.k)::BIGINT, top.l FROM leaf JOIN sub ON sub.source IS NOT DISTINCT FROM leaf.source, top WHERE len(top.l) > 1),
  sib AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id, source ORDER BY k) AS s, array_to_string(l[pos // 16 * 16 + 1:pos], '') AS lft, array_to_string(l[pos + 2:pos // 16 * 16 + 16], '') AS rgt FROM node),
  proof AS (SELECT doc_id, source, sha256(string_agg(lft || rgt, '' ORDER BY s)) AS p FROM sib GROUP BY doc_id, source),
  fold AS (SELECT doc_id, source, 0 AS s, changed AS h FROM leaf
    UNION ALL SELECT fold.doc_id, fold.source, sib.s, sha256(lft || h || rgt) FROM fold JOIN sib ON sib.doc_id = fold.doc_id AND sib.source IS NOT DISTINCT FROM fold.source AND sib.s = fold.s + 1),
  folded AS (SELECT doc_id, source, arg_max(h, s) AS h FROM fold GROUP BY doc_id, source)
SELECT leaf.doc_id, leaf.leaf, sub.subroot, top.l[1] AS root, coalesce(p, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = top.l[1] AS verified
FROM leaf JOIN sub ON sub.source IS NOT DISTINCT FROM leaf.source JOIN folded ON folded.doc_id = leaf.doc_id AND folded.source IS NOT DISTINCT FROM leaf.source
LEFT JOIN proof ON proof.doc_id = leaf.doc_id AND proof.source IS NOT DISTINCT FROM leaf.source, top WHERE len(top.l) = 1"""
