"""Substring deduplication over words (operator 1), by difference-cover anchors.

A window of ``window`` words is removed if the same words also start earlier: in a smaller id, or at an earlier place of the same id.

Hashing every window would shuffle one row per word. Instead, short anchors are hashed only at places whose number modulo 13 lies in the
difference cover {0, 1, 3, 9}: whatever two places a passage stands at, some shift below 13 takes both to the cover. So two equal windows of 20
words share an anchor of 8 words at aligned cover places inside both. Anchors that occur once are dropped;
only windows around repeated anchors are then hashed in full, and of each the earliest start is kept.

Copies never meet as pairs: every batch keeps one row per anchor and per window, groups are aggregated, and what travels back to a document is
where its anchors are repeated and which of its windows are first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillage.plans.lineage import settle

from .batches import id_and_text, map_batches

PERIOD, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 is a difference of two of these
LAST_ID = (1 << 63) - 1


def anchor_length(window: int) -> int:
    if window < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    return window - PERIOD + 1


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def anchors_of(words: list[bytes], window: int) -> tuple[list[int], list[int]]:
    """Places and 64-bit hashes of the anchors of a document that has room for a window."""
    if len(words) < window:
        return [], []
    size = anchor_length(window)
    places = [p for c in COVER for p in range(c, len(words) - size + 1, PERIOD)]
    digest, join = xxhash.xxh3_64_intdigest, b" ".join
    return places, [digest(join(words[p : p + size])) for p in places]


def around(places: list[int], n_words: int, window: int) -> list[int]:
    """Starts of all windows that hold an anchor at one of the places. Places may be those of a longer row with the same id."""
    if n_words < window:
        return []
    mark = np.zeros(n_words + 1, dtype=np.int32)
    reach = window - anchor_length(window)
    at = np.asarray(places, dtype=np.int64)
    at = at[at <= n_words - anchor_length(window)]
    np.add.at(mark, np.maximum(at - reach, 0), 1)
    np.add.at(mark, np.minimum(at + 1, n_words), -1)
    return np.flatnonzero(np.cumsum(mark[: max(0, n_words - window + 1)]) > 0).tolist()


def _signed(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def _anchors(window: int):
    def run(batch: pa.RecordBatch) -> dict:
        ids, places, keys = [], [], []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, hashes = anchors_of(words_of(text), window)
            ids.append(np.full(len(at), id_, dtype=np.int64))
            places.append(np.asarray(at, dtype=np.int32))
            keys.append(np.asarray(hashes, dtype=np.uint64))
        id_, place, key = np.concatenate(ids), np.concatenate(places), np.concatenate(keys)
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        lead = np.zeros(len(key), dtype=bool)
        lead[first] = True
        repeated = (count > 1)[inverse]
        # One row of the batch stands for an anchor in its group; further ones are known to be repeated and go anywhere.
        spread = key ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ id_.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return {"_key": _signed(np.where(lead, key, spread)), "_id": id_, "_place": place, "_repeated": repeated}

    return run


def _windows(window: int):
    def run(batch: pa.RecordBatch) -> dict:
        seen: dict[bytes, tuple[int, int]] = {}
        join, digest = b" ".join, hashlib.blake2b
        for id_, text, places in zip(*(c.to_pylist() for c in batch.columns)):
            words = words_of(text)
            for start in around(places, len(words), window):
                key = digest(join(words[start : start + window]), digest_size=16).digest()
                spot = (id_, start)
                if key not in seen or spot < seen[key]:
                    seen[key] = spot
        halves = np.frombuffer(b"".join(seen), dtype=np.int64).reshape(-1, 2)
        spots = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)
        return {"_a": halves[:, 0], "_b": halves[:, 1], "_id": spots[:, 0], "_start": spots[:, 1].astype(np.int32)}

    return run


def _finish(window: int):
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for text, places, firsts in zip(*(batch.column(n).to_pylist() for n in ("_text", "_places", "_firsts"))):
            words = words_of(text)
            n = len(words)
            drop = np.zeros(n + 1, dtype=np.int32)
            if places:
                copies = np.setdiff1d(np.asarray(around(places, n, window), dtype=np.int64), np.asarray(firsts or [], dtype=np.int64))
                np.add.at(drop, copies, 1)
                np.add.at(drop, copies + window, -1)
            gone = np.cumsum(drop[:n]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
            out["n_words"].append(n)
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "surrogatepass") if gone.any() else None)
        return {"_id": batch.column("_id"), "_null": batch.column("_null")} | out

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) of every row; ``kept_text`` is null where nothing was removed.

    Ids are whole numbers. A null text has no words. Rows with equal ids count as one place each: what starts at the same word of
    both is no repetition, what starts at different words is. A null id is later than any other. Equal windows are judged on the input.
    """
    spare = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    texts = id_and_text(docs.select(spare.alias("_key_id"), F.col(text_col).alias("_t"), F.col(id_col).isNull().alias("_null")), "_key_id", "_t", F.col("_null"))
    narrow = texts.select("_id", "_text")

    anchors = map_batches(narrow, _anchors(window), "_key bigint, _id bigint, _place int, _repeated boolean")
    group = Window.partitionBy("_key")
    repeated = anchors.withColumn("_n", F.count(F.lit(1)).over(group)).filter(F.col("_repeated") | (F.col("_n") > 1))
    marks = settle(repeated.groupBy("_id").agg(F.collect_set("_place").alias("_places")))

    hit = narrow.join(marks, "_id").select("_id", "_text", "_places")
    windows = map_batches(hit, _windows(window), "_a bigint, _b bigint, _id bigint, _start int")
    first = windows.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_start")).alias("f"))
    firsts = settle(first.groupBy(F.col("f._id").alias("_id")).agg(F.collect_list("f._start").alias("_firsts")))

    joined = texts.join(marks, "_id", "left").join(firsts, "_id", "left").select("_id", "_null", "_text", "_places", "_firsts")
    out = map_batches(joined, _finish(window), "_id bigint, _null boolean, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    kind = dict(docs.dtypes)[id_col]
    return out.select(F.when(~F.col("_null"), F.col("_id")).cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")
