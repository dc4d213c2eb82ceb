"""Token ids of documents in Parquet files (operator 11): list columns, dictionary and delta encoded, with page indexes.

A dataset is a folder with two tables. ``data`` holds one row per document in ascending id order: the id, the token ids as a list, their
number, the shard (the number of the file's task, ascending along the order) and ``at``, the number of ids before it in the same shard. ``shards``
holds one row per shard: how many documents and ids it has, its first and last document, and ``start``, the number of ids in all shards before.
So the place of any document in the whole stream of ids is ``start + at``, and no pass over the ids is needed to know it.

Token ids are dictionary encoded (a vocabulary's ids fit a few bits each) and fall back to delta encoding where a row group has too many different
ones; document ids and places are delta encoded. Row groups are limited in bytes, pages in bytes and rows, and Parquet's column and
offset indexes are written, so a reader that asks for a few documents or only for metadata fetches just those pages.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.plans.lineage import may_broadcast, work_folder

from .batches import id_and_text, map_batches

# Words are remembered in every Python worker, up to this many; then the memory starts anew.
KNOWN_WORDS = 250_000
LONGEST_WORD = 64  # longer ones are encoded each time
SLICE = 4 << 20  # bytes of text that are held as words at once


@dataclass(frozen=True)
class Layout:
    """How the files are laid out."""

    row_group_bytes: int = 64 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2_000
    dictionary_bytes: int = 1 << 20  # a column chunk with a larger dictionary is delta encoded
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        found = {
            "compression": self.codec,
            "parquet.writer.version": "v2",  # delta encodings where no dictionary is used
            "parquet.block.size": self.row_group_bytes,
            "parquet.page.size": self.page_bytes,
            "parquet.page.row.count.limit": self.page_rows,
            "parquet.dictionary.page.size": self.dictionary_bytes,
            "parquet.enable.dictionary": "true",
        }
        found |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc", "at", "n_tokens")}
        return {k: str(v) for k, v in found.items()}


# Words of letters whose lower case is one letter and which no normal form changes, with marks behind. Such a word is two pre-tokens at most.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿĀ-įĲ-ľŁ-ňŊ-žА-яё]+$"
MARKED = "^[A-Za-zÀ-ÖØ-öø-ÿĀ-įĲ-ľŁ-ňŊ-žА-яё]+[!-&(-/:-@[-`{-~]+$"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
JOINED = 2_000  # plain words that the library encodes in one call


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library whose tokens never reach over white space.

    Texts are cut at ASCII white space, every different word is encoded by the library, and the ids are put together again: the same ids as
    for the whole text, since the pre-tokenizer drops white space and never joins what it parts. Plain words are freed of the marks
    behind them, put in lower case and given to the library many at a time; the mark of word ends in the ids parts them again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        suffix = spec["model"].get("end_of_word_suffix") or ""
        lowers = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.joins = bool(suffix) and lowers
        self.ends = np.array([t.endswith(suffix) for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])])
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("q", [0])

    def _add(self, words: list[str]) -> range:
        """Encode words one by one; returns their numbers."""
        first = len(self.starts) - 1
        for found in self.library.encode_batch_fast(words, add_special_tokens=False):
            self.ids.extend(found.ids)
            self.starts.append(len(self.ids))
        return range(first, first + len(words))

    def _add_plain(self, words: list[str]) -> range:
        """Encode words that are one pre-token each, many in one call."""
        first = len(self.starts) - 1
        runs = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for run, found in zip(runs, self.library.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(run):
                raise ValueError("the tokenizer does not end each plain word with its word end")
            self.starts.frombytes((stops + len(self.ids)).astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
        return range(first, first + len(words))

    def _known(self, words: list[str], add: Callable[[list[str]], range]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        numbers = dict(zip(new, add(new)))
        self.known.update((w, n) for w, n in numbers.items() if len(w) <= LONGEST_WORD)
        return np.fromiter((numbers[w] if w in numbers else self.known[w] for w in words), np.int64, len(words))

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per word the number of its letters, or of the whole word, and of the marks behind (0: none)."""
        if len(self.known) > KNOWN_WORDS or len(self.ids) > 16 * KNOWN_WORDS:
            self.reset()
        if not self.known:
            self._known([""], self._add)
        heads, tails = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if self.joins:
            plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
            marked = pc.match_substring_regex(words, MARKED).to_numpy(zero_copy_only=False)
            letters = pc.utf8_lower(pc.utf8_rtrim(words.filter(pa.array(plain | marked)), MARKS)).dictionary_encode()
            heads[plain | marked] = self._known(letters.dictionary.to_pylist(), self._add_plain)[letters.indices.to_numpy()] if len(letters) else 0
            behind = words.filter(pa.array(marked))
            if len(behind):
                marks = pc.replace_substring_regex(behind, "^[^!-&(-/:-@[-`{-~]+", "").dictionary_encode()
                tails[marked] = self._known(marks.dictionary.to_pylist(), self._add)[marks.indices.to_numpy()]
        else:
            plain = marked = np.zeros(len(words), bool)
        rest = ~(plain | marked)
        heads[rest] = self._known(words.filter(pa.array(rest)).to_pylist(), self._add)
        return heads, tails

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        words = pc.ascii_split_whitespace(texts)
        folded = words.flatten().dictionary_encode()
        heads, tails = self._numbers(folded.dictionary)
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.uint32)
        codes = folded.indices.to_numpy()
        each = np.stack([heads[codes], tails[codes]], axis=1).ravel()  # the letters and the marks of each word
        lengths = starts[each + 1] - starts[each]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        picked = ids[np.repeat(starts[each] - (ends - lengths), lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        edges = np.concatenate([[0], ends])[2 * (words.offsets.to_numpy() - words.offsets[0].as_py())]
        return picked, np.diff(edges)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cuts(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    edges = texts.offsets if hasattr(texts, "offsets") else np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    first = 0
    while first < len(texts):
        after = int(np.searchsorted(edges, edges[first] + size, side="right")) - 1
        after = min(len(texts), max(first + 1, after))
        yield texts.slice(first, after - first)
        first = after


def _order() -> list[Column]:
    """Ascending ids, null first. Rows that share an id are told apart by their text's hash; only equal rows tie, and those are spread over tasks."""
    return [F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_tie")]


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int | None = 1, layout: Layout | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> TokenFiles:
    """Encode every text, append ``end_id``, and write the dataset in ascending id order. The folder must not exist.

    ``path`` is a tokenizer file every executor can read. A null text is empty (only the end id). Null ids come first; rows that share an id stay
    next to each other, ordered by a hash of their text; repeated rows are all written. An empty table gives an empty dataset. Other columns of
    ``docs``, whatever they are called, are not read. One range shuffle moves the texts; the ids are made and written where they
    arrive, so the ids themselves are never shuffled.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = id_and_text(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text")).withColumn("_tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        for batch in batches:
            done = 0
            for texts in cuts(batch.column(1)):
                ids, lengths = encode(texts)
                if end_id is not None:
                    ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
                edges = np.concatenate([[0], np.cumsum(lengths)])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.view(np.int32)))
                columns = [batch.column(0).slice(done, len(texts)), pa.array(np.full(len(texts), shard, np.int32)), pa.array(at + edges[:-1]), pa.array(lengths), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "shard", "at", "n_tokens", "ids"])
                at, done = at + int(edges[-1]), done + len(texts)

    data = ordered.mapInArrow(run, f"doc {kind}, shard int, at bigint, n_tokens bigint, ids array<int>")
    data.write.options(**(layout or Layout()).options()).parquet(f"{folder}/data")
    stored = TokenFiles(spark, folder)
    shards = stored.data().groupBy("shard").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file task
    shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/shards")
    return stored


class TokenFiles:
    """A written dataset. Every read touches only the columns, row groups and pages it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def data(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data")

    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/shards")

    def placed(self, data: DataFrame) -> DataFrame:
        """Rows of the data with ``start``, the number of ids of all documents before."""
        shards = self.shards().select(F.col("shard").alias("_shard"), F.col("start").alias("_start"))
        if may_broadcast(shards, shards.count()):
            shards = F.broadcast(shards)
        joined = data.join(shards, data["shard"] == shards["_shard"]).withColumn("start", F.col("_start") + F.col("at"))
        return joined.drop("_shard", "_start", "shard", "at")

    def metadata(self) -> DataFrame:
        """(doc, n_tokens, start); the ids are not read."""
        return self.placed(self.data().select("doc", "shard", "at", "n_tokens"))

    def documents(self, wanted: Sequence) -> DataFrame:
        """The documents with these ids: (doc, n_tokens, ids, start). The ids select files, row groups and pages."""
        return self.placed(self.data().filter(F.col("doc").isin(list(wanted))))

    def between(self, low, high) -> DataFrame:
        """The documents with ids from ``low`` to ``high``, both included."""
        return self.placed(self.data().filter(F.col("doc").between(low, high)))

    def window(self, first: int, length: int) -> DataFrame:
        """The ids at places ``first`` to ``first + length`` of the stream: (doc, start, ids), cut at both ends.

        The shards that the window meets are looked up first; inside them only pages whose places can meet it are read.
        """
        end = F.col("start") + F.col("tokens")
        met = self.shards().filter((F.col("start") < first + length) & (end > first)).select("shard", "start")
        parts = [(F.col("shard") == s) & (F.col("at") < first + length - t) & (F.col("at") + F.col("n_tokens") > first - t) for s, t in met.collect()]  # as many as files
        wanted = F.lit(False)
        for part in parts:
            wanted = wanted | part
        rows = self.placed(self.data().filter(wanted))
        skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
        upto = F.least(F.lit(first + length) - F.col("start"), F.col("n_tokens"))
        return rows.select("doc", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("ids"))


def digest(files: TokenFiles, id_col: str = "doc_id") -> DataFrame:
    """Per document, read from the files: (id, start, n_tokens, ids_crc32 over the ids as little-endian unsigned 32-bit integers)."""
    data = files.data()

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column(3)
        edges = lists.offsets.to_numpy()
        ids = lists.values.to_numpy().astype("<i4", copy=False)
        found = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return {"doc": batch.column(0), "shard": batch.column(1), "at": batch.column(2), "n_tokens": np.diff(edges), "ids_crc32": found}

    rows = map_batches(data.select("doc", "shard", "at", "ids"), run, f"doc {dict(data.dtypes)['doc']}, shard int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return files.placed(rows).select(F.col("doc").alias(id_col), "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents below the work folder and digest what is read back."""
    folder = f"{work_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return digest(write_tokens(docs, folder, path, id_col=id_col, text_col=text_col), id_col)
