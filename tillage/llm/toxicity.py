"""Toxicity scores from weak supervision (operator 2).

1. Lexicon: words and word beginnings that labelled toxic documents hold more often than chance explains, by the Chernoff bound of the binomial
   tail, corrected for the number of entries looked at. Inflected forms share their beginnings, so unseen forms are met as well. An entry
   must show toxic documents that better entries do not show, or be pure and occur in different texts: ordinary words of often copied documents fall out.
2. Voters: every lexicon entry votes "toxic" where it occurs and abstains elsewhere; a few patterns vote too; one voter says "clean"
   where no entry occurs.
3. Label model: a two-class mixture over the votes, fitted by EM, gives each voter its accuracy. The given label is one more voter, whose
   error rates are fitted as well, so that noisy labels do not decide alone. Voters that agree more often than
   the classes explain are correlated; each counts only by the inverse of its correlated company, so that a word and its
   own beginning are not heard as independent witnesses.
4. A logistic regression is trained on the posterior labels and scores every text.

Labels are read only for the bounded fitting sample; neither labels, ids, language nor source are inputs of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import settle

from .batches import id_and_text, map_batches, map_rows

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
PATTERNS = (
    ("!shouting", re.compile(r"(?:\b[^\W\d_a-z]{3,}\b[\s,]+){4,}")),
    ("!marks", re.compile(r"[!?]{4,}")),
    ("!address", re.compile(r"\b(?:you|your)\s+(?:are\s+)?(?:a|an|such)\b", re.IGNORECASE)),
)
CLEAN, GIVEN = "!clean", "!given"


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the features, the log odds without any, and the voters' fitted reliabilities (for inspection)."""

    weights: dict[str, float]
    bias: float
    voters: dict[str, tuple[float, float]]


def features(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k))


def vocabulary(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def _entries(text: str, lexicon, cache: dict[str, tuple[str, ...]]) -> Counter:
    """Lexicon entries and patterns of a text, each with the number of different words that show it."""
    hits: Counter = Counter()
    for word in vocabulary(text):
        found = cache.get(word)
        if found is None:
            found = tuple(f for f in features(word) if f in lexicon)
            if len(cache) > 300_000:
                cache.clear()
            cache[word] = found
        hits.update(found)
    for name, pattern in PATTERNS:
        if name in lexicon and pattern.search(text):
            hits[name] += 1
    return hits


def needed(shown: list[np.ndarray], y: np.ndarray, least: int = 2, purity: float = 0.9) -> list[int]:
    """The voters, best first, that show at least ``least`` toxic documents which no voter before them shows; of what they add, ``purity`` is toxic.

    ``shown`` lists the documents of each voter.
    """
    open_ = np.ones(len(y), dtype=bool)
    kept = []
    for j, hit in enumerate(shown):
        new = hit[open_[hit]]
        right = y[new].sum()
        if right >= least and right >= purity * len(new):
            kept.append(j)
            open_[hit] = False
    return kept


def gist(text: str) -> int:
    """The smallest hash of the text's three-word runs: near copies mostly share it, other texts hardly ever do."""
    words = text.encode("utf-8", "surrogatepass").split()
    return min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def spread(shown: list[np.ndarray], y: np.ndarray, gists: np.ndarray, least: int, purity: float = 0.98) -> list[int]:
    """The voters that are right in nearly all of their documents, half of which at least are different texts."""
    kept = []
    for j, hit in enumerate(shown):
        right = hit[y[hit]]
        different = len(np.unique(gists[right]))
        if len(right) >= purity * len(hit) and different >= max(least, len(right) / 2):
            kept.append(j)
    return kept


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over binary votes (documents x voters). Returns posteriors, P(vote | toxic), P(vote | clean).

    ``start`` holds first beliefs. After a few rounds correlations left over within the classes are measured, and every voter is
    weighted by one over the sum of its correlations above 0.3 (itself included).
    """
    belief = start.astype(float)
    share = np.ones(votes.shape[1])
    for turn in range(rounds):
        on, off = belief.sum() + 1e-9, (1 - belief).sum() + 1e-9
        hit1 = (votes.T @ belief + 0.1) / (on + 1)
        hit0 = (votes.T @ (1 - belief) + 0.01) / (off + 1)
        if turn == 5:
            share = 1 / _company(votes, belief, hit1, hit0)
        gain = np.log(hit1 / hit0) * share
        miss = np.log((1 - hit1) / (1 - hit0)) * share
        logit = math.log(on / off) + votes @ (gain - miss) + miss.sum()
        belief = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return belief, hit1, hit0


def _company(votes: np.ndarray, belief: np.ndarray, hit1: np.ndarray, hit0: np.ndarray) -> np.ndarray:
    total = np.zeros((votes.shape[1],) * 2)
    for weight, hit in ((belief, hit1), (1 - belief, hit0)):
        centred = votes - hit
        cov = (centred * weight[:, None]).T @ centred / max(weight.sum(), 1e-9)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        total = np.maximum(total, cov / spread[:, None] / spread[None, :])
    np.fill_diagonal(total, 1.0)
    return np.where(total > 0.3, total, 0.0).sum(axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Newton's method for the penalised logistic regression on soft labels; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = p * (1 - p) + 1e-6
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, min_docs: int = 4,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5,
) -> ToxicityModel:
    """Learn from at most ``fit_rows`` labelled documents (the bound of the sample), none with crc32(id as text) mod ``fold`` = 0.

    The sampled ids are broadcast (at most ``fit_rows``). Contradicting labels of an id count as toxic; null ids or labels are left out. Without
    labels of both classes the model scores every text with the share of toxic labels (0.0 without any).
    """
    spark = docs.sparkSession
    name = F.col(id_col).cast("string")
    usable = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).dropna().filter(F.crc32(name) % fold != 0)
    usable = usable.groupBy(id_col).agg(F.max("_y").alias("_y"))
    sample = settle(usable.orderBy(F.md5(F.concat(F.lit("fit "), name)), id_col).limit(fit_rows))
    picked = F.broadcast(sample.select(F.col(id_col).alias("_pick"), "_y"))
    texts = id_and_text(docs, id_col, text_col)
    texts = settle(texts.join(picked, texts["_id"] == F.col("_pick")).select("_text", "_y"))

    totals = {r["_y"]: r["count"] for r in texts.groupBy("_y").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg)
        return ToxicityModel({}, math.log(max(share, 1e-9) / max(1 - share, 1e-9)), {})

    def tally(batch: pa.RecordBatch) -> dict:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[int(y == 1)].update({f for w in vocabulary(text) for f in features(w)} | {n for n, p in PATTERNS if p.search(text)})
        return {"entry": list(counts[1]), "pos": list(counts[1].values()), "neg": [counts[0][e] for e in counts[1]]} if not counts[0] else {
            "entry": list(counts[1] | counts[0]), "pos": [counts[1][e] for e in counts[1] | counts[0]], "neg": [counts[0][e] for e in counts[1] | counts[0]],
        }

    summed = map_batches(texts, tally, "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    summed = settle(summed.filter(F.col("pos") >= min_docs))
    share = F.lit(n_pos / (n_pos + n_neg))
    n, hit = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    rest = F.when(hit < 1, (1 - hit) * F.log((1 - hit) / (1 - share))).otherwise(0.0)
    surprise = n * (hit * F.log(hit / share) + rest)  # minus the log of a bound on the probability of so many
    least = math.log(max(1, summed.count()) / 0.05)
    best = summed.filter((hit > 3 * share) | (hit > (1 + share) / 2)).withColumn("_s", surprise).filter(F.col("_s") > least)
    lexicon = [r["entry"] for r in best.orderBy(F.desc("_s"), "entry").collect()]  # entries of the sample that pass the test
    place = {e: i for i, e in enumerate(lexicon)}

    def vote(batch: pa.RecordBatch) -> dict:
        cache: dict = {}
        found = [_entries(t, place, cache) for t in batch.column(0).to_pylist()]
        return {"hits": [sorted(place[e] for e in f) for f in found], "gist": [gist(t) for t in batch.column(0).to_pylist()], "y": batch.column(1)}

    rows = map_batches(texts, vote, "hits array<int>, gist bigint, y int").toArrow()  # at most fit_rows rows
    y = np.array(rows["y"]) == 1
    documents = [[] for _ in lexicon]
    for i, hits in enumerate(rows["hits"].to_pylist()):
        for j in hits:
            documents[j].append(i)
    documents = [np.array(d, dtype=np.int32) for d in documents]
    keep = sorted({*needed(documents, y), *spread(documents, y, np.array(rows["gist"]), min_docs)})
    lexicon = [lexicon[j] for j in keep]
    shown = np.zeros((rows.num_rows, len(keep)), dtype=bool)
    for k, j in enumerate(keep):
        shown[documents[j], k] = True
    votes = np.column_stack([shown, ~shown.any(axis=1), y]).astype(float)
    belief, hit1, hit0 = label_model(votes, 0.9 * y + 0.05)
    x = votes[:, :-2]
    weights = logistic(x, belief)
    named = dict(zip(lexicon, weights[:-1].tolist()))
    return ToxicityModel(named, float(weights[-1]), dict(zip([*lexicon, CLEAN, GIVEN], zip(hit1.tolist(), hit0.tolist()))))


def score_text(model: ToxicityModel, text: str, cache: dict) -> float:
    hits = _entries(text, model.weights, cache)
    logit = model.bias + sum(model.weights[e] for e in hits)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", fold: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) of every row. Null and empty texts get the score of a text without any entry.

    Rows are independent: repeated or null ids come back as they are (a null id is not held out); an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    cache: dict[str, tuple[str, ...]] = {}

    def run(batch: pa.RecordBatch) -> dict:
        return {"_id": batch.column(0), "score": [score_text(model, t, cache) for t in batch.column(1).to_pylist()]}

    out = map_batches(id_and_text(docs, id_col, text_col), run, f"_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % fold == 0, F.lit(False))
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: ToxicityModel, cutoff: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``cutoff``, all columns as they were. One pass, no shuffle."""
    place = docs.columns.index(text_col)
    cache: dict[str, tuple[str, ...]] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([score_text(model, t or "", cache) < cutoff for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_rows(docs, run)
