"""Secret scans (operator 8): candidates by pattern, false positives removed by a random forest.

Candidates are values given to a credential-like name, keys with a known beginning, and long tokens with digits. The forest looks at the
length, how likely the characters follow each other in the corpus' own prose, how much of the candidate is made of ordinary words, letter
classes, path-like and address-like surroundings, and the neighbouring words. It is trained on labelled findings.

Where no findings have been labelled by hand, ``label_findings`` labels candidates by evidence that the forest is not shown: issued formats,
entropy, placeholder words, shares of digits, file endings, and whether a value turns up in several different surroundings. What this
evidence leaves open the forest decides, and it may overrule it where the surroundings speak against it.

Texts are searched once; from then on the candidates travel with a little of their surroundings, and the texts do not. Word and letter-pair counts of
the corpus stay a table: only the words and pairs of candidates are looked up in it, by joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.plans.lineage import settle
from tillage.plans.lookup import lookup

from .batches import map_batches, map_rows

# Names that hold credentials, beginnings of issued keys, placeholder words.
NAMES = "password|passwd|pwd|secret|token|api_key|api-key|apikey|access_key|auth_key|private_key|client_secret|credential"
ISSUED = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}"
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "redacted", "xxxx", "****", "1234567890", "none", "null", "true", "false")

ASSIGNED = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:[a-z0-9]+[_-])?(?:{NAMES})(?![A-Za-z0-9])[\"']?\s{{0,4}}(?:=|:)>?\s{{0,4}}[\"']?(?P<value>[^\s\"'<>,;]{{6,}}+)")
KEY = re.compile(rf"(?<![0-9A-Za-z])(?P<value>{ISSUED})(?![0-9A-Za-z])")
LONG = re.compile(r"(?<![0-9A-Za-z_+/=-])(?P<value>(?=[A-Za-z_+/=-]*[0-9])[0-9A-Za-z_+/=-]{16,}+)")
KINDS = (("assigned", ASSIGNED), ("key", KEY), ("long", LONG))
LEAST = 5  # occurrences that make a word or letter pair part of the corpus' prose
NEAR = 40  # characters looked at on either side
NAME_NEAR = re.compile(rf"(?i){NAMES}")
WORD = re.compile(r"[^\W\d_]+")
FILE_END = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,7}(?![A-Za-z0-9])")
MANY_USES = 4  # a value with so many different surroundings is an example or a name


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every candidate, in order and without overlap; the first kind listed decides.

    A later kind's match that reaches into a candidate gives it what it covers behind, so no part of a value is left over. What it covers before
    is a candidate of its own where it is one by itself.
    """
    spans: list[list] = []  # kind, start, end; sorted by start
    for kind, pattern in KINDS:
        if kind == "assigned" and "=" not in text and ":" not in text:
            continue
        at = 0
        for m in pattern.finditer(text):
            start, end = m.span("value")
            while at < len(spans) and spans[at][2] <= start:
                at += 1
            while at < len(spans) and spans[at][1] < end:
                met = spans[at]
                if start < met[1] and (part := LONG.search(text[start : met[1]])):
                    spans.insert(at, [kind, start + part.start("value"), start + part.end("value")])
                    at += 1
                start = max(start, met[2])
                if start < end and (at + 1 == len(spans) or spans[at + 1][1] >= end):
                    met[2] = start = end
                at += 1
            if start < end:
                spans.insert(at, [kind, start, end])
                at += 1
            at = max(0, at - 1)
    return [tuple(s) for s in spans]


@dataclass(frozen=True)
class Prose:
    """What ordinary text looks like: a table (pair, part, n) of letter pairs and words with their counts, and the sum over all pairs."""

    counts: DataFrame
    total: int


@dataclass(frozen=True)
class Findings:
    """Every row of a table with its candidates: ``rows`` has the row number ``_row``, ``_cands``, and what was carried along."""

    rows: DataFrame
    id_col: str
    text_col: str
    carried: tuple[str, ...]


SEEN = ("length", "upper", "lower", "other", "switches", "transition", "dictionary", "path", "address", "named", "quoted", "repeats", "worded")
EVIDENCE = ("digits", "entropy", "issued", "placeholder", "file")
UNKNOWN_PAIR = -12.0


def describe(text: str, start: int, end: int, transition: float, covered: float) -> list[float]:
    """The features of one candidate that the forest sees. ``transition`` and ``covered`` come from the prose."""
    value = text[start:end]
    n = max(1, len(value))
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = Counter(classes)
    return [
        float(len(value)),
        share["u"] / n,
        share["l"] / n,
        share["o"] / n,
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        transition,
        covered / n,
        float(value.count("/") + value.count("\\") + before[-1:].count("/")),
        float("@" in before[-1:] + value + after[:1] or "://" in before[-12:] + value),
        float(bool(NAME_NEAR.search(before))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and before != ""),
        1.0 - len(set(value)) / n,
        float(len(WORD.findall(before)) + len(WORD.findall(after))),
    ]


def evidence(text: str, start: int, end: int) -> list[float]:
    """What labels rest on and the forest does not see."""
    value = text[start:end]
    n = max(1, len(value))
    low = value.lower()
    return [
        sum(c.isdigit() for c in value) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(value).values()),
        float(bool(KEY.fullmatch(value))),
        float(any(p in low for p in PLACEHOLDERS)),
        float(bool(FILE_END.match(text, end))),
    ]


def rule_label(kind: str, e: list[float], uses: int, length: int, address: bool) -> int | None:
    """1 secret, 0 not, None undecided: what a reviewer would say from the evidence. ``uses``: different surroundings of the value."""
    digits, entropy, issued, placeholder, file = e
    if placeholder or file or address or digits >= 0.95 or entropy < 2.0 or uses >= MANY_USES:
        return 0
    if issued and entropy >= 2.5:
        return 1
    if kind == "assigned" and length >= 10 and digits > 0.1 and entropy >= 2.8:
        return 1
    if kind == "assigned" and digits == 0 and entropy < 3.0 or kind == "long" and digits < 0.1:
        return 0
    return None


class Forest:
    """A random forest on a few thousand labelled rows: bootstrap samples, random feature subsets, Gini splits, leaf means."""

    def __init__(self, trees: int = 40, depth: int = 8, min_leaf: int = 2, seed: int = 7):
        self.trees, self.depth, self.min_leaf, self.rng, self.nodes = trees, depth, min_leaf, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees):
            pick = self.rng.integers(0, len(y), len(y))
            self.nodes.append(self._grow(x[pick], y[pick], 0))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int):
        if level == self.depth or len(y) < 2 * self.min_leaf or y.min() == y.max():
            return float(y.mean())
        best = (math.inf, -1, 0.0)
        for j in self.rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, j], kind="stable")
            v, c = x[order, j], np.cumsum(y[order])
            k = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (k >= self.min_leaf) & (len(y) - k >= self.min_leaf)
            if ok.any():
                left, right = c[:-1] / k, (c[-1] - c[:-1]) / (len(y) - k)
                cost = np.where(ok, k * left * (1 - left) + (len(y) - k) * right * (1 - right), math.inf)
                at = int(cost.argmin())
                if cost[at] < best[0]:
                    best = (float(cost[at]), int(j), float((v[at] + v[at + 1]) / 2))
        if best[1] < 0:
            return float(y.mean())
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], y[left], level + 1), self._grow(x[~left], y[~left], level + 1))

    def score(self, row: list[float]) -> float:
        total = 0.0
        for node in self.nodes:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.nodes)


@dataclass(frozen=True)
class SecretModel:
    prose: Prose
    forest: Forest | None  # None: labels of one class only; then the evidence decides


_CAND = "struct<kind:string,start:int,end:int,cut:int,context:string>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> Findings:
    """Search every whole text once. ``carry`` names the columns to keep with the rows (by default the id only). The result is written once,
    so that row numbers stay what they are."""
    carried = (id_col,) if carry is None else carry
    kept = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carried)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    names = [f"k{i}" for i in range(len(carried))]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cut", pa.int32()), ("context", pa.string())]))

    def run(batch: pa.RecordBatch) -> dict:
        cands = []
        for text in batch.column("_text").to_pylist():
            cands.append([{"kind": k, "start": a, "end": b, "cut": max(0, a - NEAR), "context": text[max(0, a - NEAR) : b + NEAR]} for k, a, b in candidates(text)])
        return {n: batch.column(n) for n in (*names, "_row")} | {"_cands": pa.array(cands, kind)}

    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carried)), "_row bigint", f"_cands array<{_CAND}>"])
    return Findings(settle(map_batches(kept, run, schema)), id_col, text_col, carried)


def each(found: Findings) -> DataFrame:
    """One row per candidate: (_row, kind, start, end, cut, context)."""
    return found.rows.select("_row", F.explode("_cands").alias("c")).select("_row", "c.*")


def _value() -> Column:
    return F.substring(F.col("context"), F.col("start") - F.col("cut") + 1, F.col("end") - F.col("start"))


def learn_prose(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> Prose:
    """Letter pairs and words (three letters and more) that occur at least ``least`` times in all documents, candidates left out: they cannot vouch for themselves."""

    def tally(batch: pa.RecordBatch) -> dict:
        words: Counter = Counter()
        for text in batch.column(0).to_pylist():
            at, parts = 0, []
            for _, start, end in candidates(text):
                parts.append(text[at:start])
                at = end
            words.update(WORD.findall(" ".join([*parts, text[at:]]).lower()))
        pairs: Counter = Counter()
        for w, n in words.items():
            for i in range(len(w) - 1):
                pairs[w[i : i + 2]] += n
        counts = [(True, p, n) for p, n in pairs.items()] + [(False, w, n) for w, n in words.items() if len(w) > 2]
        return dict(zip(("pair", "part", "n"), zip(*counts))) if counts else {"pair": [], "part": [], "n": []}

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    parts = map_batches(texts, tally, "pair boolean, part string, n bigint")
    often = settle(parts.groupBy("pair", "part").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    return Prose(often, often.filter("pair").agg(F.sum("n")).first()[0] or 1)


def with_prose(rows: DataFrame, prose: Prose) -> DataFrame:
    """Add ``key`` (of the value in lower case), ``transition`` (mean log probability of its letter pairs) and ``covered`` (letters in words of the prose).

    Every different value is taken apart once; its pairs and words are looked up in the counts by a join.
    """
    keyed = rows.withColumn("_low", F.lower(_value())).withColumn("key", F.md5("_low"))
    values = keyed.groupBy("key").agg(F.first("_low").alias("_low"))

    def take_apart(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("key", "pair", "part", "times")}
        for key, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pairs = Counter(low[i : i + 2] for i in range(len(low) - 1))
            words = Counter(w for w in WORD.findall(low) if len(w) > 2)
            for pair, counts in ((True, pairs), (False, words)):
                out["key"] += [key] * len(counts)
                out["pair"] += [pair] * len(counts)
                out["part"] += counts.keys()
                out["times"] += counts.values()
        return out

    parts = map_batches(values.select("key", "_low"), take_apart, "key string, pair boolean, part string, times bigint")
    met = lookup(parts, prose.counts, ["pair", "part"], ["n"], weight="n")
    odds = F.coalesce(F.log(F.col("n") / F.lit(float(prose.total))), F.lit(UNKNOWN_PAIR))
    known = met.groupBy("key").agg(
        (F.sum(F.when(F.col("pair"), F.col("times") * odds)) / F.sum(F.when(F.col("pair"), F.col("times")))).alias("transition"),
        F.coalesce(F.sum(F.when(~F.col("pair") & F.col("n").isNotNull(), F.col("times") * F.char_length("part"))), F.lit(0)).cast("double").alias("covered"),
    )
    return keyed.drop("_low").join(settle(known), "key", "left").fillna({"transition": 0.0, "covered": 0.0})


def label_findings(found: Findings, prose: Prose) -> DataFrame:
    """The different findings with a label where the evidence is sure: (context, kind, start, end, label, key, transition, covered).

    ``start`` and ``end`` are places in ``context``. Copies of a document share their contexts and count once.
    """
    at = [(F.col(c) - F.col("cut")).alias(c) for c in ("start", "end")]
    rows = with_prose(each(found).select("kind", *at, F.lit(0).alias("cut"), "context").distinct(), prose)
    uses = rows.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    rows = rows.join(uses, "key").select("context", "kind", "start", "end", "uses", "key", "transition", "covered")
    place = SEEN.index("address")

    def run(batch: pa.RecordBatch) -> dict:
        labels = []
        for context, kind, start, end, uses, _, transition, covered in zip(*(c.to_pylist() for c in batch.columns)):
            address = describe(context, start, end, transition, covered)[place] > 0
            labels.append(rule_label(kind, evidence(context, start, end), uses, end - start, address))
        return {n: batch.column(n) for n in ("context", "kind", "start", "end", "key", "transition", "covered")} | {"label": labels}

    schema = "context string, kind string, start int, end int, label int, key string, transition double, covered double"
    return map_batches(rows, run, schema).filter(F.col("label").isNotNull())


def fit(findings: DataFrame, prose: Prose, fit_rows: int = 8_000) -> SecretModel:
    """Train on labelled findings (context, kind, start, end, label): at most ``fit_rows`` of each label, chosen by hash after repeated ones are dropped.

    Contradicting labels of a finding count as secret; rows with nulls are left out.
    """
    unique = findings.select("context", "kind", "start", "end", "label").dropna().groupBy("context", "kind", "start", "end").agg(F.max("label").alias("label"))
    order = (F.xxhash64("context", "start").alias("h"), F.sha2(F.concat_ws(":", "start", "end", "kind", "context"), 256).alias("h2"))
    chosen = with_prose(unique.withColumn("cut", F.lit(0)), prose).select("context", "start", "end", "transition", "covered", "label", *order)

    # Values have any length, so the features travel and the texts do not.
    def features(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(c).to_pylist() for c in ("context", "start", "end", "transition", "covered")))
        return {"label": batch.column("label"), "h": batch.column("h"), "h2": batch.column("h2"), "x": [describe(*r) for r in rows]}

    described = settle(map_batches(chosen, features, "label int, h bigint, h2 string, x array<double>"))
    rows = [r for label in (0, 1) for r in described.filter(F.col("label") == label).orderBy("h", "h2").limit(fit_rows).collect()]
    y = np.array([r["label"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return SecretModel(prose, None)
    return SecretModel(prose, Forest().fit(np.array([r["x"] for r in rows]), y))


def learn(docs: DataFrame, found: Findings, text_col: str = "text") -> SecretModel:
    """The model of a corpus without findings labelled by hand."""
    prose = learn_prose(docs, text_col)
    return fit(label_findings(found, prose), prose)


def judged(found: Findings, model: SecretModel, cutoff: float = 0.5) -> DataFrame:
    """(_row, _kept): the secrets (start, end, kind, score) of every row that has any. A row's own candidates are gathered, no more."""
    rows = with_prose(each(found), model.prose).select("_row", "kind", "start", "end", "cut", "context", "transition", "covered")
    forest = model.forest
    place = SEEN.index("address")

    def run(batch: pa.RecordBatch) -> dict:
        scores, known = [], {}
        for kind, start, end, cut, context, transition, covered in zip(*(c.to_pylist() for c in batch.columns[1:])):
            x = tuple(describe(context, start - cut, end - cut, transition, covered))
            if x not in known or not forest:
                e = evidence(context, start - cut, end - cut)
                known[x] = forest.score(list(x)) if forest else float(rule_label(kind, e, 1, end - start, x[place] > 0) == 1)
            scores.append(known[x])
        return {n: batch.column(n) for n in ("_row", "kind", "start", "end")} | {"score": scores}

    scored = map_batches(rows, run, "_row bigint, kind string, start int, end int, score double").filter(F.col("score") >= cutoff)
    return scored.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "score"))).alias("_kept"))


def _masked(text: str, kept: list[dict], mask: str) -> str:
    parts, at = [], 0
    for spot in kept:
        parts += [text[at : spot["start"]], mask]
        at = spot["end"]
    return "".join([*parts, text[at:]])


def mask_secrets(found: Findings, model: SecretModel, cutoff: float = 0.5, mask: str = "[secret]", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns that were carried, every secret in the text replaced; a column ``length_col``, if there is one, follows the new length
    where a text changed. Only rows with candidates meet the verdicts; the others are passed on as they are."""
    names = [f"k{i}" for i in range(len(found.carried))]
    place = found.carried.index(found.text_col)
    counted = found.carried.index(length_col) if length_col in found.carried else None
    some = found.rows.filter(F.size("_cands") > 0).join(judged(found, model, cutoff), "_row", "left")
    hit = some.filter(F.col("_kept").isNotNull()).select(*names, "_kept")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        texts = [_masked(t, kept, mask) for t, kept in zip(columns[place].to_pylist(), columns[-1].to_pylist())]
        columns[place] = pa.array(texts, columns[place].type)
        if counted is not None:
            columns[counted] = pa.array([len(t) for t in texts], columns[counted].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    changed = map_rows(hit, run).select(*names)
    same = found.rows.filter(F.size("_cands") == 0).select(*names).unionByName(some.filter(F.col("_kept").isNull()).select(*names))
    return same.unionByName(changed).toDF(*found.carried)


def scan(found: Findings, model: SecretModel, cutoff: float = 0.5) -> DataFrame:
    """Secrets of every whole text: (id, n_candidates, n_secrets, spans, max_score).

    ``spans`` is kind:start:end, code points, end exclusive, comma-joined. A null text counts as empty and has no secrets; rows are
    independent, so null or repeated ids come back as they are.
    """
    id_ = f"k{found.carried.index(found.id_col)}"
    rows = found.rows.select("_row", F.col(id_).alias(found.id_col), F.size("_cands").cast("long").alias("n_candidates"))
    met = rows.filter(F.col("n_candidates") > 0).join(judged(found, model, cutoff), "_row", "left")
    both = met.unionByName(rows.filter(F.col("n_candidates") == 0), allowMissingColumns=True)
    named = F.transform("_kept", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return both.select(
        found.id_col, "n_candidates", F.coalesce(F.size("_kept"), F.lit(0)).cast("long").alias("n_secrets"), F.coalesce(F.array_join(named, ","), F.lit("")).alias("spans"),
        F.array_max(F.transform("_kept", lambda s: s["score"])).alias("max_score"),
    )
