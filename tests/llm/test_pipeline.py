"""The pipeline: every stage takes what the one before kept, and its decision takes effect."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from tillage.llm import decontaminate, mixing, secrets, toxicity

from .test_operators import brute_mask, words


def smallest_of_each(rows):
    """Ids of the smallest document of each group of near duplicates, all pairs compared."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [rows[i][0] for i in range(len(rows)) if root(i) == i]


def test_stages_one_by_one(spark, folder):
    entry._ship_package(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, folder).cache()
        seen.append(name)
        if name == "toxicity":
            bad = toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))).filter("predicted = 1")
            want = before.join(bad, "doc_id", "left_anti")
            assert sorted(kept.collect()) == sorted(want.select(before.columns).collect())
        elif name == "near-duplicates":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            assert sorted(r.doc_id for r in kept.collect()) == smallest_of_each(rows)
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.hits(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - bad
        elif name == "secrets":
            assert kept.count() == before.count()
            found = secrets.find(before)
            spans = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",")] for r in secrets.scan(found, secrets.learn(before, found)).collect() if r.spans}
            hidden = {r.doc_id: brute_mask(r.text, spans[r.doc_id]) for r in before.collect() if r.doc_id in spans}
            old = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id: r.text for r in kept.collect()} == old | hidden
        if name != "mixing":
            assert kept.columns == docs.columns
    assert seen == ["toxicity", "near-duplicates", "decontamination", "secrets", "mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert kept.columns == [*docs.columns, "copy"]
    assert Counter(tuple(r)[:-1] for r in kept.collect()) == +Counter({tuple(r): copies[r.doc_id] for r in before.collect()})
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(kept.collect())


def test_odd_and_empty_tables(spark, odd, nothing, folder, tmp_path):
    """Nulls, repeated ids and rows, clashing columns; and no rows at all."""
    for name, docs in (("odd", odd), ("none", nothing)):
        there = tmp_path / name
        docs.write.parquet(str(there / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{other}.parquet").write.parquet(str(there / f"{other}.parquet"))
        out = corpus_pipeline.run(spark, str(there))
        assert out.columns == [*docs.columns, "copy"]
        texts = Counter(r.text for r in docs.collect())
        kept = out.collect()
        assert all(r.text in texts and r.text.split() for r in kept) and (len(kept) > 0) == (name == "odd")
        assert len({r.text for r in kept}) == len({(r.text, r.copy) for r in kept if r.copy == 1})  # one of each group of copies
