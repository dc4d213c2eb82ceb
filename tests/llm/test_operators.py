"""Every operator against a brute-force version, and on rows with nulls, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.llm import chosenpath, components, decontaminate, mixing, pii, qualityrules, queries, secrets, substrings, tokencount, toxicity, warc

from .conftest import odd_rows, prose


def words(text):
    return (text or "").encode().split()


# ------------------------------------------------------------------ 1 substrings


def brute_repeats(rows, window=20):
    """(id, text) -> (words, removed, digest); rows with equal ids share their places."""
    last = 1 << 63
    first = {}
    for id_, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (last, last)), (last if id_ is None else id_, i))
    out = []
    for id_, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (last if id_ is None else id_, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((id_, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, odd, nothing):
    got = substrings.remove_repeats(odd)
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute_repeats([r[:2] for r in odd_rows()])
    assert substrings.remove_repeats(nothing).count() == 0
    rng = random.Random(1)
    passages = [prose(rng, rng.randint(15, 45)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([prose(rng, rng.randint(0, 9)), rng.choice(passages)]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(tuple(r)[:4] for r in substrings.remove_repeats(df).collect()) == brute_repeats(rows)


def test_cover_aligns_any_two_places():
    for d in range(substrings.PERIOD):
        assert any((a - b) % substrings.PERIOD == d for a in substrings.COVER for b in substrings.COVER)


# ------------------------------------------------------------------ 2 toxicity


@pytest.fixture(scope="module")
def marked(spark):
    """Documents where two word families mark the toxic ones, and noisy labels."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        text, toxic = prose(rng, rng.randint(20, 90)), i % 6 == 0
        if toxic:
            text += f" {rng.choice(['grobble', 'snarkel'])}{rng.choice(['', 'x', 'ing', 'ed', 'ova'])} " + prose(rng, 10)
        rows.append((i, text))
        if i < 700:
            labels.append((i, int(toxic != (i % 50 == 7))))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(marked, odd, nothing):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    wrong = [r.doc_id for r in rows if r.predicted != (r.doc_id % 6 == 0) and (r.held_out or r.doc_id >= 700)]
    assert len(wrong) <= 4
    assert sorted(r.doc_id for r in toxicity.reject(docs, model).collect()) == sorted(r.doc_id for r in rows if not r.predicted)
    scored = toxicity.score(odd, model)
    assert scored.count() == len(odd_rows()) and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.reject(odd, model).schema == odd.schema
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.fit(nothing, labels)
    assert toxicity.score(docs, blank).filter("predicted = 1").count() == 0


# ------------------------------------------------------------------ 3 tokens


def test_tokens_equal_the_library(odd, nothing):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = tokencount.count_tokens(odd, path, 2048).collect()
    want = Counter((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in odd_rows())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and any(r.over_limit for r in rows)
    assert tokencount.count_tokens(nothing, path).count() == 0
    counter = tokencount.TokenCounter(path)
    for text in ("", " ", "It's WE'LL 's", "<|endoftext|>x<|startoftext|>", "ΑΣ ΌΣΟΣ İ", "a\x1cb \x85c d", "é ́x", "漢字12 3", "😀!!..--__ab" * 9, "<|endoftext|"):
        assert {counter.text(text, n) for n in (1, 3, 7, 1000)} == {count(text)}, text


# ------------------------------------------------------------------ 4 archives


def test_archives(spark):
    rng = random.Random(4)
    big = [prose(rng, 300), prose(rng, 400)]
    rows = [(i, f"http://x/{i}\r\nEvil: 1", rng.choice([*big, "small", None, prose(rng, 250)])) for i in range(60)]
    rows += [(7, None, big[0]), (None, "n", big[1]), (None, None, None), (99, "top", big[0]), (99, "top", big[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string").repartition(4)
    last = {}
    for id_, _, html in rows:
        if id_ is not None and len(html or "") >= warc.SMALLEST:
            last[html] = max(last.get(html, -1), id_)
    times = Counter(html for _, _, html in rows)
    want = Counter()
    for id_, _, html in rows:
        t = html or ""
        again = len(t) >= warc.SMALLEST and times[html] > 1 and last[html] != id_
        want[(id_, len(t.encode()), hashlib.sha1(t.encode()).hexdigest(), "revisit" if again else "response", last[html] if again else None)] += 1
    assert Counter(tuple(r) for r in warc.round_trip(df).collect()) == want
    assert warc.round_trip(df.limit(0)).count() == 0
    from tillage.plans.lineage import work_folder

    index = warc.write(df, f"{work_folder(spark)}/warc-test", id_col="page_id")
    some = index.filter("_id % 3 = 0 AND kind = 'response'")
    payloads = {r._id: r.payload.decode() for r in warc.read(some, gap=0).collect()}
    assert payloads and all(p == next((h or "") for i, _, h in rows if i == k and (i != 7 or h != big[0] or p == h)) or k in (7, 99) for k, p in payloads.items())


# ------------------------------------------------------------------ 5 quality


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = list(zip(w, w[1:], w[2:]))
    often = Counter(three)
    covered = {i + k for i, t in enumerate(three) if often[t] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    rows = qualityrules.apply_rules(odd, labels).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter((r[0], *brute_quality(r[1])) for r in odd_rows())
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # three labels certify nothing
    assert qualityrules.apply_rules(nothing, labels).count() == 0


def test_cutoffs_reject_bad_and_spare_good(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 5 == 0
        text = prose(rng, 60)
        rows.append((i, text.replace(" ", "%% ", 40) if bad else text + " &" * (i % 3), "en" if i % 2 else "xx"))
        labels.append((i, int(not bad)))
    out = qualityrules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sum(r.kept for r in out if r.doc_id % 5 == 0) == 0
    assert sum(not r.kept for r in out if r.doc_id % 5) <= 0.03 * 4800


def brute_cutoffs(rows, labels, share=0.03, confidence=0.95):
    """The cutoffs from their definition: ladder of quantiles on the good half, fixed sequence of exact bounds on the other half."""
    known = [r for r in rows if r.doc_id in labels and not r.base_failed]

    def rate(r, rule):
        part, whole = qualityrules.RULES[rule]
        lines = sum(1 for line in r.text.split("\n") if words(line))
        return r[part] / ((lines if whole == "n_lines" else r[whole]) or math.inf)

    half = lambda r: zlib.crc32(f"half {r.doc_id}".encode()) % 2

    def quantile(values, q):
        at = (len(values) - 1) * q
        low, high = math.floor(at), math.ceil(at)
        return values[low] if values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]

    ladders = {}
    for lang in {r.lang for r in known}:
        for rule in qualityrules.RULES:
            values = sorted(rate(r, rule) for r in known if r.lang == lang and not half(r) and labels[r.doc_id])
            if values:
                ladders[lang, rule] = sorted({quantile(values, 1 - 0.5 ** (1 + i / 2)) for i in range(qualityrules.LADDER)}, reverse=True)
    out = {}
    for (lang, rule), cuts in ladders.items():
        most = 0
        for cut in cuts:
            good = [rate(r, rule) > cut for r in known if r.lang == lang and half(r) and labels[r.doc_id]]
            if qualityrules.upper_bound(sum(good), len(good), (1 - confidence) / len(ladders)) > share / len(qualityrules.RULES):
                break
            gain = sum(rate(r, rule) > cut for r in known if r.lang == lang and not half(r) and not labels[r.doc_id])
            if gain > most:
                out[lang, rule], most = cut, gain
    return {k: out[k] for k in sorted(out)}, rate


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(21)
    rows, labels = [], {}
    for i in range(4000):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(60, 90))
        for _ in range(rng.choice([0, 0, 0, 1]) if good else rng.randint(0, 40)):
            text += rng.choice([" # ", "\nsame line", " & "])
        rows.append((i, text, rng.choice(["en", "en", "de"])))
        labels[i] = int(good)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = qualityrules.apply_rules(docs, truth).join(docs, "doc_id").collect()
    cutoffs, rate = brute_cutoffs(got, labels)
    assert cutoffs and len(got) == len(rows)
    for r in got:
        broken = [rule for rule in qualityrules.RULES if rate(r, rule) > cutoffs.get((r.lang, rule), math.inf)]
        assert r.failed_rules == ",".join(broken) and r.kept == (not r.base_failed and not broken)


def test_exact_bound():
    assert qualityrules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert qualityrules.upper_bound(3, 3, 0.05) == 1.0
    p = qualityrules.upper_bound(4, 50, 0.01)
    assert sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(5)) == pytest.approx(0.01, abs=1e-8)


# ------------------------------------------------------------------ 6 mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped.update(over)


def test_mixing(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r[0], r[3], len(words(r[1]))) for r in odd_rows())
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    assert mixing.mix(nothing).count() == 0
    rng = random.Random(6)
    many = [(i, prose(rng, rng.randint(0, 120)), rng.choice(["a", "b", "b", "c", None] + ["d"] * 8)) for i in range(1500)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(mixing.mix(df.repartition(9)).collect(), key=lambda r: r.doc_id)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    copies = {r.doc_id: r.copies for r in rows}
    mixed = mixing.repeat(df).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in mixed) == Counter({t: copies[t[0]] for t in many if copies[t[0]]})
    assert all(sorted(r.copy for r in mixed if r.doc_id == i) == list(range(1, copies[i] + 1)) for i in range(0, 1500, 50))
    whole = mixing.repeat(odd)
    assert whole.columns == [*odd.columns, "copy"] and mixing.repeat(whole).columns == whole.columns
    wanted = Counter(dict(Counter({(r.doc_id, r.source): 0 for r in mixing.mix(odd).collect()})))
    for r in mixing.mix(odd).collect():
        wanted[(r.doc_id, r.source)] += r.copies
    assert +Counter((r.doc_id, r.source) for r in whole.collect()) == +wanted
    assert mixing.repeat(nothing).count() == 0


def brute_multiplier(sizes, target, most=3):
    """The multiplier at which the tilted rates meet the target, by halving."""
    mass = lambda m: sum(s * min(most, math.exp(min(m * s, 5))) for s in sizes)
    low, high = -20.0, 20.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if mass(middle) < target else (low, middle)
    return high


def test_mixing_equals_brute_force(spark):
    """Every class of (source, size) has the copies of its tilted rate, but for less than one by rounding and the single copies that make up the sum."""
    rng = random.Random(16)
    many = [(i, prose(rng, int(rng.paretovariate(0.9)) % 700), rng.choice(["a", "b", "b", "c", None] + ["d"] * 8)) for i in range(3000)]
    many += [(i, "one " * 9, "e") for i in range(3000, 3040)]  # a source of one size
    rows = mixing.mix(spark.createDataFrame(many, "doc_id long, text string, source string")).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.source].append(r)
    for source, docs in of.items():
        sizes, target = [r.size for r in docs if r.size], docs[0].target
        m = brute_multiplier(sizes, target)
        copies, number = Counter(), Counter(sizes)
        for r in docs:
            copies[r.size] += r.copies
            assert 0 <= r.copies <= 3 and (r.size or not r.copies)
        moved = 0
        for s, n in number.items():
            off = copies[s] - n * min(3, math.exp(min(m * s, 5)))
            moved += abs(off) >= 1 + 1e-4 * n
            assert max(r.copies for r in docs if r.size == s) - min(r.copies for r in docs if r.size == s) <= 1
        assert moved <= math.log2(max(sizes)) + 1
        assert abs(sum(r.taken for r in docs) - target) <= min(sizes)


# ------------------------------------------------------------------ 7 similarity join


def brute_near(rows, threshold=0.8):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    up, links = list(range(len(rows))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], least[root(i)], links[i]) for i in range(len(rows)))


def near_rows(n, seed):
    rng = random.Random(seed)
    base = [prose(rng, 80).split() for _ in range(4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.8 else prose(rng, rng.randint(1, 90)).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("limits", [{}, {"small": 20, "block": 15}])
def test_near_duplicates_equal_brute_force(spark, limits):
    rows = near_rows(150, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosenpath.near_duplicates(df, **limits).collect())
    want = brute_near(rows)
    assert sum((want - got).values()) <= (0 if not limits else 0.1 * len(rows))


def test_recall_of_split_nodes(spark):
    assert chosenpath.runs_for(chosenpath.FIRST_LEVEL, 0.8, chosenpath.RUNS) == chosenpath.RUNS
    rng, n, pairs = np.random.default_rng(16), chosenpath.COORDINATES, 400
    rows = []
    for i in range(pairs):
        one, two = rng.integers(0, 1 << 32, (2, n), dtype=np.uint32)
        same = rng.random(n) < 0.8
        rows += [(b"%d a" % i, one.tobytes()), (b"%d b" % i, np.where(same, one, two).tobytes())]
    classes = spark.createDataFrame(rows, "_k binary, _tokens binary")
    groups = chosenpath.leaves(classes, small=1).groupBy("_path").agg(F.collect_list("_k").alias("k")).collect()
    met = {bytes(a).split()[0] for r in groups for a, b in itertools.combinations(r.k, 2) if bytes(a).split()[0] == bytes(b).split()[0]}
    assert len(met) >= 0.975 * pairs


def test_split_nodes_equal_brute_force(spark):
    rows = near_rows(150, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosenpath.near_duplicates(df, small=10, block=15).collect())
    assert got == brute_near(rows)


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = chosenpath.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_near([r[:2] for r in odd_rows()])
    assert chosenpath.near_duplicates(nothing).count() == 0
    kept = chosenpath.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and 4 in ids and ids.count(4) == 1 and not {5, 6, 7} & set(ids) and {0, 1, 2, 3} <= set(ids)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(None, 1)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


# ------------------------------------------------------------------ 8 secrets


def test_secrets(spark, odd, nothing):
    rng = random.Random(10)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], {}
    for i in range(400):
        text, kind = prose(rng, 40), i % 8
        add = {0: f'token = "{hexed(40)}"', 1: f"password={hexed(18)}", 2: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)), 3: f"mail{i}@example.org",
               4: "4" + "".join(rng.choice("0123456789") for _ in range(17)), 5: 'password = "changeme123example"', 6: f"see /srv/data/{prose(rng, 1)}/part-000{i}.parquet"}.get(kind, "")
        rows.append((i, f"{text} {add} {prose(rng, 9)}"))
        want[i] = kind in (0, 1, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find(docs.withColumn("n_chars", F.length("text").cast("long")), carry=("n_chars", "text", "doc_id"))
    model = secrets.learn(docs, found)
    got = {r.doc_id: r for r in secrets.scan(found, model).collect()}
    assert sum((got[i].n_secrets > 0) != want[i] for i in want) <= 4
    masked = {r.doc_id: r for r in secrets.mask_secrets(found, model).collect()}
    for i, text in rows:
        spans = [s.split(":") for s in filter(None, got[i].spans.split(","))]
        assert got[i].n_candidates == len(secrets.candidates(text))
        assert masked[i].text == brute_mask(text, [(int(a), int(b)) for _, a, b in spans]) and masked[i].n_chars == len(masked[i].text)
    brute_scan(model, rows, got)
    for table in (odd, nothing):
        found = secrets.find(table, carry=tuple(table.columns))
        model = secrets.learn(table, found)
        assert secrets.scan(found, model).count() == table.count()
        back = secrets.mask_secrets(found, model)
        assert back.dtypes == table.dtypes and Counter(map(str, back.collect())) == Counter(str(r) for r in table.collect())


def brute_mask(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + "[secret]" + text[b:]
    return text


def brute_scan(model, rows, got):
    """The verdicts from plain counts: words and pairs of all texts without their candidates."""
    words, pairs = Counter(), Counter()
    for _, text in rows:
        at, left = 0, []
        for _, a, b in secrets.candidates(text):
            left.append(text[at:a])
            at = b
        words.update(re.findall(r"[^\W\d_]+", " ".join([*left, text[at:]]).lower()))
    for w, n in words.items():
        for i in range(len(w) - 1):
            pairs[w[i : i + 2]] += n
    pairs = {p: n for p, n in pairs.items() if n >= secrets.LEAST}
    total = sum(pairs.values())
    for i, text in rows:
        kept = []
        for kind, a, b in secrets.candidates(text):
            low = text[a:b].lower()
            chain = [math.log(pairs[p] / total) if p in pairs else -12.0 for p in (low[j : j + 2] for j in range(len(low) - 1))]
            covered = sum(len(w) for w in re.findall(r"[^\W\d_]+", low) if len(w) > 2 and words[w] >= secrets.LEAST)
            cut = max(0, a - secrets.NEAR)
            score = model.forest.score(secrets.describe(text[cut : b + secrets.NEAR], a - cut, b - cut, sum(chain) / max(1, len(chain)), covered))
            if score >= 0.5:
                kept.append(f"{kind}:{a}:{b}")
        assert got[i].spans == ",".join(kept), text


def test_forest_and_evidence_differ(spark):
    """On held-out findings the forest mostly agrees with evidence it does not see, and not always."""
    rng = random.Random(31)
    rows = []
    for i in range(600):
        value = "".join(rng.choice("abcdef0123456789") for _ in range(24)) if i % 2 else rng.choice(["changeme99example", "yourtoken12345", "aaaa1111bbbb", prose(rng, 1) + prose(rng, 1) + "77"])
        rows.append((i, f"{prose(rng, 12)} {rng.choice(['token=', 'password: ', ''])}{value} {prose(rng, 8)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find(docs)
    known = secrets.learn_prose(docs)
    labelled = secrets.label_findings(found, known).cache()
    held = F.xxhash64("context") % 3 == 0
    model = secrets.fit(labelled.filter(~held), known)
    seen = [(r.label, model.forest.score(secrets.describe(r.context, r.start, r.end, r.transition, r.covered)) >= 0.5) for r in labelled.filter(held).collect()]
    assert len(seen) > 80 and sum(bool(a) == b for a, b in seen) >= 0.9 * len(seen)
    assert not set(secrets.SEEN) & set(secrets.EVIDENCE)
    undecided = secrets.each(found).count() - labelled.count()
    assert undecided > 0  # these only the forest decides


def test_overlapping_candidates_are_whole():
    cut = lambda t: [(k, t[a:b]) for k, a, b in secrets.candidates(t)]
    assert cut("password=abc1234567890!xyzSECRET") == [("assigned", "abc1234567890!xyzSECRET")]
    assert cut("password=abc1234567890!xyz end") == [("assigned", "abc1234567890!xyz")]
    assert cut("token=a1b2c3d4e5f6g7h8@rest") == [("assigned", "a1b2c3d4e5f6g7h8@rest")]
    assert cut("so token: abcdef!12345678901234567890 x") == [("assigned", "abcdef!12345678901234567890")]
    assert cut("0123456789abcdefgh/token=s3cretvalue9!x") == [("long", "0123456789abcdefgh/token="), ("assigned", "s3cretvalue9!x")]
    rng = random.Random(21)
    for _ in range(4000):
        text = "".join(rng.choice(["token=", "password: ", "AKIA" + "Q2" * 8, "a1B2" * 5, "x" * 9, "!", "=", " ", "/", '"', "secret_", "99"]) for _ in range(rng.randint(1, 9)))
        found = secrets.candidates(text)
        assert all(a < b for _, a, b in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:]))
        covered = {i for _, a, b in found for i in range(a, b)}
        for kind, pattern in secrets.KINDS[:2]:  # no letter of a value or key is left over
            assert all(set(range(*m.span("value"))) <= covered for m in pattern.finditer(text)), text
        for m in secrets.LONG.finditer(text):  # of a long run only pieces that are no long run themselves may be left
            a, b = m.span("value")
            left = "".join(text[i] if i not in covered else " " for i in range(a, b))
            assert not any(secrets.LONG.fullmatch(piece) for piece in left.split()), text


def test_long_values_are_whole(spark):
    rng = random.Random(15)
    make = lambda n: "".join(rng.choice("ABCDEFGHJKabcdefghjkmnpq23456789+/") for _ in range(n))
    for n in (512, 513, 1600, 50_000):
        value = make(n)
        assert secrets.candidates(f'private_key = "{value}" end') == [("assigned", 15, 15 + n)]
        assert secrets.candidates(f"so {value} end") == [("long", 3, 3 + n)]
    rows = [(i, f"{prose(rng, 30)} {f'private_key={make(1600)}' if i % 2 else f'/srv/{prose(rng, 1)}/part-0{i}.parquet'} {prose(rng, 5)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find(docs, carry=("doc_id", "text"))
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(found, secrets.learn(docs, found)).collect()}
    assert all(masked[i] == re.sub(r"(?<=private_key=)\S+", "[secret]", t) for i, t in rows if i % 2)


def test_prose_counts_all_documents(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng, 12)) for i in range(2500)] + [(3000 + i, "wörtlich жук " + "ж" * 60 + " zugvogel password=zugvogel1x token=Wq7kdRzzPbvQ9x") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = secrets.learn_prose(docs)
    every = Counter(w for _, t in rows[:2500] for w in t.split() if len(w) > 2)
    counts = {(r.pair, r.part): r.n for r in known.counts.collect()}
    assert all(counts.get((False, w), 0) == (n if n >= secrets.LEAST else 0) for w, n in every.items())
    assert {(False, "wörtlich"), (False, "жук"), (True, "ör"), (True, "жу"), (False, "ж" * 60)} <= set(counts)
    assert (False, "kdrzzppvq") not in counts and (False, "wq") not in counts  # parts of a candidate only
    assert known.total == sum(n for (pair, _), n in counts.items() if pair)


# ------------------------------------------------------------------ 9 personal data


def brute_pii(text):
    found = []
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ):
        found += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m[0])]
    return found


def test_personal_data_equals_brute_force(spark, odd, nothing):
    rng = random.Random(12)
    parts = ["a.b@c.de", "x@y", "@", "q@w.e_r@t.y", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.0.00.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "1 2", "+49 (30) 123-456", "+1 2", "+12345678901234567", "é", "漢", " ", "-", ".", "5", "GB82WEST12345698765432", "GB82WEST12345698765433", "%", "word", " call me ", " visa", "bank", "mail "]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "x"]) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(998, "1.1.1.1 a@b.c " * 700), (999, "a" * 20_000 + "@" + "1" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(df)).collect()}
    for i, text in rows:
        want = brute_pii(text)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("iban")] == want, text
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i].n_email == sum(s.startswith("email") for s in want)
        for span, score in zip(filter(None, got[i].spans.split(",")), got[i].scores.split(",")):
            name, a, b = span.split(":")
            kind = next(k for k in (*pii.BASE, *pii.MORE) if k.name == name)
            around = text[max(0, int(a) - 40) : int(a)] + "\n" + text[int(b) : int(b) + 40]
            assert float(score) == (kind.raised if re.search(kind.context, around, re.I) else kind.score), (span, around)
    assert any("iban" in r.spans for r in got.values())
    assert pii.digest(pii.find_pii(odd)).count() == len(odd_rows()) and pii.digest(pii.find_pii(nothing)).count() == 0
    near = pii.find_pii(spark.createDataFrame([(1, "please mail a@b.c"), (2, "so a@b.c")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert near[0].email[0].score > near[1].email[0].score


# ------------------------------------------------------------------ 10 decontamination


def test_benchmark_passages_are_found(spark, odd, nothing):
    rng = random.Random(13)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(20)] + [(90, None), (91, "two words"), (None, prose(rng, 30))]
    rows, leaked = [], set()
    for i in range(200):
        text = prose(rng, rng.randint(0, 120))
        if i % 4 == 0:
            w = rng.choice(items[:20])[1].split()
            for k in range(9, len(w), 11):
                w[k] = "Changed"
            text = f"{text}. {' '.join(w).upper()}! {prose(rng, 20)}"
            leaked.add(i)
        rows.append((i, text))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    docs = spark.createDataFrame([*rows, (500, items[-1][1]), (None, items[0][1])], "doc_id long, text string").repartition(3)
    found = decontaminate.hits(docs, bench).collect()
    assert {r.doc_id for r in found} == leaked | {500, None}
    assert all(r.matched >= 11 or r.compared < 13 for r in found)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == sorted(set(range(200)) - leaked)
    assert decontaminate.hits(odd, bench).count() == 0 and decontaminate.hits(nothing, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == len(odd_rows())


@pytest.mark.parametrize("rule", [(13, 2, 6), (13, 2, 3), (10, 3, 5), (8, 0, 8)])
def test_masks_cover_all_changes_at_all_places(rule):
    window, substitutions, least = rule
    masks = decontaminate.covering(*rule)
    for n in range(least, window + 1):
        for bad in itertools.combinations(range(n), n * substitutions // window):
            for start in range(7):
                places = [(m, a) for m in masks for a in range(start, start + n - m[-1]) if a % decontaminate.STRIDE == 0]
                assert any(all(a - start + o not in bad for o in m) for m, a in places), (n, bad, start)


def test_short_and_changed_passages_are_found(spark):
    rng = random.Random(14)
    items, rows = [], []
    for n, changed in [(6, []), (7, []), (7, [3]), (8, [2]), (10, [4]), (12, [5]), (13, [3, 8]), (13, [4, 9]), (60, range(5, 60, 6))]:
        words_ = [f"w{len(items)}x{i}" for i in range(n)]
        for start in range(4):
            rows.append((len(rows), len(items), " ".join(f"{prose(rng, start)} {' '.join('new' if i in changed else w for i, w in enumerate(words_))} {prose(rng, 5)}".split())))
        items.append((len(items), " ".join(words_)))
    found = decontaminate.hits(spark.createDataFrame(rows, "doc_id long, of long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {r[:2] for r in rows}


# ------------------------------------------------------------------ registered queries


def test_queries_are_registered():
    names = [re.match(r"op(\d+)_", n)[1] for n in queries.queries()]
    assert sorted(map(int, names)) == list(range(1, 11))


def test_every_toxic_word_of_many_is_learned(spark):
    """Hundreds of equally telling words: each is learned, whatever their number; words that clean texts hold as well are not."""
    letters = "bcdfghjklm"
    word = lambda g: "".join(letters[g // 10**k % 10] for k in (2, 1, 0)) + "qxzv"
    rows = [(g * 20 + i, f"people talked about {word(g)} near river number", 1) for g in range(150) for i in range(20)]
    rows += [(4000 + i, f"people talked about market{i % 7} near river number", 0) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert all(word(g) in model.weights or word(g)[:4] + "-" in model.weights for g in range(150))
    wrong = toxicity.score(docs, model).join(docs, "doc_id").filter("predicted <> toxic")
    assert wrong.count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_chosen_voters_equal_their_definition(seed):
    rng = np.random.default_rng(seed)
    y = rng.random(60) < 0.4
    votes = rng.random((60, 25)) < np.where(y[:, None], 0.3, 0.03)
    gists = rng.integers(0, 20, 60)
    shown = [np.flatnonzero(v) for v in votes.T]
    kept, met = [], set()
    for j, hit in enumerate(shown):
        new = [d for d in hit if d not in met]
        right = sum(bool(y[d]) for d in new)
        if right >= 2 and right >= 0.9 * len(new):
            kept.append(j)
            met |= set(hit)
    assert toxicity.needed(shown, y) == kept
    pure = []
    for j, hit in enumerate(shown):
        right = [d for d in hit if y[d]]
        if len(right) >= 0.98 * len(hit) and len({gists[d] for d in right}) >= max(3, len(right) / 2):
            pure.append(j)
    assert toxicity.spread(shown, y, gists, 3) == pure
