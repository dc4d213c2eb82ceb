"""Token files, Merkle manifest and whitening against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tillage.llm import bidiagonal, merkle, queries, tokenfiles, whitening

from .conftest import odd_rows, prose

# ------------------------------------------------------------------ 11 token files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library_ids(path, text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "made"):
        library_ids.made = Tokenizer.from_file(path)
    return library_ids.made.encode(text or "", add_special_tokens=False).ids


def brute_tokens(path, rows):
    """(id, text) in file order -> (id, start, n, crc)."""
    out, start = [], 0
    for id_, text in rows:
        ids = [*library_ids(path, text), 1]
        out.append((id_, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def hostile(rng):
    parts = ["it's", "<|startoftext|>", "<|endoftext|>x", "Σίσυφος", "ΑΣ ", "İ", "é", "́", " ", " ", "\x1c", "\x85", "漢字", "👩‍👩‍👧", "0123", "--", "'LL", "क़", "a" * 70, "﻿", "ﬁ", "‍", "ſ", "K"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t ", "\x0b", "\x0c", "\r\n"]) for _ in range(rng.randint(0, 14)))


def test_token_files_equal_library(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i * 3, rng.choice([hostile(rng), prose(rng, rng.randint(0, 80)), None, ""])) for i in range(700)]
    rows.append((5, prose(rng, 9000)))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in tokenfiles.round_trip(df, tokenizer).orderBy("doc_id").collect()]
    assert got == brute_tokens(tokenizer, sorted(rows))


def test_token_files_of_odd_rows(spark, odd, nothing, tokenizer):
    got = sorted(((r[1], *r) for r in tokenfiles.round_trip(odd, tokenizer).collect()), key=lambda r: r[0])
    per_row = Counter((id_, n, crc) for id_, _, n, crc in brute_tokens(tokenizer, [r[:2] for r in odd_rows()]))
    assert Counter((id_, n, crc) for _, id_, _, n, crc in got) == per_row
    ids = [-1 if r[1] is None else r[1] for r in got]
    assert ids == sorted(ids)
    at = 0
    for _, _, start, n, _ in got:  # each begins where the one before ends
        assert start == at
        at += n
    assert tokenfiles.round_trip(nothing, tokenizer).collect() == []


def test_token_files_are_read_in_part(spark, tokenizer, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    layout = tokenfiles.Layout(row_group_bytes=64 << 10, page_bytes=4 << 10, page_rows=50)
    files = tokenfiles.write_tokens(df, str(tmp_path / "set"), tokenizer, layout=layout)
    stream = [i for _, t in rows for i in [*library_ids(tokenizer, t), 1]]
    known = {id_: (start, n) for id_, start, n, _ in brute_tokens(tokenizer, rows)}
    assert {r["doc"]: (r["start"], r["n_tokens"]) for r in files.metadata().collect()} == known
    for picked in (files.documents([7, 2999, 5000]), files.between(1200, 1234)):
        for r in picked.collect():
            start, n = known[r["doc"]]
            assert (r["start"], r["n_tokens"], r["ids"]) == (start, n, stream[start : start + n])
    assert files.documents([7, 2999, 5000]).count() == 2 and files.between(1200, 1234).count() == 35
    for first, length in ((0, 10), (len(stream) // 2, 5000), (len(stream) - 3, 50), (len(stream), 5)):
        got = sorted((r["start"], r["ids"]) for r in files.window(first, length).collect())
        assert [i for _, ids in got for i in ids] == stream[first : first + length]
        assert not got or got[0][0] == first
    for part in (tmp_path / "set" / "data").glob("*.parquet"):
        meta = pq.ParquetFile(part).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["doc"].encodings and "DELTA_BINARY_PACKED" in columns["at"].encodings
            assert all(c.has_offset_index for c in columns.values()) and columns["doc"].has_column_index
    plan = files.documents([7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc), EqualTo(doc,7)" in plan or "EqualTo(doc,7)" in plan
    assert "ids" not in files.metadata()._jdf.queryExecution().executedPlan().toString()


def test_words_are_remembered_up_to_a_bound(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenfiles, "KNOWN_WORDS", 20)
    encoder = tokenfiles.WordEncoder(tokenizer)
    rng = random.Random(2)
    for _ in range(5):
        texts = [prose(rng, 40) for _ in range(6)]
        ids, lengths = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library_ids(tokenizer, t)]
        assert lengths.tolist() == [len(library_ids(tokenizer, t)) for t in texts]
    texts = pa.array(["a" * 10, "b" * 100, "", "c" * 5])
    assert [len(c) for c in tokenfiles.cuts(texts, 20)] == [1, 1, 2]
    assert [x for c in tokenfiles.cuts(texts.slice(1), 20) for x in c.to_pylist()] == ["b" * 100, "", "c" * 5]


# ------------------------------------------------------------------ 12 Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_paths(hashes, fan):
    """(root, per leaf the siblings (left, right) from its level to the root)."""
    level, paths, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = i // fan * fan
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + fan])))
        at = [i // fan for i in at]
        level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0], paths


def lower_ascii(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_manifest(rows, fan=16):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for id_, text, lang, source, n in rows:
        leaf = brute_leaf([id_, source, lang, n, text])
        fifth = id_ is not None and zlib.crc32(str(id_).encode()) % 5 == 0
        other = brute_leaf([id_, source, lang, n, lower_ascii(text)]) if fifth else leaf
        by_source.setdefault(source, []).append(((id_ is not None, id_ or 0), leaf, other, id_))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_paths([r[1] for r in sorted(by_source[s])], fan) for s in order]
    root, tops = tree_paths([t[0] for t in trees], fan) if trees else (None, [])
    out = []
    for s, (subroot, paths), top in zip(order, trees, tops):
        for (_, leaf, other, id_), path in zip(sorted(by_source[s]), paths):
            h = other
            for left, right in path + top:
                h = sha(left + h + right)
            out.append((id_, leaf, subroot, root, sha("".join(a + b for a, b in path + top)), h, h == root))
    return Counter(out)


def test_manifest_equals_brute_force(spark, odd, nothing):
    rows = [r[:5] for r in odd_rows()]
    assert Counter(tuple(r) for r in merkle.digest(odd).collect()) == brute_manifest(rows)
    assert merkle.digest(nothing).collect() == []
    rng = random.Random(4)
    sizes = {"hot": 300, None: 17, "é": 1, "z": 16, "": 33, "𐀀": 2, "￮": 5}  # UTF-8 order differs from UTF-16 order in the last two
    rows = [(None, None, None, None, None)]
    for source, n in sizes.items():
        rows += [(rng.randint(-5, 400), rng.choice([None, "", "Shout ÄÖ Loud", prose(rng, 5).title()]), rng.choice([None, "en"]), source, rng.choice([None, 7])) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert Counter(tuple(r) for r in merkle.digest(df).collect()) == brute_manifest(rows)
    assert Counter(tuple(r) for r in merkle.manifest(df, {"text": merkle.lower_ascii(F.col("text"))}, F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, fan=3).collect()) == brute_manifest(rows, 3)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([(1, "A", None, "s", 1)], [(1, "A", None, "s", 1), (2, "B", None, "t", 1)], [(7, "same", "x", "s", 4)] * 40, [(i, "x", "y", f"s{i:03}", 1) for i in range(40)]):
        assert Counter(tuple(r) for r in merkle.digest(spark.createDataFrame(rows, schema)).collect()) == brute_manifest(rows)


def test_manifest_finds_any_change(spark):
    """Only rows whose text really changes fail; a proof of the unchanged row leads to the root."""
    rows = [(i, "lower only" if i % 2 else "Upper Too", "en", f"s{i % 3}", 9) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle.manifest(df, {"text": merkle.lower_ascii(F.col("text"))}, F.col("doc_id") % 3 == 0).collect():
        assert r["verified"] == (r["doc_id"] % 2 == 1 or r["doc_id"] % 3 != 0)


# ------------------------------------------------------------------ 13 whitening


def brute_whiten(rows, most=4):
    """{(id, component): ...} from (id, vector): plain eigenvectors of the covariance."""
    usable = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    if not usable:
        return {}
    numbers = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in usable]
    x = np.array(sorted({tuple(v) for _, v in numbers}))
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)
    keep = [k for k in order[:most] if values[k] > 1e-9 * max(values.max(), 1e-300)]
    out = Counter()
    for i, v in numbers:
        shifted = n * np.array(v) - sums
        for place, k in enumerate(keep):
            white = shifted / n @ vectors[:, k] / np.sqrt(values[k])
            out[(i, place + 1, n, int((shifted.astype(object) ** 2).sum()), round(abs(white), 6), round(values[k] / values.sum(), 9))] += 1
    return out


def seen(rows):
    return Counter((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 9)) for r in rows)


def test_whitening_equals_brute_force(spark, folder):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((900, 12)) @ (rng.standard_normal((12, 12)) * np.geomspace(3, 0.05, 12)[:, None])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(i, rows[5][1]) for i in range(2000, 2400)] + [(5, rows[5][1])]  # a group of copies and a repeated row
    rows += [(None, rows[9][1]), (3001, None), (3002, []), (3003, [1.0] * 11 + [None]), (3004, [float("nan")] * 12), (3005, [float("inf")] + [0.0] * 11), (3006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<float>, _x string, r double").repartition(9)
    got = whitening.whiten(df).collect()
    assert seen(got) == brute_whiten([r for r in rows if r[0] != 3006])
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = queries.op13_whitening(spark, folder).collect()
    assert seen(got) == brute_whiten([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert got[0]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)]  # one direction only
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert seen(got) == brute_whiten(line) and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_whitening_of_large_numbers(spark):
    """Sums beyond a long stay exact; a deviation that does not fit is null; entries that do not fit leave their vector out."""
    rows = [(i, [2.0**50 * (i % 3), float(i)]) for i in range(9)] + [(50, [2.0**60, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=1).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: (9 * 256 * (i - 4)) ** 2 if i % 3 == 1 else None for i in range(9)}
    assert whitening.deviations(np.array([[3, -4], [1 << 40, 1]], object)) == [25, None]
    assert whitening.deviations(np.array([[3, -4]])) == [25]
    x = np.array([[1 << 50, -(1 << 50)], [3, 4]])
    assert whitening.centred(1 << 20, [5, -7], x).tolist() == [[(1 << 70) - 5, -(1 << 70) + 7], [(3 << 20) - 5, (4 << 20) + 7]]


@pytest.mark.parametrize("kind", ["random", "graded", "repeated", "close", "identity", "deficient", "wilkinson"])
def test_qd_vectors(kind):
    rng = np.random.default_rng(3)
    n = 40
    q1, q2 = (np.linalg.qr(rng.standard_normal((n, n)))[0] for _ in range(2))
    values = {
        "random": rng.random(n) + 0.1, "graded": np.geomspace(1e6, 1e-6, n), "repeated": np.repeat([4.0, 3.0, 2.0, 1.0], n // 4), "close": 1 + np.arange(n) * 1e-10,
        "identity": np.ones(n), "deficient": np.r_[np.arange(1.0, 11), np.zeros(n - 10)], "wilkinson": np.ones(n),
    }[kind]
    matrix = q1 @ np.diag(values) @ q2
    if kind == "wilkinson":
        t = np.diag(np.abs(np.arange(-(n // 2), n - n // 2)).astype(float)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
        matrix = np.linalg.cholesky(t + 2.5 * np.eye(n)).T
    elif kind == "identity":
        matrix = np.eye(n) * 3
    squares, vectors = bidiagonal.right_vectors(matrix, n)
    true = np.sort(np.linalg.svd(matrix, compute_uv=False))[::-1]
    k = len(squares)
    assert k == (10 if kind == "deficient" else n)
    assert np.allclose(np.sqrt(squares), true[:k], rtol=1e-9, atol=1e-13 * true[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9
    residual = matrix.T @ (matrix @ vectors) - vectors * squares
    assert np.abs(residual).max() < 1e-12 * n * squares[0]
    rounds = np.linalg.qr(np.round(256 * rng.standard_normal((500, 64))), mode="r")  # many values close to each other
    assert np.allclose(np.sqrt(bidiagonal.right_vectors(rounds, 64)[0]), np.linalg.svd(rounds, compute_uv=False), rtol=1e-12)
    first, _ = bidiagonal.right_vectors(matrix, 4)
    assert np.allclose(first, squares[:4])


def test_qd_values_of_tiny_ends():
    """Relative accuracy: the smallest value of a graded bidiagonal, far below rounding of the largest."""
    d, u = np.geomspace(1, 1e-12, 12), np.geomspace(1, 1e-12, 12)[:-1] * 0.3
    got = bidiagonal.dqds((d**2).tolist(), (u**2).tolist())
    import fractions

    det = fractions.Fraction(1)
    for x in got:
        det *= fractions.Fraction(float(x))
    exact = fractions.Fraction(1)
    for x in d:
        exact *= fractions.Fraction(float(x)) ** 2
    assert abs(float(det / exact) - 1) < 1e-12  # the product of all squares is the squared determinant
    assert bidiagonal.dqds([4.0], []) == [4.0]


def test_plain_letters_are_stable():
    """Every letter that the encoder takes as plain has a lower case of one letter and no other normal form."""
    import re
    import unicodedata

    plain = [c for c in map(chr, range(0x20, 0x3000)) if re.match(tokenfiles.PLAIN, c)]
    assert len(plain) > 200
    for c in plain:
        assert unicodedata.category(c).startswith("L") and len(c.lower()) == 1 and c.lower() in plain
        assert unicodedata.normalize("NFC", c) == c
    marks = [c for c in map(chr, range(0x21, 0x7F)) if re.match(tokenfiles.MARKED, "a" + c)]
    assert set(marks) == set(tokenfiles.MARKS) and not any(c.isalnum() or c == "'" for c in marks)
