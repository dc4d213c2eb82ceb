"""Large CSV and JSON documents read in blocks against the one-task readers, and against plain parsers."""

import csv
import io
import json
import random
from collections import Counter

import pytest

from tillage.sources import blocks
from tillage.sources.tables import read_csv, read_json


@pytest.fixture
def small_blocks(spark):
    """Blocks of about a hundred bytes."""
    confs = {"spark.sql.files.maxPartitionBytes": "101", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cells(rng, breaks):
    parts = ["a", "b c", ",", '"', '""', "'", "x,y", "é漢", "", " ", '5" pipe', "NA"] + (["\n", "line\nbreak", '"\n"', "\n\n", ",\n,"] if breaks else [])
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))


def same(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_csv_blocks_equal_one_task(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    for turn, (ending, breaks) in enumerate((("\n", True), ("\r\n", True), ("\n", False))):
        there = tmp_path / f"t{turn}"
        there.mkdir()
        for part in range(2):
            rows = [(i, cells(rng, breaks), cells(rng, breaks), rng.choice([None, 1.5])) for i in range(60)]
            rows.append((99, "long " * 150 + ("\n" * 300 if breaks else ""), "z", None))  # crosses several blocks
            out = io.StringIO()
            csv.writer(out, lineterminator=ending).writerows([("id", "first", "the second", "n"), *rows])
            (there / f"p{part}.csv").write_bytes((("﻿" if part == 0 else "") + out.getvalue()).encode())
        got = read_csv(spark, str(there), split=True)
        assert blocks._pieces(spark, str(there), "\n").rdd.getNumPartitions() > 20
        same(got, read_csv(spark, str(there), split=False))
        assert got.count() == 122


def test_csv_with_odd_quotes(spark, tmp_path, small_blocks):
    """A quote inside a bare cell opens nothing, blank lines are no records, short rows are filled, an open last cell ends with the file."""
    body = 'a,b,c\n1,5" pipe,x\n\n2,"say ""hi""\nthere",y\n3,z\n' + "4,plain,w\n" * 40 + '5,"",""""\n6,it"s,"q"\n7,"open to the end\nof it'
    path = tmp_path / "t.csv"
    path.write_text(body)
    same(read_csv(spark, str(path), split=True), read_csv(spark, str(path), split=False))
    head = tmp_path / "h.csv"
    head.write_text('"a\nlong ' + "name" * 60 + '",b\n1,2\n')  # a header across several blocks
    same(read_csv(spark, str(head), split=True), read_csv(spark, str(head), split=False))


def test_large_files_are_split_by_themselves(spark, tmp_path, small_blocks):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + '1,"x\ny"\n' * 200)
    assert read_csv(spark, str(path)).rdd.getNumPartitions() > 1
    doc = tmp_path / "t.json"
    doc.write_text(json.dumps([{"a": i} for i in range(200)]))
    assert read_json(spark, str(doc)).count() == 200


def test_csv_state_equals_parser():
    rng = random.Random(3)
    for _ in range(3000):
        line = "".join(rng.choice(['"', '"', ",", "a", " "]) for _ in range(rng.randint(0, 9)))
        if rng.random() < 0.5 and '"' in line:
            continue
        for inside in (False, True):
            state, at_start, i = inside, not inside, 0
            while i < len(line):  # letter by letter
                c = line[i]
                if state:
                    if c == '"' and line[i + 1 : i + 2] == '"':
                        i += 1
                    elif c == '"':
                        state = False
                elif c == '"' and at_start:
                    state = True
                at_start = not state and c == "," if not state else False
                i += 1
            assert blocks.csv_state(line, inside) == state, (line, inside)


def test_json_blocks_equal_one_task(spark, tmp_path, small_blocks):
    rng = random.Random(2)

    def value(depth=0):
        return rng.choice([
            lambda: rng.randint(-5, 99), lambda: None, lambda: cells(rng, True), lambda: 'br}ace{ ["', lambda: "back\\slash\\\\", lambda: "",
            lambda: {"in": value(depth + 1), "er}": "}"} if depth < 2 else "deep", lambda: [value(2) for _ in range(3)],
        ])()

    for turn, layout in enumerate((None, 2)):
        rows = [{"id": i, "text": str(value()), "nested": {"k": str(value()), "l": [1, 2]}, **({"more": i} if i % 7 == 0 else {})} for i in range(80)]
        rows.append({"id": 1000, "text": "{[" * 400})
        path = tmp_path / f"t{turn}.json"
        path.write_text(("\n " if turn else "") + json.dumps(rows, indent=layout, ensure_ascii=bool(turn)))
        got = read_json(spark, str(path), split=True)
        assert got.rdd.getNumPartitions() >= 1 and got.count() == 81
        same(got, read_json(spark, str(path), split=False))
    one = tmp_path / "one.json"
    one.write_text(json.dumps({"a": {"b": [{"c": 1}, {"c": 2}]}, "text": "x}" * 90}))
    same(read_json(spark, str(one), split=True), read_json(spark, str(one), split=False))
