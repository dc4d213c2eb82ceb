"""Table readers and writers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tillage.operators import split
from tillage.sources import sinks
from tillage.sources.tables import load_table, read_csv


def test_csv_types_and_blanks(spark, tmp_path):
    p = tmp_path / "t.CSV"
    p.write_text('a,b,c,d,e\n1,1.5,x,true,2024-01-02\n\nNA,n/a,"q, ""z""",False,\n3,2,,,2024-02-03\n')
    df = load_table(spark, str(p))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "boolean", "string"]
    assert [tuple(r) for r in df.orderBy(F.col("a").asc_nulls_last()).collect()] == [
        (1, 1.5, "x", True, "2024-01-02"), (3, 2.0, None, None, "2024-02-03"), (None, None, 'q, "z"', False, None)]
    assert read_csv(spark, str(p), dates=True).schema["e"].dataType.simpleString() == "date"


def test_json_unites_keys(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "b": ""}, {"a": 2, "c": "x"}]')
    rows = sorted(tuple(r) for r in load_table(spark, str(tmp_path / "t.json")).select("a", "b", "c").collect())
    assert rows == [(1, None, None), (2, None, "x")]
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert load_table(spark, str(tmp_path / "one.json")).count() == 1


def book(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId2" Target="worksheets/other.xml"/><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/other.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"""<worksheet {main}><sheetData>
          <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="str"><v>day</v></c><c r="D1" t="str"><v>ok</v></c></row>
          <row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2" t="b"><v>1</v></c></row>
          <row r="3"><c r="B3"><v>4</v></c><c r="C3" s="2"><v>45293</v></c></row></sheetData></worksheet>""")


def test_xlsx(spark, tmp_path):
    book(tmp_path / "t.xlsx")
    df = load_table(spark, str(tmp_path / "t.xlsx"))
    assert df.columns == ["name", "n", "day", "ok"] and df.schema["n"].dataType.simpleString() == "bigint"
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: r[1]) == [("Anna", 3, "2024-01-01", True), (None, 4, "2024-01-02", None)]


def test_loading_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "t.doc"))
    with pytest.raises(Exception):
        load_table(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "empty.csv"))


def test_writers(spark, tmp_path, visits):
    sinks.write_csv(visits, str(tmp_path / "out"), bom=True)
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbffloor,")
    assert read_csv(spark, str(tmp_path / "out")).columns == visits.columns
    with pytest.raises(Exception):
        sinks.write_csv(visits, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sinks.write_csv(visits, str(tmp_path / "in/below"), [str(tmp_path / "in")])
    parts = split.split(visits.withColumn("i", F.monotonically_increasing_id()), ["i"], (70, 15, 15))
    sinks.write_splits(parts, str(tmp_path / "splits"))
    assert sorted(p.name for p in (tmp_path / "splits").glob("split=*")) == ["split=test", "split=train", "split=valid"]
    sinks.write_null_report(visits.withColumn("i", F.monotonically_increasing_id()), ["i"], str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/cells"), header=True).count() == 3


def numbered(spark, files):
    """Rows (file, line_no, line) of {file: lines} in mixed order; None is a file without lines."""
    rows = [(f, i, x) for f, texts in files.items() for i, x in enumerate([None] if texts is None else texts)]
    return spark.createDataFrame(rows, "file string, line_no long, line string").repartition(5, F.xxhash64("line_no", "file"))


@pytest.fixture
def eight_tasks(spark):
    """Shuffles of eight tasks however few the rows."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_lines_of_one_file_go_to_many_tasks(spark, tmp_path, monkeypatch, eight_tasks):
    """Neither the lines of one file nor those of one number meet in one task."""
    seen = []
    monkeypatch.setattr(sinks, "_save", lambda df, *rest: seen.append(df))
    lines = numbered(spark, {"a.json": [f"line {i}" for i in range(4000)]})
    sinks.save_lines(lines, str(tmp_path / "one"))
    sinks.save_lines(lines.withColumn("line_no", F.lit(1)), str(tmp_path / "ties"))
    for df in seen:
        assert max(n for _, n in df.groupBy(F.spark_partition_id()).count().collect()) < 1500


@pytest.mark.parametrize("anywhere", [True, False])
def test_files_of_many_tasks_are_whole(spark, tmp_path, monkeypatch, eight_tasks, anywhere):
    """Large, small and empty files, each byte for byte, put together in ranges of 700 bytes or streamed."""
    monkeypatch.setattr(sinks, "RANGE_BYTES", 700)
    monkeypatch.setattr(sinks, "_writes_anywhere", lambda fs: anywhere)
    files = {"d/large.json": [f'{{"é": "漢 {i}"}}' for i in range(900)], "a first.txt": ["x" * (i % 90) for i in range(400)], "z/last.txt": ["end"] * 200,
             "d/blank.txt": [None] * 300, "e/none.txt": None, **{f"m/{i}.txt": [str(i)] * (i % 3 + 1) for i in range(40)}}
    there = tmp_path / "out"
    assert sinks.save_lines(numbered(spark, files), str(there)) == (len(files), 0)
    for name, texts in files.items():
        assert (there / name).read_text() == "".join(f"{x}\n" for x in texts or [] if x is not None)
    left = {str(p.relative_to(there)) for p in there.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert left == {*files, "_report.json"} and not (there / "_parts").exists()
    assert (there / "_report.json").read_text() == f'{{"saved": {len(files)}, "failed": 0}}'


def test_ranges_cover_the_parts():
    pieces = [("a", 5), ("b", 0), ("c", 12), ("d", 3)]
    assert list(sinks._ranges(pieces, 8)) == [(0, [("a", 0, 5), ("c", 0, 3)]), (8, [("c", 3, 8)]), (16, [("c", 11, 1), ("d", 0, 3)])]
    assert list(sinks._ranges(pieces, 20)) == [(0, [("a", 0, 5), ("c", 0, 12), ("d", 0, 3)])] and list(sinks._ranges([("a", 0)], 4)) == []
