import io
import zipfile

import pytest

from tesserae.sources import archive, documents, stored, tables, versions
from tesserae.streaming import flows


def test_html_tables(spark):
    html = "<table><tr><th>Name<th>Mark</tr><tr><td>A&amp;b</td><td> 7 <b>m</b></td></tr></table><p>x<table><tr><td>1"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    out = sorted((r["doc"], r["table"], r["row"], r["cells"]) for r in documents.html_tables(df, "id", "html").collect())
    assert out == [(1, 0, 0, ["Name", "Mark"]), (1, 0, 1, ["A&b", "7 m"]), (1, 1, 0, ["1"])]


def test_workbook_cells(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Ann</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1"/></row></sheetData></worksheet>')
    df = spark.createDataFrame([("w", bytearray(held.getvalue()))], "id string, content binary")
    out = sorted(tuple(r) for r in documents.workbook_cells(df, "id", "content").collect())
    assert out == [("w", "sheet1", "A1", "Ann", None), ("w", "sheet1", "B1", "2", "1+1")]


def test_dump_json_lines_and_layout(spark):
    dump = "x\nCOPY public.t (a, b) FROM stdin;\n1\t\\N\n2\ty\n\\.\nz"
    df = spark.createDataFrame([(1, dump)], "id long, text string")
    assert [(r["table"], r["cells"]) for r in documents.dump_rows(df, "id", "text").collect()] == [("public.t", ["1", None]), ("public.t", ["2", "y"])]
    js = spark.createDataFrame([(1, '{"r": [{"n": "a"}, {"n": "b"}]}')], "id long, j string")
    assert [(r["index"], r["row"]["n"]) for r in documents.json_results(js, "id", "j", "$.r", "struct<n:string>").collect()] == [(0, "a"), (1, "b")]
    assert documents.located_row('{"r": [{"n": 1}, {"n": 2}]}', 1) == (17, 25) and documents.located_row("{}", 0) is None
    text = spark.createDataFrame([(1, "1 Ann 50\nDNS Bo\f\n2 Cy 40")], "id long, text string")
    out = documents.bounded_layout(documents.page_lines(text, "id", "text"), r"([0-9]+) (\w+) ([0-9]+)", ["rank", "name", "mark"]).orderBy("page", "line").collect()
    assert [(r["page"], r["parse_status"], (r["fields"] or {}).get("name")) for r in out] == [(1, "parsed", "Ann"), (1, "unresolved", None), (2, "parsed", "Cy")]


def test_checked_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert documents.checked_csv(spark, str(tmp_path / "a.csv"), "x int, y int").collect() == [(1, 2)]
    with pytest.raises(Exception, match="(?i)header"):
        documents.checked_csv(spark, str(tmp_path / "a.csv"), "x int, z int").collect()


def test_utf8_is_quarantined(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xff")), (3, None)], "id long, content binary")
    assert [(r["text"], r["quarantined"]) for r in documents.strict_utf8(df, "content").orderBy("id").collect()] == [("ok", False), (None, True), (None, False)]


def test_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a", "1"), ("b", "1"), ("c", "2")):
        (tmp_path / "in" / name).write_text(body)
    found = archive.objects(spark, str(tmp_path / "in"))
    fresh = archive.registered(found.limit(0), found)
    assert fresh.count() == 2 and archive.registered(fresh, found).count() == 0
    assert archive.listing_mismatches(found.where("path not like '%c'"), found.where("path not like '%a'")).count() == 2


def test_snapshots_and_imports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "job string, n long")
    path = str(tmp_path / "snap")
    archive.write_snapshot(df, path)
    assert archive.read_snapshot(spark, path).count() == 3
    assert archive.replayed(spark, path, df.repartition(3)) and not archive.replayed(spark, path, df.limit(2))
    second = spark.createDataFrame([("c", 9)], "job string, n long")
    # a writer that is lost before its digest leaves the snapshot before
    lost = versions.Store(spark, path)
    lost.commit(lost.pin(), replace={"records": second})
    assert archive.read_snapshot(spark, path).count() == 3
    archive.write_snapshot(second, path)
    assert [tuple(r) for r in archive.read_snapshot(spark, path).collect()] == [("c", 9)]
    part = versions.Store(spark, path).pin().tables["records"]["parts"][0]["path"]
    second.write.mode("append").parquet(part)
    with pytest.raises(ValueError):
        archive.read_snapshot(spark, path)
    with pytest.raises(ValueError):
        archive.read_snapshot(spark, str(tmp_path / "nothing"))
    copy = str(tmp_path / "copy")
    archive.exported(df, copy)
    assert archive.restored(spark, copy).exceptAll(df).isEmpty()
    second.write.mode("append").parquet(copy + "/files")
    with pytest.raises(ValueError):
        archive.restored(spark, copy)
    held = spark.createDataFrame([("h", "p")], "sha256 string, path string")
    states = archive.inventory(held, spark.createDataFrame([("a1", "h"), ("a2", "g")], "acquisition_id string, sha256 string"))
    assert {r["acquisition_id"]: r["state"] for r in states.collect()} == {"a1": "verified", "a2": "missing"}
    batch = spark.createDataFrame([("b", 1), ("c", 5)], "job string, n long")
    assert [tuple(r) for r in archive.imported(df, batch, "job").collect()] == [("c", 5)]
    with pytest.raises(ValueError):
        archive.imported(df, spark.createDataFrame([("b", 2)], "job string, n long"), "job")
    with pytest.raises(ValueError):
        archive.extended(df, batch, "job")


def test_delivery_is_resumed(spark, tmp_path):
    source, got = str(tmp_path / "in"), []
    spark.range(3).write.parquet(source)
    run = lambda: flows.delivered(spark.readStream.schema("id long").parquet(source), str(tmp_path / "at"), lambda df, n: got.append((n, df.count()))).awaitTermination()
    run()
    run()
    spark.range(2).write.mode("append").parquet(source)
    run()
    assert sum(n for _, n in got) == 5


def test_a_scope_removes_what_is_not_kept(spark):
    with stored.scope() as keep:
        a, b = stored.stored(spark.range(3), "a"), keep(stored.stored(spark.range(4), "b"))
        stored.removed(stored.stored(spark.range(1), "c"))
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|FAILED_READ_FILE|not found"):
        a.count()
    with pytest.raises(ValueError):
        with stored.scope():
            c = stored.stored(spark.range(3), "c")
            raise ValueError
    with pytest.raises(Exception, match="(?i)not exist|FAILED_READ_FILE|not found"):
        c.count()


def test_tables_are_stored(spark):
    df = tables.table(spark, "/root/testdata/sf0.001", "region")
    assert stored.stored(df, "t").exceptAll(df).isEmpty()
