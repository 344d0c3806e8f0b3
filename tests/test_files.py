"""Readers, writers and manifests."""

import io
import json
import shlex
import zipfile

import pytest
from pyspark.sql import functions as F

from seamline.sources import archives, readers, sinks, workbooks


def test_blank_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sentence_index": 1, "sentence_text_full": "ü"}\n\n{"sentence_index": 2}\n', encoding="utf-8")
    assert [(r.sentence_index, r.sentence_text_full) for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), readers.SENTENCE).collect()] == [(1, "ü"), (2, None)]


def test_roles():
    assert readers.infer_role(["Nr", "Scene nr", "scene_id"], *readers.ROLES["scene"]) == "scene_id"
    assert readers.infer_role(["Nr", "Scene nr"], *readers.ROLES["scene"]) == "Scene nr"
    assert readers.infer_role(["a"], *readers.ROLES["text"]) is None


def test_manifest_checks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abcdef")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.txt").write_bytes(b"b")
    (tmp_path / "c.other").write_bytes(b"c")
    files = sinks.build_manifest(sinks.read_files(spark, str(tmp_path), "*.txt"), f"file:{tmp_path}/")
    assert sorted((r.name, r.path, r.size_bytes) for r in files.collect()) == [("a.txt", "a.txt", 6), ("b.txt", "deep/b.txt", 1)]
    ok = files.select("name", "size_bytes", "md5")
    assert sinks.verify_manifest(ok, files).count() == 0
    wrong = spark.createDataFrame([("a.txt", 7, None)], "name string, size_bytes long, md5 string")
    assert sinks.verify_manifest(wrong, files).head().error == "size mismatch"


def test_overrides_as_json(spark, tmp_path):
    for name, text in (("p.json", '{"patches": [{"key": "a:1", "label": "border"}]}'), ("l.json", '[{"key": "a:1", "label": "border", "reason": null}]')):
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in readers.read_overrides(spark, str(tmp_path / name)).collect()] == [("a:1", "BORDER", "Manual override.")]


def test_scene_features():
    assert archives.scene_features('{"reason": "3, time, other"}', ("time",)) == (3, ["time"])
    assert archives.scene_features("no json", ("time",)) == (None, [])


def test_sidecars(spark):
    words = F.array(F.lit("run"), F.lit("a b"), F.lit("it's"), F.lit("--x=1"))
    r = spark.range(1).select(*sinks.repro_files(words, b=F.lit(1), a=F.lit('"ü"'), c=F.lit(None).cast("string"))).head()
    assert r["command.txt"] == shlex.join(["run", "a b", "it's", "--x=1"]) + "\n"
    assert r["config.json"] == json.dumps({"b": 1, "a": '"ü"', "c": None}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def test_csv_keeps_order_and_booleans(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 'a "q"\nb')], "x int, flag boolean, t string")
    sinks.write_csv(df, str(tmp_path / "c"), ["t", "flag"])
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c")).collect()] == [('a "q"\nb', "TRUE")]


def test_workbooks_keep_cells(spark):
    rows = [("a & <b>", 1, 2.5, True, "TP"), (None, None, None, None, "FN"), ("  \r\n\t\"ü\" 中", -7, 1e-9, False, "?"), ("", 0, 0.0, None, None)]
    read = workbooks.read_xlsx(workbooks.write_xlsx(["t", "n", "x", "b", "s"], rows, fill_by="s"))
    assert [[v for v, _ in r] for r in read[1:]] == [["a & <b>", "1", "2.5", "TRUE", "TP"], [None, None, None, None, "FN"], ["  \r\n\t\"ü\" 中", "-7", "1e-09", "FALSE", "?"], ["", "0", "0.0"]]
    assert [r[4][1] for r in read[1:4]] == ["C6EFCE", "FFEB9C", None] and [v for v, _ in read[0]] == ["t", "n", "x", "b", "s"]
    assert [workbooks.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbooks._column(workbooks.column_name(k) + "9") == k for k in range(0, 2000, 7))


def test_workbooks_of_others(spark):
    """Shared strings with runs and hints, cells without references, formulas, several sheets."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="x"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r2" Target="/xl/two.xml"/><Relationship Id="r1" Target="one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><r><t>he</t></r><r><t>ad</t></r><rPh><t>no</t></rPh></si><si><t>x</t></si></sst>")
        z.writestr("xl/one.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/two.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2" t="str"><f>A1&amp;"!"</f><v>head!</v></c></row></sheetData></worksheet>')
    assert workbooks.read_xlsx(out.getvalue()) == []
    files = spark.createDataFrame([("w.xlsx", bytearray(out.getvalue()))], "path string, content binary")
    assert [tuple(r) for r in workbooks.sheet_rows(files, ["head", "x", "y"], "Two").collect()] == [("w.xlsx", 1, None, "head!", None)]


def test_too_many_rows_are_no_sheet(monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    with pytest.raises(ValueError):
        workbooks.write_xlsx(["a"], [(1,)] * 4)


def test_sources_are_looked_for(spark):
    rows = [(1, "a", "m", ["c"]), (2, None, "m", ["a"]), (3, None, None, ["x", "c", "a"]), (4, "x", "a", ["a"]), (5, None, None, []), (6, None, None, None)]
    df = spark.createDataFrame(rows, "id int, explicit string, manifest_first string, candidates array<string>")
    files = spark.createDataFrame([("a",), ("c",), ("m",), ("a",)], "path string")
    got = {r.id: (r.source, r.error) for r in readers.resolve_source(df, files, ["id"]).collect()}
    assert got == {1: ("a", None), 2: ("m", None), 3: ("c", None), 4: (None, "missing file"), 5: (None, "no source"), 6: (None, "no source")}


def test_entry_has_sql_only_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
