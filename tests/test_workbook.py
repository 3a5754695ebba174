"""The xlsx source and sink, prechecks and gold rows over generated workbooks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from jurata.operators.ranks import numbered
from jurata.schemas import GOLD_COLUMNS, INPUT_COLUMNS, LABELS
from jurata.sources import workbook as B
from jurata.sources.xlsx import WorkbookTooLarge, XlsxDataSource, guarded, sheets, write_workbook

HEAD = list(INPUT_COLUMNS)


def row(i, q="q", a="a", **refs):
    return (i, q, a, *[refs.get(f"ref{k}") for k in range(1, 11)])


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    spark.dataSource.register(XlsxDataSource)
    folder = tmp_path_factory.mktemp("books")

    def run(name, tables, **options):
        path = f"{folder}/{name}.xlsx"
        write_workbook(path, {s: (c, iter(r)) for s, (c, r) in tables.items()})
        reader = spark.read.format("xlsx")
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(path)

    return run


def test_passed(read):
    cells = read("normal", {"QA_REF": (HEAD, [row(1), row(2.0, ref1=" x\r\ny "), row(None, None, None), row("007", ref3="z")])})
    assert B.precheck(cells).drop("file").first()[:] == ("passed", 3, 3, 0, 1, [], ["NUMERIC_RECORD_ID_LEADING_ZEROS"])
    got = B.input_records(cells).orderBy("order_index").collect()
    assert [(r.record_id, r.source_row, r.order_index) for r in got] == [("1", 2, 0), ("2", 3, 1), ("007", 5, 2)]
    assert got[1].refs.ref1 == "x\ny" and got[0].refs.ref1 is None


def test_header_gates(read):
    no_a = [c for c in HEAD if c != "a"]
    r = B.precheck(read("missing", {"S": (no_a + ["q"], [tuple("x" * 13)])})).first()
    assert (r.status, r.blockers, r.total) == ("blocked", ["MISSING_COLUMNS"], None)
    r = B.precheck(read("twice", {"S": (HEAD + ["q"], [(*row("1"), "x")])})).first()
    assert (r.status, r.blockers, r.total) == ("blocked", ["DUPLICATE_COLUMNS"], None)
    r = B.precheck(read("extra", {"S": (HEAD + ["more"], [(*row("1"), "x")])})).first()
    assert (r.status, r.warnings) == ("passed", ["EXTRA_COLUMNS_UNUSED"])


def test_row_gates(read):
    cells = read("rows", {"S": (HEAD, [row("1"), row("2", q=None), row("1", q=" "), row("4", q="#N/A", ref1="#REF!")])})
    r = B.precheck(cells, max_records=3).first()
    assert r.blockers == ["DUPLICATE_RECORD_ID", "TOO_MANY_RECORDS"] and (r.total, r.valid, r.input_invalid) == (4, 1, 3)
    reasons = {x.source_row: x.reason for x in B.input_records(cells).collect()}
    assert reasons[2] is None and reasons[3] == "q：缺失或为空" and "#N/A" in reasons[5] and "ref1" in reasons[5]
    assert B.precheck(read("none", {"S": (HEAD, [row("1", q=None)])})).first().blockers == ["NO_VALID_RECORDS"]


def test_formulas(spark, tmp_path):
    spark.dataSource.register(XlsxDataSource)
    path = f"{tmp_path}/f.xlsx"
    write_workbook(path, {"S": (HEAD, iter([row("1"), row("2")]))})
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    xml = parts["xl/worksheets/sheet1.xml"].decode()
    q = '<c t="inlineStr"><is><t xml:space="preserve">q</t></is></c>'
    xml = xml.replace(q, "<c><f>A1</f></c>", 1).replace(q, '<c t="str"><f>A1</f><v>kept</v></c>', 1)
    parts["xl/worksheets/sheet1.xml"] = xml.encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    got = {r.record_id: r for r in B.input_records(spark.read.format("xlsx").load(path)).collect()}
    assert "公式" in got["1"].reason and got["2"].q == "kept" and got["2"].reason is None


def test_sheet_choice(spark, read):
    both = read("both", {"A": (["x"], []), "B": (["x"], [])}, mode="catalog")
    assert B.selected_sheet(both).first().sheet is None
    assert B.selected_sheet(both, "B").first().sheet == "B" and B.selected_sheet(both, "Z").first().sheet is None
    assert B.selected_sheet(read("pref", {"A": (["x"], []), "QA_REF": (["x"], [])}, mode="catalog")).first().sheet == "QA_REF"
    assert B.selected_sheet(read("one", {"A": (["x"], [])}, mode="catalog")).first().sheet == "A"


def test_guards(tmp_path):
    path = f"{tmp_path}/many.xlsx"
    write_workbook(path, {f"s{i}": (["x"], iter([])) for i in range(51)})
    with pytest.raises(WorkbookTooLarge):
        guarded(path)
    with pytest.raises(WorkbookTooLarge):
        guarded(path, max_upload=10)
    with pytest.raises(ValueError):
        write_workbook(path, {"s": (["x"], iter([("=1+1",)]))})


def test_write_and_read_back(spark, tmp_path):
    spark.dataSource.register(XlsxDataSource)
    df = spark.createDataFrame([(1, "a<b", True), (2, None, False)], "n int, t string, b boolean")
    df.coalesce(1).write.format("xlsx").mode("append").option("sheet", "结果").save(f"{tmp_path}/out")
    path = f"{tmp_path}/out/part-00000.xlsx"
    cells = {(r.row, r.col): (r.kind, r.value) for r in spark.read.format("xlsx").load(path).collect()}
    assert cells[1, 2] == ("s", "t") and cells[2, 2] == ("s", "a<b") and cells[2, 1] == ("n", "1") and cells[3, 3] == ("b", "0") and (3, 2) not in cells
    with zipfile.ZipFile(path) as z:
        assert [s.name for s in sheets(z)] == ["结果"]
    digest = B.file_digests(spark, path).first()
    assert len(digest.sha256) == 64 and digest.file == path


def test_gold(read):
    judged, why, keys, out, out_why = GOLD_COLUMNS
    head = HEAD + list(GOLD_COLUMNS)
    g = lambda i, label=LABELS[0], reason="r", key=None, gone=None, gone_why=None, **kw: (*row(i, **kw), label, reason, key, gone, gone_why)
    rows = [g("1", key="ref1，ref2", ref1="x", ref2="y"), g("1"), g(None), g("3", label=None), g("4", label="?"), g("5", gone="是", gone_why="w", label=None), g("6", gone="是"), g("7", gone="maybe"), g("8", key="ref11;ref1"), g("9", reason=None), g("10", q=None)]
    got = {r.source_row: r for r in B.gold_rows(read("gold", {"G": (head, rows)})).collect()}
    assert {k: r.problems for k, r in got.items()} == {2: [], 3: ["GOLD_ID_DUPLICATE"], 4: ["GOLD_ID_MISSING"], 5: ["GOLD_UNDECIDED"], 6: ["GOLD_LABEL_INVALID"], 7: [], 8: ["GOLD_EXCLUDED_HAS_LABEL", "GOLD_EXCLUSION_REASON_MISSING"], 9: ["GOLD_EXCLUDED_INVALID"], 10: ["GOLD_KEY_REF_UNKNOWN", "GOLD_KEY_REF_EMPTY"], 11: [], 12: ["GOLD_INPUT_FIELD_MISSING"]}
    assert got[2].key_refs == ["ref1", "ref2"] and got[7].excluded and got[11].warnings == ["GOLD_REASON_MISSING"]


def test_gold_metadata(read):
    cells = read("meta", {"M": (["项", "值"], [("数据版本", "v1"), ("核定人", "x"), ("核定日期", "2026-99-99"), ("原始文件sha256前12位", "ABCDEF012345"), ("数据版本", "v2")])}).where("row > 1")
    r = B.gold_metadata(cells).first()
    assert r["数据版本"] == "v2" and r.problems == []
    bad = read("meta2", {"M": (["项", "值"], [("核定日期", "today")])}).where("row > 1")
    assert B.gold_metadata(bad).first().problems == ["GOLD_META_INCOMPLETE", "GOLD_META_INVALID_DATE"]




def test_typed_cells(spark, tmp_path):
    """Stored results keep their kind, numbers their digits, and date formats show dates; the same from bytes as from a path."""
    from jurata.sources.xlsx import stored_cells

    spark.dataSource.register(XlsxDataSource)
    path = f"{tmp_path}/t.xlsx"
    write_workbook(path, {"S": (["x"], iter([]))})
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    given = [
        ("<c><v>12345678901234567</v></c>", "n", "12345678901234567"), ("<c><v>1E-05</v></c>", "n", "1e-05"), ("<c><v>1E5</v></c>", "n", "100000"), ("<c><v>12345678.5</v></c>", "n", "12345678.5"), ("<c><v>1E+23</v></c>", "n", "99999999999999991611392"),
        ('<c t="str"><f>A1</f><v>007</v></c>', "s", "007"), ('<c t="str"><f>A1</f><v>1e5</v></c>', "s", "1e5"), ('<c t="b"><f>A1</f><v>1</v></c>', "b", "1"), ("<c><f>A1</f><v>7.0</v></c>", "n", "7"), ("<c><f>A1</f></c>", None, None), ('<c t="e"><f>A1</f><v>#N/A</v></c>', "e", "#N/A"),
        ('<c s="1"><v>45292</v></c>', "d", "2024-01-01 00:00:00"), ('<c s="1"><v>45292.75</v></c>', "d", "2024-01-01 18:00:00"), ('<c s="2"><v>0.5</v></c>', "d", "12:00:00"), ('<c s="3"><v>1.5</v></c>', "d", "1 day, 12:00:00"), ('<c s="4"><v>45292</v></c>', "n", "45292"), ('<c s="5"><v>45292</v></c>', "d", "2024-01-01 00:00:00"), ('<c s="1"><v>1</v></c>', "d", "1900-01-01 00:00:00"), ('<c s="1"><f>A1</f><v>45292</v></c>', "d", "2024-01-01 00:00:00"), ('<c t="d"><v>2024-01-01</v></c>', "d", "2024-01-01"), ('<c s="6"><v>3</v></c>', "n", "3"),
    ]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rows = "".join(f"<row>{c}</row>" for c, _, _ in given)
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>'.encode()
    formats = ["0", "14", "20", "46", "164", "165", "166"]
    codes = {"164": "0.0&quot; days&quot;", "165": "[$-804]yyyy\\年m;@", "166": "[Red]\\d0"}
    parts["xl/styles.xml"] = (f'<styleSheet xmlns="{main}"><numFmts>' + "".join(f'<numFmt numFmtId="{i}" formatCode="{c}"/>' for i, c in codes.items()) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{i}"/>' for i in formats) + "</cellXfs></styleSheet>").encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    found = spark.read.format("xlsx").load(path).collect()
    got = {r.row: (r.cached_kind, r.cached) if r.kind == "f" else (r.kind, r.value) for r in found}
    assert [got[i] for i in range(1, len(given) + 1)] == [(k, v) for _, k, v in given]
    assert sorted(map(tuple, stored_cells(spark, path).collect())) == sorted(map(tuple, found))
    assert [tuple(r)[1:] for r in stored_cells(spark, path, catalog=True).collect()] == [("S", True)]


def test_stored_results_as_text(spark):
    rows = [("f", 2, 1, "f", "=A", "007", "s"), ("f", 2, 2, "f", "=A", "1", "b"), ("f", 2, 3, "f", "=A", "7", "n"), ("f", 2, 4, "d", "2024-01-01 00:00:00", None, None)]
    names = "file string, row int, col int, kind string, value string, cached string, cached_kind string"
    head = [("f", 1, i, "s", n, None, None) for i, n in enumerate(HEAD[:4], 1)]
    r = B.rows_of(spark.createDataFrame(head + rows, names), HEAD[:4]).first()
    assert [r[c] for c in HEAD[:4]] == ["007", "TRUE", "7", "2024-01-01 00:00:00"] and not r.numeric_id


def test_rows_of_a_sheet(tmp_path):
    from jurata.sources import xlsx

    out = []
    assert xlsx.sheet_xml(["a"], iter([(i,) for i in range(300)]), out.append, max_rows=300) == 300 and "".join(out).count("<row>") == 301
    with pytest.raises(WorkbookTooLarge):
        xlsx.sheet_xml(["a"], iter([(1,)] * 4), out.append, max_rows=3)


def test_shared_paths(spark, tmp_path):
    """Files of the driver go through Spark's file systems; other schemes aren't taken as local paths."""
    from jurata.sources import files, xlsx

    for path in (f"{tmp_path}/d/x.bin", f"file://{tmp_path}/d/y.bin"):
        files.put(spark, path, b"1")
        files.put(spark, path, b"22")
        assert files.exists(spark, path) and files.get(spark, path) == b"22"
        files.remove(spark, path)
        assert not files.exists(spark, path)
    with pytest.raises(ValueError, match="another file system"):
        xlsx._mounted({}, "s3a://bucket/x.xlsx")


def test_verified(spark):
    stored = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "1", "1")], "file string, sha256 string, sha256_now string")
    was = spark.createDataFrame([("a", 2, "q", None), ("c", 2, "q", None), ("c", 3, "r", None)], "file string, source_row int, q string, a string")
    now = spark.createDataFrame([("a", 2, "q", None), ("c", 2, "q", "x")], "file string, source_row int, q string, a string")
    assert sorted(map(tuple, B.verified(stored, was, now).collect())) == [("b", "DIGEST_CHANGED"), ("c", "ROWS_CHANGED")]


def test_missing_metadata(spark, read):
    cells = read("meta3", {"M": (["项", "值"], [("数据版本", "v1")])})
    files = spark.createDataFrame([("none",)], "file string").union(cells.select("file").distinct())
    got = {r.file == "none": r.problems for r in B.gold_metadata(cells.where("row > 1"), files).collect()}
    assert got == {True: ["GOLD_META_MISSING"], False: ["GOLD_META_INCOMPLETE"]}


def test_samples(spark, tmp_path):
    """Each sample is blocked or passes as its name says, read from bytes."""
    from jurata.sources import files, samples
    from jurata.sources.xlsx import stored_cells

    for name in samples.samples():
        files.put(spark, f"{tmp_path}/s/{name}.xlsx", samples.sample_bytes(name))
    got = {r.file.rsplit("/", 1)[1][:-5]: (r.blockers, r.total, r.valid, r.skipped_blank_rows, r.warnings) for r in B.precheck(stored_cells(spark, f"{tmp_path}/s")).collect()}
    assert got == {
        "passed": ([], 3, 3, 0, []), "blank_rows": ([], 2, 2, 1, []), "missing_column": (["MISSING_COLUMNS"], None, None, None, []), "repeated_column": (["DUPLICATE_COLUMNS"], None, None, None, []),
        "extra_column": ([], 3, 3, 0, ["EXTRA_COLUMNS_UNUSED"]), "repeated_ids": (["DUPLICATE_RECORD_ID"], 2, 2, 0, []), "unreadable_cells": ([], 3, 1, 0, []), "no_valid_record": (["NO_VALID_RECORDS"], 1, 0, 0, []),
    }
    files.put(spark, f"{tmp_path}/g.xlsx", samples.gold_bytes([(*samples.record("1"), LABELS[0], "r", None, None, None)], {"数据版本": "v1"}))
    cells = stored_cells(spark, f"{tmp_path}/g.xlsx")
    assert B.gold_rows(cells.where("sheet = 'gold'")).first().problems == [] and B.gold_metadata(cells.where("sheet = 'meta' and row > 1")).first().problems == ["GOLD_META_INCOMPLETE"]


def test_uploads(spark, tmp_path):
    import hashlib
    import io

    from jurata.sources import files

    data = bytes(range(256)) * 50
    assert files.put_stream(spark, f"{tmp_path}/u/a.bin", io.BytesIO(data), len(data), piece=1000) == (len(data), hashlib.sha256(data).hexdigest())
    assert files.get(spark, f"{tmp_path}/u/a.bin") == data
    with pytest.raises(files.TooLarge):
        files.put_stream(spark, f"{tmp_path}/u/b.bin", io.BytesIO(data), len(data) - 1, piece=1000)

    class Broken(io.BytesIO):
        def read(self, n=-1):
            raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        files.put_stream(spark, f"{tmp_path}/u/c.bin", Broken(), 10)
    assert [p.name for p in (tmp_path / "u").iterdir() if not p.name.startswith(".") or ".part" in p.name] == ["a.bin"]


def test_one_long_file_is_dealt_to_tasks(spark):
    """the rows of a single file lie in several tasks, and a column is looked up once, not once per use of it."""
    cells = [("f", 1, i, "s", n) for i, n in enumerate((*HEAD, *GOLD_COLUMNS), 1)] + [("f", r, c, "s", str(r) if c == 1 else "x") for r in range(2, 402) for c in (1, 2, 3) if (r, c) != (7, 1)]
    cells = spark.createDataFrame(cells, "file string, row int, col int, kind string, value string").withColumns({"cached": F.lit(None).cast("string"), "cached_kind": F.lit(None).cast("string")})
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert B.rows_of(cells).groupBy(F.spark_partition_id()).count().count() > 1
        gold = B.gold_rows(cells)
        assert gold.groupBy(F.spark_partition_id()).count().count() > 1
        assert len(gold._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert {r.source_row: r.problems for r in gold.where("source_row < 9").collect()} == {r: ["GOLD_ID_MISSING"] * (r == 7) + ["GOLD_UNDECIDED"] for r in range(2, 9)}
    assert [tuple(r) for r in B.input_records(cells).orderBy("order_index").select("order_index", "source_row").collect()] == [(i, i + 2) for i in range(400)]
    assert B.precheck(cells).select("total", "blockers").first()[:] == (400, [])


def test_places_within_keys(spark):
    rows = [(k, i) for k in ("a", None, "b") for i in (range(300) if k == "a" else range(5))]
    got = numbered(spark.createDataFrame(rows, "k string, i int").repartition(7), ["k"], ["i"]).collect()
    assert sorted((r.k or "", r.i, r.place) for r in got) == sorted((k or "", i, i + 1) for k, i in rows)
