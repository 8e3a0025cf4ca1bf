"""Sheets read on executors."""

from loftline.sources import workbooks as w


def test_sheets_headers_footnotes_and_skips(spark, tmp_path):
    city = [["A title"], None, ["and a subtitle", None], ["State", "City", "Violent\ncrime", "Pop-ulation"], ["Oregon", "Bend", 12, 1000.0], [None, None, "unplaced"], ["", "Sisters & <co>", 2.5, True], ["A footnote", None]]
    people = [[None], ["", "x"], ["label", "n"], [".Lane County, Oregon", 5], ["note", None], [".Linn County, Oregon", 7], [".Polk County, Oregon", 9]]
    for name, sheets in (("a.xlsx", {"Cities": city, "People": people}), ("b.xlsx", {"Cities": city[:5]})):
        (tmp_path / name).write_bytes(w.workbook(sheets))
    (tmp_path / "c.txt").write_text("no workbook")
    files = w.workbooks(spark, str(tmp_path))
    got = w.sheet_rows(files, {"state": "state", "city": "CITY", "crime": "violent crime", "pop": "pop ulation", "gone": "no such"}, header=3, sheet="Cities", key="city")
    assert sorted((r["file"][-6:], r["row"], r["state"], r["city"], r["crime"], r["pop"], r["gone"]) for r in got.collect()) == [
        ("a.xlsx", 4, "Oregon", "Bend", "12", "1000", None), ("a.xlsx", 6, None, "Sisters & <co>", "2.5", "true", None), ("b.xlsx", 4, "Oregon", "Bend", "12", "1000", None),
    ]
    by_place = w.sheet_rows(files, {"county_state": 0, "population": 1}, header=2, sheet="People", skip=1)
    assert sorted((r["county_state"], r["population"]) for r in by_place.collect()) == [(".Linn County, Oregon", "7"), (".Polk County, Oregon", "9")]


def test_shared_strings_wide_columns_and_errors():
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(w.workbook({"S": [["x"]]}))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if "sheet1" not in name:
                new.writestr(name, old.read(name))
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>two </t></r><r><t>parts</t></r><rPh><t>no</t></rPh></si></sst>')
        new.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="A3" t="s"><v>1</v></c><c r="AB3" t="s"><v>0</v></c></row><row><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>kept</v></c></row></sheetData></worksheet>')
    rows = list(w.sheets_of(out.getvalue()))
    assert rows == [("S", 2, ["two parts", *[None] * 26, "one"]), ("S", 3, [None, "kept"])]


def test_no_rows(spark):
    files = spark.createDataFrame([("e", w.workbook({"S": []}))], "path string, content binary")
    assert w.sheet_rows(files, {"a": "a"}).collect() == [] and w.cells(files.limit(0)).collect() == []
