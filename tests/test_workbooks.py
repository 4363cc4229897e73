"""Workbooks read in parts."""

import zipfile

import pytest

from dossier.sources import xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MORE = 'xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac"'


def book(path, sheets, shared=(), styles="", prefix=""):
    """sheets: name -> XML between sheetData's tags."""
    p, ns = (f"{prefix}:" if prefix else ""), (f'xmlns:{prefix}="{MAIN}"' if prefix else f'xmlns="{MAIN}"')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{s}</t></r><r><t>!</t></r></si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        for k, xml in enumerate(sheets.values()):
            data = f"<{p}sheetData/>" if xml is None else f"<{p}sheetData>{xml}</{p}sheetData>"
            z.writestr(f"xl/worksheets/s{k}.xml", f"<?xml version='1.0'?><{p}worksheet {ns} {MORE}><{p}cols><{p}col/></{p}cols>{data}<{p}rowBreaks/></{p}worksheet>")
    return path


def plain(path, sheet=None):
    """The records of a workbook read from one end to the other."""
    out = []
    for at, name, names, cells in xlsx._records(path, sheet):
        if not all(c is None for c in cells):
            values = dict(zip(names, cells))
            out.append((at, name, {k: None if v is None else str(v) for k, v in values.items()}, {k: type(v).__name__ for k, v in values.items() if v is not None}))
    return out


def rows(n, p=""):
    """Strings, shared strings behind formulas, numbers, dates, gaps, blank and self-closed rows, rows without a number."""
    out = [f'<{p}row r="2" x14ac:dyDescent="0.2"><{p}c t="inlineStr"><{p}is><{p}t>Name</{p}t></{p}is></{p}c><{p}c t="s"><{p}v>0</{p}v></{p}c><{p}c t="str"><{p}v>When</{p}v></{p}c></{p}row>']
    for k in range(n):
        own = "" if k % 3 else f' r="{10 + 2 * k}"'
        if k % 11 == 5:
            out.append(f"<{p}row{own}/>")
        elif k % 11 == 7:
            out.append(f"<{p}row{own}><{p}c/></{p}row>")
        else:
            out.append(f"<{p}row{own}><{p}c t='inlineStr'><{p}is><{p}t>person {k} &lt;row&gt; é</{p}t></{p}is></{p}c><{p}c t=\"s\" s=\"0\"><{p}f>A{k}</{p}f>\n<{p}v>{k % 5}</{p}v></{p}c>" + (f'<{p}c s="1"><{p}v>{45000 + k}.5</{p}v></{p}c>' if k % 2 else f'<{p}c r="D{k}" t="b"><{p}v>1</{p}v></{p}c>') + f"</{p}row>")
    return "".join(out)


STYLES = f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'


@pytest.mark.parametrize("prefix", ["", "x"])
@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
def test_parts_give_the_rows_of_one_reading(spark, tmp_path, monkeypatch, prefix, size):
    monkeypatch.setattr(xlsx, "PART_BYTES", size)
    path = book(str(tmp_path / "b.xlsx"), {"S": rows(120, f"{prefix}:" if prefix else "")}, [f"s{k}" for k in range(5)], STYLES, prefix)
    got, warnings, meta = xlsx.read_workbook(spark, path)
    want = plain(path)
    assert sorted(((r["row_number"], r["sheet_name"], r["values"], r["value_types"]) for r in got.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert meta["row_count"] == len(want) and meta["column_names"] == ["Name", "s0!", "When"]
    assert {r["code"] for r in warnings.collect()} == {"SKIPPED_BLANK_ROW"} and warnings.count() == sum(k % 11 in (5, 7) for k in range(120))
    parts = xlsx.sheet_parts(spark.read.format("binaryFile").load(path), None, size).where("part >= 0")
    assert (parts.count() > 20) == (size == 150) and parts.agg({"rows": "sum"}).first()[0] == 121


def test_many_workbooks_of_which_some_are_broken(spark, tmp_path):
    one = '<row><c t="inlineStr"><is><t>A</t></is></c></row>'
    three = '<row><c><v>1</v></c><c><v>2</v></c><c><v>3</v></c></row>'
    book(str(tmp_path / "a.xlsx"), {"S": one + "<row><c><v>7</v></c></row>"})
    book(str(tmp_path / "b.xlsx"), {"S": one, "T": three + three, "U": None})
    book(str(tmp_path / "c.xlsx"), {"S": three + three, "T": three + three})
    book(str(tmp_path / "d.xlsx"), {"S": None})
    book(str(tmp_path / "e.xlsx"), {"S": one + "<row><c t='s'><v>99</v></c></row>"})
    (tmp_path / "f.xlsx").write_text("no zip")
    got, warnings, books = xlsx.read_workbooks(spark, str(tmp_path) + "/*.xlsx")
    said = {r["path"][-6:-5]: r for r in books.collect()}
    assert {k: (r["sheet"], r["row_count"], r["kind"]) for k, r in said.items()} == {"a": ("S", 1, None), "b": ("T", 1, None), "c": (None, 0, "SheetUnknown"), "d": ("S", 0, None), "e": ("S", 0, "CorruptedSource"), "f": (None, 0, "CorruptedSource")}
    assert {(r["path"][-6:-5], r["code"]) for r in warnings.collect()} == {("b", "SHEET_AUTO_SELECTED")}
    assert sorted((r["path"][-6:-5], r["values"]) for r in got.collect()) == [("a", {"A": "7"}), ("b", {"1": "1", "2": "2", "3": "3"})]
    assert said["b"]["sheets"] == ["S", "T", "U"]


def test_what_stops_an_import(spark, tmp_path):
    with pytest.raises(xlsx.FileMissing):
        xlsx.read_workbook(spark, str(tmp_path / "no.xlsx"))
    with pytest.raises(xlsx.UnsupportedFile):
        xlsx.read_workbook(spark, __file__)
    path = book(str(tmp_path / "a.xlsx"), {"S": None, "T": None})
    with pytest.raises(xlsx.SheetUnknown):
        xlsx.read_workbook(spark, path)
    with pytest.raises(xlsx.SheetUnknown):
        xlsx.read_workbook(spark, path, "Z")
    with pytest.raises(xlsx.EmptySource):
        xlsx.read_workbook(spark, path, "S")
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(xlsx.CorruptedSource):
        xlsx.read_workbook(spark, str(tmp_path / "bad.xlsx"))
