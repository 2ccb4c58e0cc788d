"""Workbooks made here, read back, and the catalogue that one of them holds."""

import json

import pytest

from corrobora.plans.made_workbook import NAMES, made
from corrobora.sources import catalogue, workbook

ROWS = [
    ["Function", "Category", "Subcategory"],
    ["GOVERN (GV): The strategy is established", None, None],
    [None, "Organizational Context (GV.OC): The circumstances", None],
    [None, None, "GV.OC-01: The mission is understood & informs <risk>  "],
    [None, None, "GV.OC-02: [Withdrawn: moved to GV.OC-01]"],
    [None, "Retired Things (GV.XX): none", "GV.XX-01: Not of these categories"],
    ["IDENTIFY (ID): Risks are understood", "Asset Management (ID.AM): Assets", "ID.AM-01: Inventories of\nhardware are kept"],
    [None, None, "Ex1: an example"],
    [None, None, "ID.AM-02: Inventories of software are kept"],
]


@pytest.mark.parametrize("inline", [True, False])
def test_cells_come_back(inline):
    rows = [["a", None, "ü & <b>"], [None, None, None], ["", " two\nlines ", "a"]]
    got = list(workbook.sheets(made([["x"]], rows, inline=inline)))
    assert got == [(1, 1, "A", "x")] + [(2, r, "ABC"[c], v) for r, row in enumerate(rows, 1) for c, v in enumerate(row) if v is not None]


def test_other_forms_of_cells():
    import io
    import zipfile

    old = made([["q"]])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(old)) as a, zipfile.ZipFile(out, "w") as z:
        for n in a.namelist():
            data = a.read(n)
            if n.endswith("sheet1.xml"):
                data = f'<worksheet {NAMES}><sheetData><row><c t="s"><v>0</v></c><c><v>3.5</v></c></row><row r="7"><c r="AB7" t="str"><f>A1</f><v>q</v></c><c r="AC7"/></row></sheetData></worksheet>'.encode()
            if n.endswith("sharedStrings.xml"):
                data = f"<sst {NAMES}><si><r><t>ri</t></r><r><rPr/><t>ch</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si></sst>".encode()
            z.writestr(n, data)
    assert list(workbook.sheets(out.getvalue())) == [(1, 1, "A", "rich"), (1, 1, "B", "3.5"), (1, 7, "AB", "q")]


def test_catalogue_of_a_workbook(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(made([["Introduction"]], ROWS))
    out = tmp_path / "c.json"
    with pytest.raises(workbook.WorkbookError, match="3 outcomes instead of 106"):
        workbook.build(spark, str(tmp_path / "w.xlsx"), str(out))
    assert not out.exists()
    assert workbook.build(spark, str(tmp_path / "w.xlsx"), str(out), expected=3) == 3
    found = json.loads(out.read_text())
    assert found["functions"] == [{"id": "GV", "name": "GOVERN"}, {"id": "ID", "name": "IDENTIFY"}]
    assert found["subcategories"][0] == {"function": "GOVERN", "category": "Organizational Context (GV.OC)", "id": "GV.OC-01", "outcome": "The mission is understood & informs <risk>"}
    rows = {r.id: r for r in catalogue.load(spark, str(out)).collect()}
    assert sorted(rows) == ["GV.OC-01", "ID.AM-01", "ID.AM-02"] and rows["ID.AM-01"].outcome == "Inventories of\nhardware are kept" and rows["ID.AM-02"].function_name == "IDENTIFY"
    assert workbook.build(spark, str(tmp_path / "w.xlsx"), str(out), categories=["GV.XX"], expected=None) == 1


def test_what_is_no_workbook(spark, tmp_path):
    for k, content in enumerate([b"text", made([["x"]])[:200]]):
        (tmp_path / f"{k}.xlsx").write_bytes(content)
        with pytest.raises(Exception, match="xlsx"):
            workbook.build(spark, str(tmp_path / f"{k}.xlsx"), str(tmp_path / "c.json"), expected=None)
    assert workbook.cells(spark.createDataFrame([], "path string, content binary")).count() == 0
