"""Workbooks, archives and series of prices from files made by hand."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lotlens.plans import QUERIES, books
from lotlens.plans.books import workbook
from lotlens.sources import files
from lotlens.sources import workbooks as wb

TITLES = {"value": "Valor de Transação (declarado pelo contribuinte)", "street": "Nome do Logradouro", "day": "Data de Transação"}
HEAD = ["Nome do Logradouro", "Valor de Transacao (declarado", "DATA DE TRANSAÇÃO"]
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def rows_of(spark, folder, **options):
    found = wb.workbook_rows(spark, f"file://{folder}", TITLES, "value", **options).collect()
    return sorted([(r["sheet"], r["value"], r["street"], r["day"]) for r in found], key=str)


def test_sheets_of_months_or_all_but_the_legend(spark, tmp_path) -> None:
    months = {"JAN-2026": [HEAD, ["Rua A", 5, ("date", 45292)], [None, None, None], ["Rua B", "x"]], "Legenda": [HEAD, ["no", 1, None]], "FEV-2026": [["other"], ["no"]], "MAR-2026": []}
    others = {"Plan1": [HEAD, ["Rua C", 7, None]], "Legenda de uso": [HEAD, ["no", 1, None]]}
    for name, sheets in (("a_2026", months), ("b_2006", others)):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook(sheets))
    found = rows_of(spark, tmp_path, sheets=wb.MONTH_SHEETS, not_sheets=wb.OTHER_SHEETS)
    assert found == [("JAN-2026", "5", "Rua A", "2024-01-01"), ("JAN-2026", "x", "Rua B", None), ("Plan1", "7", "Rua C", None)]


def test_cells_of_all_kinds(spark, tmp_path) -> None:
    """Places by reference, texts in runs or inline, own formats of dates, absolute targets, no shared texts."""
    sheet = f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="B1" t="inlineStr"><is><t>Nome do </t><t>Logradouro</t></is></c><c r="AA1" t="inlineStr"><is><t>Valor de Transação (declarado pelo contribuinte)</t></is></c><c r="C1" t="str"><v>Data de Transação</v></c></row>'
    sheet += '<row r="9"><c r="C9" s="1"><v>45292.75</v></c><c r="AA9"><v>1.5</v></c></row><row r="10"><c r="B10" t="s"><v>0</v></c><c r="C10" s="2"><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/worksheets/own.xml", sheet)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/own.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="[Red]0.00&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><r><t>Rua </t></r><r><t>D</t></r></si></sst>')
    assert rows_of(spark, tmp_path) == [("S", "1.5", None, "2024-01-01"), ("S", None, "Rua D", "3")]


def test_rows_beyond_a_batch(spark, tmp_path, monkeypatch) -> None:
    monkeypatch.setattr(wb, "BATCH", 7)
    (tmp_path / "x.xlsx").write_bytes(workbook({"S": [HEAD, *[[f"Rua {i}", i, None] for i in range(50)]]}))
    assert sorted(int(r[1]) for r in rows_of(spark, tmp_path)) == list(range(50))


def test_shared_texts_of_a_small_book_are_read_once(spark, tmp_path, monkeypatch) -> None:
    """Not once a sheet, as those of a large one."""
    (tmp_path / "x.xlsx").write_bytes(workbook({f"S{i}": [HEAD, [f"Rua {i}", i, None]] for i in range(5)}))
    shared, log = wb._shared, tmp_path / "log"

    def noted(book):
        with log.open("a") as f:
            f.write("x")
        return shared(book)

    monkeypatch.setattr(wb, "_shared", noted)
    for most, times in ((2_000_000, 1), (0, 6)):
        monkeypatch.setattr(wb, "SMALL_BOOK", most, raising=False)
        assert [r[1] for r in rows_of(spark, tmp_path / "x.xlsx")] == ["0", "1", "2", "3", "4"]
        assert len(log.read_text()) == times


def test_a_year_of_many_rows_has_several_books(spark, sf_dir, tmp_path, monkeypatch) -> None:
    """No task makes or holds more than one book's rows."""
    wanted = {(r["mes"], r["n"]) for r in QUERIES["workbook_sales"](spark, sf_dir).collect()}
    monkeypatch.setattr(books, "BOOK_ROWS", 300)
    monkeypatch.setattr(books, "shared_folder", lambda s: f"file://{tmp_path}")
    assert {(r["mes"], r["n"]) for r in QUERIES["workbook_sales"](spark, sf_dir).collect()} == wanted
    sheets = wb.workbook_rows(spark, f"file://{tmp_path}/books-*", wb.SALE_TITLES, "valor_transacao", wb.MONTH_SHEETS)
    by_book = [r["count"] for r in sheets.groupBy("path").count().collect()]
    assert len(by_book) > 7 and max(by_book) < 600 and sum(by_book) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


@pytest.mark.parametrize(("text", "wanted"), [("R$ 1.234.567,89", 1234567.89), ("1234.5", 1234.5), ("1.234", 1.234), ("12,5", 12.5), ("", None), ("x", None), (None, None)])
def test_numbers_of_cells(spark, text, wanted) -> None:
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(wb.workbook_number(df["t"])).first()[0] == wanted


def test_sales_of_homes_from_a_least_value_on(spark, tmp_path) -> None:
    titles = [wb.SALE_TITLES[c] for c in ("logradouro", "valor_transacao", "descricao_uso", "data_transacao", "cep")]
    body = [[" R  DR  SILVA ", "R$ 2.000,00", "RESIDÊNCIA", "05/01/2026", "1310100"], ["B", 999, "RESIDÊNCIA", None, None], ["C", 5000, "COMÉRCIO", None, None], ["D", None, "RESIDÊNCIA", None, None]]
    (tmp_path / "itbi_2026.xlsx").write_bytes(workbook({"JAN-2026": [titles, *body]}))
    (r,) = wb.workbook_sales(spark, f"file://{tmp_path}").collect()
    assert (r["logradouro"], r["valor_transacao"], r["data_transacao"], r["cep_norm"], r["ano_arquivo"], r["mes_arquivo"], r["numero"]) == ("R DR SILVA", 2000.0, "20260105", "01310100", 2026, "JAN-2026", "")
    assert wb.workbook_sales(spark, f"file://{tmp_path}", residential=False, least=0).count() == 3


def zipped(rows: list[dict], year: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("notes.txt", "x")
        z.writestr(f"u_{year}.CSV", "\n".join([";".join(wb.UNIT_TITLES.values()), *[";".join(str(r.get(c, "")) for c in wb.UNIT_TITLES) for r in rows]]))
    return out.getvalue()


def test_a_newer_register_replaces_the_older(spark, tmp_path) -> None:
    unit = {"sql": "1", "logradouro": '"R; X"', "numero": "0050", "area_terreno": "250", "v_m2_terreno": "1000", "testada": "10", "area_construida": "120", "v_m2_construcao": "2000", "fator_obsolescencia": "0,7", "tipo_terreno": "Lote de fundos", "padrao": "Residencial horizontal", "esquinas": "0"}
    years = {2025: [unit, unit | {"sql": "2"}], 2026: [unit, unit | {"sql": "3", "padrao": "Comercial"}, unit | {"sql": "4", "area_terreno": "0"}]}
    for year, rows in years.items():
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / f"IPTU_{year}.zip").write_bytes(zipped(rows, year))
        wb.store_register(wb.register_units(spark, f"file://{tmp_path}/{year}"), f"file://{tmp_path}/kept")
    (r,) = wb.current_register(spark, f"file://{tmp_path}/kept").collect()
    assert (r["sql"], r["ano"], r["logradouro"], r["numero"], r["venal_terreno"], r["venal_construcao"], r["ano_construcao"]) == ("1", 2026, "R; X", "50", 250 * 1000 * 0.6, 120 * 2000 * 0.7, None)
    wb.store_register(wb.register_units(spark, f"file://{tmp_path}/2025").where("sql = '2'"), f"file://{tmp_path}/kept")
    assert spark.read.parquet(f"{tmp_path}/kept").where("file_year = 2025").count() == 1


def test_an_index_without_values_falls_back(spark, tmp_path) -> None:
    (tmp_path / "i.json").write_text(json.dumps({"ipca": {"202401": 0.5, "202402": 0.25}, "igpm": {"202401": -1.0}, "none": {}}))
    series = files.index_series(spark, f"file://{tmp_path}/i.json")
    rows = lambda *names: sorted(tuple(r) for r in files.with_fallback(series, *names).collect())
    assert rows("igpm", "ipca") == [("202401", -1.0, "igpm")]
    assert rows("none", "ipca") == [("202401", 0.5, "ipca"), ("202402", 0.25, "ipca")] and rows("none", "nothing") == []
