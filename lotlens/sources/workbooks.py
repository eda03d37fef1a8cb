"""Sheets of workbooks and members of archives: files that only a stream can be read from, a task for each sheet or archive.

Spark lists and reads the files (``binaryFile``). Of a workbook, every sheet whose name fits goes to a task of its own, which
reads the sheet's XML as a stream and holds the table of shared texts and one batch of rows; columns are found by the titles
in the sheet's own head row. The sheets of a small workbook stay together, so that it is sent, and its shared texts are read,
once. Of an archive, a task unpacks the members as a stream.
"""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as s
from ..functions.address import number_without_zeros, postal_code, street_key, unaccent
from ..functions.numbers import any_date

BATCH = 5_000
#: Bytes of a workbook above which its sheets are read apart.
SMALL_BOOK = 2_000_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_CELL, _VALUE = f"{_MAIN}c", f"{_MAIN}v"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates.
_DATES = {*range(14, 23), *range(45, 48)}
# Titles of a sale's columns, of which the first characters must agree, and the sheets of months.
SALE_TITLES = {
    "sql_cadastro": "Nº do Cadastro (SQL)", "logradouro": "Nome do Logradouro", "numero": "Número", "complemento": "Complemento", "bairro": "Bairro", "cep": "CEP", "natureza": "Natureza de Transação",
    "valor_transacao": "Valor de Transação (declarado pelo contribuinte)", "data_transacao": "Data de Transação", "valor_venal": "Valor Venal de Referência", "proporcao": "Proporção Transmitida (%)", "valor_base": "Base de Cálculo adotada",
    "financiamento": "Tipo de Financiamento", "valor_financiado": "Valor Financiado", "area_terreno": "Área do Terreno (m2)", "area_construida": "Área Construída (m2)", "uso": "Uso (IPTU)", "descricao_uso": "Descrição do uso (IPTU)",
    "padrao": "Padrão (IPTU)", "descricao_padrao": "Descrição do padrão (IPTU)", "acc": "ACC (IPTU)",
}
MONTH_SHEETS, OTHER_SHEETS = r"(?i)^[A-Z]{3}-\d{4}$", r"legenda|tabela|explica"
PREFIX = 26
# Titles of the register of units, and what its houses' pattern begins with.
UNIT_TITLES = {
    "sql": "NUMERO DO CONTRIBUINTE", "ano": "ANO DO EXERCICIO", "logradouro": "NOME DE LOGRADOURO DO IMOVEL", "numero": "NUMERO DO IMOVEL", "cep": "CEP DO IMOVEL", "area_terreno": "AREA DO TERRENO", "area_construida": "AREA CONSTRUIDA",
    "v_m2_terreno": "VALOR DO M2 DO TERRENO", "v_m2_construcao": "VALOR DO M2 DE CONSTRUCAO", "testada": "TESTADA PARA CALCULO", "tipo_terreno": "TIPO DE TERRENO", "esquinas": "QUANTIDADE DE ESQUINAS/FRENTES", "fracao_ideal": "FRACAO IDEAL",
    "fator_obsolescencia": "FATOR DE OBSOLESCENCIA", "ano_construcao": "ANO DA CONSTRUCAO CORRIGIDO", "pavimentos": "QUANTIDADE DE PAVIMENTOS", "padrao": "TIPO DE PADRAO DA CONSTRUCAO", "uso": "TIPO DE USO DO IMOVEL",
}
HOUSES = "Residencial horizontal"


def title_key(title: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text).strip().lower()


def columns_of(head: list[str | None], titles: dict[str, str]) -> dict[str, int]:
    """The place of each title in a head row: an equal one, else the first that begins alike."""
    places = {title_key(t): i for i, t in reversed(list(enumerate(head))) if t}
    out = {}
    for name, title in titles.items():
        key = title_key(title)
        found = places[key] if key in places else next((i for k, i in sorted(places.items(), key=lambda x: x[1]) if k.startswith(key[:PREFIX])), None)
        if found is not None:
            out[name] = found
    return out


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of sheets and the members that hold them."""
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    return {x.get("name", ""): (t if (t := links[x.get(_LINK)]).startswith("xl/") else f"xl/{t.removeprefix('/xl/').removeprefix('/')}") for x in sheets}


def _streamed(book: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a member, one at a time; those that were given are let go."""
    with book.open(member) as f:
        root = None
        for event, x in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = x
            if event == "end" and x.tag == f"{_MAIN}{tag}":
                yield x
                x.clear()
                root.clear()


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in _streamed(book, "xl/sharedStrings.xml", "si")]


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """The styles, by their number, that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    formats = [x.get("numFmtId", "0") for xfs in root.iter(f"{_MAIN}cellXfs") for x in xfs]
    return {str(i) for i, f in enumerate(formats) if int(f) in _DATES or re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(f, "")).lower())}


def _place(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(book: zipfile.ZipFile, member: str, shared: list[str], dates: set[str]) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts: numbers as they are written, dates as yyyy-mm-dd. shared, dates: the book's."""
    for row in _streamed(book, member, "row"):
        cells: list[str | None] = []
        for c in row.iterfind(_CELL):
            at = _place(r) if (r := c.get("r")) else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, value = c.get("t", "n"), c.findtext(_VALUE)
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif value is not None:
                cells[at] = shared[int(value)] if kind == "s" else (date(1899, 12, 30) + timedelta(days=float(value))).isoformat() if kind == "n" and c.get("s", "") in dates else value
        yield cells


def _titled(rows: Iterator[list[str | None]], titles: dict[str, str], needed: str) -> Iterator[list[str | None]]:
    """The titled columns of the rows behind the head row, which is the first; nothing if the needed column isn't there."""
    places = columns_of(next(rows, []), titles)
    if needed in places:
        order = [places.get(name, -1) for name in titles]
        for cells in rows:
            if any(x is not None for x in cells):
                size = len(cells)
                yield [cells[i] if 0 <= i < size else None for i in order]


def _batches(fixed: dict[str, str], rows: Iterator[list[str | None]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[list[str | None]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([v] * len(held), pa.string()) for v in fixed.values()] + [pa.array([r[i] for r in held], pa.string()) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, [*fixed, *names])

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def workbook_rows(spark: SparkSession, path: str, titles: dict[str, str], needed: str, sheets: str = ".*", not_sheets: str = "(?!)") -> DataFrame:
    """path, sheet and the titled columns, as text, of all sheets whose name fits; in a book without such, of those whose name isn't one of ``not_sheets``.
    A column that a sheet lacks is null; a sheet without the needed one has no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = content.as_py()
                with zipfile.ZipFile(io.BytesIO(raw)) as book:
                    every = _sheets(book).items()
                    found = [x for x in every if re.search(sheets, x[0])] or [x for x in every if not re.search(not_sheets, title_key(x[0]))]
                for together in [found] if found and len(raw) <= SMALL_BOOK else [[x] for x in found]:
                    names, members = map(list, zip(*together, strict=True))
                    yield pa.RecordBatch.from_pydict({"path": [file], "sheets": [names], "members": [members], "content": [raw]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, names, members, raw = (b.column(c)[i].as_py() for c in ("path", "sheets", "members", "content"))
                with zipfile.ZipFile(io.BytesIO(raw)) as book:
                    shared, dates = _shared(book), _date_styles(book)
                    for name, member in zip(names, members, strict=True):
                        yield from _batches({"path": file, "sheet": name}, _titled(sheet_rows(book, member, shared, dates), titles, needed), list(titles))

    each = files.mapInArrow(listed, "path string, sheets array<string>, members array<string>, content binary").repartition("path", "sheets")
    return each.mapInArrow(read, "path string, sheet string, " + ", ".join(f"{n} string" for n in titles))


def workbook_number(text: Column) -> Column:
    """A cell's number: with a comma, points part thousands; null where there is none."""
    bare = F.regexp_replace(F.replace(text, F.lit("R$"), F.lit("")), r"\s+", "")
    return F.when(F.contains(bare, F.lit(",")), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare).try_cast("double")


def workbook_sales(spark: SparkSession, path: str, residential: bool = True, least: float = 1000.0) -> DataFrame:
    """The sales of all months' sheets: numbers and dates (yyyymmdd) decoded, the file's year, the sheet's name, the street's key and postal code.
    Sales below ``least`` or without a value go, and those of other uses."""
    rows = workbook_rows(spark, path, SALE_TITLES, "valor_transacao", MONTH_SHEETS, OTHER_SHEETS)
    numbers = ["valor_transacao", "valor_venal", "proporcao", "valor_base", "valor_financiado", "area_terreno", "area_construida"]
    texts = {c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ") for c in SALE_TITLES if c not in numbers and c != "data_transacao"}
    decoded = rows.withColumns(texts | {c: workbook_number(F.col(c)) for c in numbers} | {"data_transacao": any_date(F.col("data_transacao"))})
    kept = decoded.where(F.col("valor_transacao") >= least)
    if residential:
        kept = kept.where(F.lower(unaccent(F.col("descricao_uso"))).startswith("resid"))
    return kept.withColumns({"ano_arquivo": F.regexp_extract("path", r"(\d{4})[^/]*$", 1).try_cast("int"), "mes_arquivo": F.col("sheet"), "rua_chave": street_key(F.col("logradouro"), 1), "cep_norm": postal_code(F.col("cep"))}).drop("path", "sheet")


# The register of units.

def archived_rows(spark: SparkSession, path: str, titles: dict[str, str], needed: str, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """path, member and the titled columns, as text, of all CSV members of archives."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in [m for m in archive.namelist() if m.lower().endswith(".csv")]:
                        with archive.open(member) as f:
                            lines = csv.reader(io.TextIOWrapper(f, encoding, errors="replace", newline=""), delimiter=sep)
                            yield from _batches({"path": file, "member": member}, _titled(lines, titles, needed), list(titles))

    return files.mapInArrow(read, "path string, member string, " + ", ".join(f"{n} string" for n in titles))


def register_units(spark: SparkSession, path: str, tasks: int = 8) -> DataFrame:
    """The houses of registers named ..._yyyy.zip, with the statutory values of land and building. Units without land or its price go."""
    number = lambda c: F.coalesce(F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    whole = lambda c: F.nullif(number(c).cast("int"), F.lit(0))
    rows = archived_rows(spark, path, UNIT_TITLES, "padrao").repartition(tasks).where(F.col("padrao").startswith(HOUSES))
    sized = rows.withColumns({c: number(c) for c in ("area_terreno", "area_construida", "v_m2_terreno", "v_m2_construcao", "testada")}).where("area_terreno > 0 and v_m2_terreno > 0")
    one = lambda c: F.coalesce(F.nullif(number(c), F.lit(0.0)), F.lit(1.0))
    file_year = F.coalesce(F.regexp_extract("path", r"_(\d{4})\.[^.]*$", 1).try_cast("int"), F.lit(0))
    known = sized.select(
        "sql", F.coalesce(whole("ano"), file_year).alias("ano"), F.trim(F.coalesce("logradouro", F.lit(""))).alias("logradouro"), number_without_zeros(F.col("numero")).alias("numero"), postal_code(F.col("cep")).alias("cep"),
        "area_terreno", "area_construida", "v_m2_terreno", "v_m2_construcao", "testada", F.trim(F.coalesce(F.nullif("tipo_terreno", F.lit("")), F.lit("Normal"))).alias("tipo_terreno"), number("esquinas").cast("int").alias("esquinas"),
        one("fracao_ideal").alias("fracao_ideal"), one("fator_obsolescencia").alias("fator_obsolescencia"), whole("ano_construcao").alias("ano_construcao"), whole("pavimentos").alias("pavimentos"), "padrao", "uso", file_year.alias("file_year"),
    )
    land = s.statutory_land_value(F.col("area_terreno"), F.col("v_m2_terreno"), F.col("testada"), F.col("esquinas"), F.col("tipo_terreno"), F.col("fracao_ideal"))
    building = s.statutory_building_value(F.col("area_construida"), F.col("v_m2_construcao"), F.col("fator_obsolescencia"))
    return known.withColumns({"rua_chave": street_key(F.col("logradouro"), 2), "venal_terreno": F.round(land, 2), "venal_construcao": F.round(building, 2)})


def store_register(units: DataFrame, path: str) -> None:
    """Writes each file's year as a partition, in place of what it held; other years stay until ``current_register`` no longer reads them."""
    units.write.partitionBy("file_year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def current_register(spark: SparkSession, path: str) -> DataFrame:
    """The units of the newest year alone: a year's register has every unit."""
    stored = spark.read.parquet(path)
    newest = stored.select("file_year").distinct().agg(F.max("file_year").alias("y")).first()["y"]
    return stored.where(F.col("file_year") == newest)
