"""Formulas and rules against tables of known values."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lotlens.functions import address as a
from lotlens.functions import geometry as g
from lotlens.functions import numbers as n
from lotlens.functions import rules as r
from lotlens.functions import scores as s


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("upkeep", "ratio", "problem", "confidence", "wanted"),
    [(5, 0.5, False, None, 1.0), (1, 1.0, False, None, 0.0), (None, 0.5, False, None, None), (3, None, False, None, None), (5, 0.5, True, None, 0.85), (1, 1.0, True, None, 0.0), (4, 0.35, False, "baixa", 0.625), (4, 0.35, False, "alta", 0.875)],
)
def test_fit_score(spark, upkeep, ratio, problem, confidence, wanted) -> None:
    got = value(spark, s.fit_score(F.lit(ratio).cast("double"), F.lit(upkeep).cast("int"), F.lit(problem), F.lit(confidence).cast("string")))
    assert got == wanted


@pytest.mark.parametrize(("land", "front", "corners", "wanted"), [(100, 10, 0, 0.7071), (110, 10, 0, 0.7416), (300, 10, 0, 1), (410, 10, 0, 0.9877), (800, 10, 0, 0.7071), (5000, 10, 0, 0.4472), (100, 10, 2, 1), (100, 0, 0, 1)])
def test_depth_factor(spark, land, front, corners, wanted) -> None:
    assert value(spark, s.depth_factor(F.lit(float(land)), F.lit(float(front)), F.lit(corners))) == pytest.approx(wanted, abs=1e-4)


@pytest.mark.parametrize(("listed", "built", "land", "wanted", "grade"), [(200, 60, 200, "terreno", "compativel"), (200, 200, 200, "ambos", "compativel"), (100, 100, 300, "construcao", "compativel"), (900, 100, 130, "nenhum", "divergente"), (None, 1, 1, "sem dado", "sem dado")])
def test_area_match(spark, listed, built, land, wanted, grade) -> None:
    three = [F.lit(x).cast("double") for x in (listed, built, land)]
    assert value(spark, s.area_match(*three)) == wanted
    assert value(spark, s.grade(s.area_difference(*three))) == grade


@pytest.mark.parametrize(
    ("street", "name", "key", "number"),
    [("Rua Estêvão Ribeiro, 142", "R ESTEVAO RIBEIRO", "ESTEVAO RIBEIRO", "142"), ("AV ALEXIOS JAFET", "AV ALEXIOS JAFET", "ALEXIOS JAFET", ""), ("R Dr José Elias 12A", "R DR JOSE ELIAS", "DOUTOR JOSE ELIAS", "12A"), ("Rua Duque de Caxias", "R DUQUE CAXIAS", "DUQUE CAXIAS", ""), (None, "", "", ""), ("Rua X, 0", "R X", "X", "")],
)
def test_streets(spark, street, name, key, number) -> None:
    c = F.lit(street).cast("string")
    assert value(spark, a.street_name(c)) == name
    assert value(spark, a.street_key(c, 2)) == key
    assert value(spark, a.house_number(c)) == number


def test_search_term_and_codes(spark) -> None:
    assert value(spark, a.search_term(F.lit("General Charles de Gaulle"))) == "CHARLES"
    assert value(spark, a.postal_code(F.lit("1234-567"))) == "01234567"
    assert value(spark, a.postal_code(F.lit("123"))) == ""
    assert value(spark, a.number_without_zeros(F.lit("0013"))) == "13"
    assert [value(spark, x) for x in (a.street_part(F.lit("Rua X, 335")), a.area_key(F.lit("Jardim-Íris")))] == ["Rua X", "JARDIM IRIS"]


def test_numbers(spark) -> None:
    assert value(spark, n.brazilian_number(F.lit("R$ 1.234,56"))) == 1234.56
    assert value(spark, n.brazilian_number(F.lit("1.234.567,89"))) == 1234567.89
    assert value(spark, n.brazilian_number(F.lit("sem"))) is None
    assert value(spark, n.lenient_number(F.lit("1,5"))) == 1.5
    assert [value(spark, n.any_date(F.lit(x))) for x in ("2020-01-31", "31/01/2020", "x")] == ["20200131", "20200131", None]
    assert value(spark, n.even_sample(F.array(*map(F.lit, range(10))), 4)) == [0, 3, 6, 9]
    assert value(spark, n.money(F.lit(1234567.4))) == "R$ 1.234.567"


@pytest.mark.parametrize(("title", "kind"), [("Apartamento em condomínio de casas", "apartamento"), ("Casa térrea na Vila Jaguara", "casa"), ("Vila", "incerto"), (None, "incerto")])
def test_kind(spark, title, kind) -> None:
    assert value(spark, r.kind_of_listing(F.lit(title).cast("string"))) == kind


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("Aceita permuta. Financiamento a combinar com o proprietário.", True), ("Simule seu financiamento aqui", None), ("Não aceita financiamento", False), ("Casa boa. Aceita. Financiamento direto.", True), ("Imóvel financiável", True), ("", None)],
)
def test_financing(spark, text, wanted) -> None:
    assert value(spark, r.accepts_financing(F.lit(text))) is wanted


@pytest.mark.parametrize(("text", "wanted"), [("terreno de 350m²", 350), ("um terreno generoso de 350 m2", 350), ("520 mts de terreno", 520), ("166, 32 m² de terreno", 166.32), ("lote de 300 m²", 300), ("10 metros de frente por 22 metros", 220), ("12 x 25 metros", 300), ("terreno de 5 m2", None)])
def test_land_area(spark, text, wanted) -> None:
    assert value(spark, r.land_area(F.lit(text))) == (None if wanted is None else pytest.approx(wanted))


def test_places(spark) -> None:
    agree = lambda x, y: value(spark, r.area_agrees(F.lit(x), F.lit(y)))
    assert agree("Parque São Domingos", "parque-sao-domingo") and agree("Vila Mangalot", "Mangalot") and not agree("Jardim Gonzaga", "Vila Jaguara")
    assert value(spark, r.in_city(F.lit("Pirituba, São Paulo"))) and not value(spark, r.in_city(F.lit("Centro, Campinas")))
    assert [value(spark, r.in_city(F.lit(x))) for x in ("Sé, SAO PAULO - SP", "Sé, São Paulo/SP", "Grande São Paulo", "", "Osasco")] == [True, True, False, True, False]
    order = lambda x, *city: value(spark, r.address_order(F.lit(x), *city))
    assert [order(x) for x in ("São Paulo, Pirituba", "SÃO PAULO - SP,  Vila A, Bloco B", "Centro, Osasco", "Zona Norte", "", "São Paulo,")] == ["Pirituba, São Paulo", "Vila A, Bloco B, SÃO PAULO - SP", "Centro, Osasco", "Zona Norte", "", "São Paulo,"]
    assert [order(x, "São Paulo") for x in ("Zona Norte", "", "Centro, Osasco", "a,b")] == ["Zona Norte, São Paulo", "São Paulo", "Centro, Osasco", "a,b, São Paulo"]
    assert value(spark, r.canonical_url(F.lit("http://x/a?b=1#c"))) == "http://x/a"


def test_vision_answers(spark) -> None:
    assert [value(spark, r.tri_state(F.lit(x))) for x in ("sim", "Não", "incerto", " S ", "yes", "n", "no", "sim!", "")] == [True, False, None, True, True, False, False, None, None]
    assert [value(spark, r.number_certainty(F.lit(n), F.lit(c))) for n, c in (("7", "Alta"), ("7", " média "), ("7", None), ("7", "?"), ("x", "alta"))] == ["alta", "media", "baixa", "baixa", ""]
    assert [value(spark, r.answer_list(F.parse_json(F.lit(x)))) for x in ('["Mofo ", "", "Umidade"]', '"trinca, MOFO,,"', "3", '{"a": 1}', "null")] == [["mofo", "umidade"], ["trinca", "mofo"], [], [], []]
    assert [value(spark, r.upkeep_grade(F.lit(x))) for x in ("7", "-1", "3.6", "x")] == [5, 0, 4, None]
    assert [value(spark, r.seen_number(F.lit(x))) for x in ("335", "12a", "0", "nenhum", "12345678", "007", "12 A", " 5b ", "000", "1AB")] == ["335", "12A", "", "", "", "7", "12A", "5B", "", ""]
    assert value(spark, r.json_object(F.lit('x ```json {"a": 1} ```')).cast("string")) == '{"a":1}'


def test_values_as_pages_show_them(spark) -> None:
    number = lambda f, *xs: [value(spark, f(F.lit(x).cast("double"))) for x in xs]
    assert number(n.price_text, 1712300.4, None) == ["R$ 1.712.300", "Preço a consultar"]
    assert number(n.short_money, 1712300, 480000, 95, 1234e6, None) == ["R$ 1,71 mi", "R$ 480 mil", "R$ 95", "R$ 1234,00 mi", "—"]
    assert number(n.area_text, 1250.4, None) == ["1.250 m²", "?"] and number(n.number_text, 1250, 1250.25, -3, None) == ["1.250", "1.250,2", "-3", "?"]
    assert [value(spark, n.register_text(F.lit(x))) for x in ("12345678901", "123.456.7890-1", "123", None)] == ["123.456.7890-1", "123.456.7890-1", "123", ""]


def test_addresses_of_pages_and_photos(spark) -> None:
    title = lambda x: value(spark, r.title_from_url(F.lit(x)))
    assert title("https://x.org/propriedades/casa-3-quartos-a-venda-122-m-3000246816.html?n=1") == "Casa 3 quartos a venda 122 m" and title("https://x.org/v/loja-12/") == ""
    assert title("https://x.org/propriedades/SOBRADO_no-centro-a-1234567.html#p") == "Sobrado no centro"
    assert [value(spark, r.usable_photo(F.lit(x))) for x in ("http://i.org/silicone.jpg", "https://i.org/placeholder.png", "https://i.org/right-arrow.png", "https://i.org/a.SVG", "//i.org/a.jpg", "https://i.org/LOGO.jpg")] == [True, False, False, False, False, False]
    url = "https://www.example.org/propriedades/casa-com-quintal-e-edicula-na-vila-3000246816.html"
    assert value(spark, n.folder_slug(F.lit(url))) == re.sub(r"[^a-zA-Z0-9]+", "_", url)[-60:] + "_" + hashlib.md5(url.encode()).hexdigest()[:8]
    assert value(spark, n.folder_slug(F.lit("a b"))) == "a_b_" + hashlib.md5(b"a b").hexdigest()[:8]


def test_geometry(spark) -> None:
    ring = lambda *p: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    square, hole = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))
    inside = lambda lat, lon: value(spark, g.in_polygon(F.lit(float(lat)), F.lit(float(lon)), F.array(square, hole)))
    assert inside(2, 2) and not inside(5, 5) and not inside(12, 2)
    assert value(spark, g.distance(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0))) == pytest.approx(110.54)
    assert value(spark, g.line_distance(F.lit(0.001), F.lit(0.5), ring((0, 0), (1, 0)))) == pytest.approx(110.54)
    c = value(spark, g.centroid(square))
    assert (c["lon"], c["lat"]) == (pytest.approx(5), pytest.approx(5))


def test_peak_hours(spark) -> None:
    at = lambda t: value(spark, s.peak(F.lit(t).cast("timestamp")))
    assert at("2024-01-01 01:00:00") and at("2024-01-05 09:59:00") and not at("2024-01-01 04:00:00") and not at("2024-01-06 02:00:00")
