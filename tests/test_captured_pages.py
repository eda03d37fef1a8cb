"""Listings' own pages decoded and merged, and the stream of saved pages."""

from __future__ import annotations

import json

from lotlens.sources import pages as pg
from lotlens.streaming import capture as cp

DETAIL = """<html><title>Casas em São Paulo</title><meta name="description" content="520 mts de terreno"><h1>Casa &amp; quintal <b>na Vila</b> por R$ 770.000</h1><h1>no</h1>
<div class="x description-module__wrapper-description">Bela<br>casa <div>com <i>quintal</i></div> e <script>no()</script> pomar</div><div>not this</div>
<script>const mainFeatures =  {"CFT100":{"value":"111"},"CFT2":{"value":"3"},"CFT3":{"value":"x"},"A":1};
var g = {'pictures': [{"order": 2, "url1200x1200": "https://i/a/360x266/2.jpg?x"}, {"order": 1, "url730x532": "https://i/a/1.jpg"}, {"url730x532": "https://i/b/730x532/2.jpg"}, {"none": 1}], 'z': []}</script>"""


def test_a_detail_page(spark) -> None:
    pages = spark.createDataFrame([("u1", DETAIL), ("u2", None), ("u3", "<div class='description-module__wrapper-description'>open 90 m² de construção"), ("u4", "const mainFeatures = {broken 'pictures': [{")], "url string, html string")
    found = {r["url"]: r for r in pg.detail_pages(pages).collect()}
    one = found["u1"]
    assert (one["title"], one["description"]) == ("Casa & quintal na Vila", "Bela casa com quintal e pomar")
    assert (one["land"], one["built"], one["rooms"], one["baths"], one["parking"]) == (520.0, 111.0, 3, None, None)
    assert one["photos"] == ["https://i/a/1200x900/1.jpg", "https://i/a/1200x900/2.jpg"]
    assert (found["u2"]["description"], found["u2"]["photos"], found["u3"]["built"], found["u4"]["photos"]) == ("", [], 90.0, [])


def test_details_complete_what_is_stored(spark) -> None:
    stored = spark.createDataFrame([("http://x/1", "A longer title than that", "short", 5.0, 1.0, 2, None, None, True, ["a"]), ("http://x/2", None, None, None, None, None, None, None, None, None)], "url string, title string, description string, land double, built double, rooms int, baths int, parking int, financing boolean, photos array<string>")
    pages = spark.createDataFrame([("http://x/1?a=1", DETAIL), ("http://x/1#b", "<html>"), ("http://x/3", DETAIL)], "url string, html string")
    one, two = sorted(pg.merged_details(stored, pg.detail_pages(pages)).collect(), key=lambda r: r["url"])
    assert (one["title"], one["description"], one["land"], one["built"], one["rooms"], one["financing"], len(one["photos"])) == ("A longer title than that", "Bela casa com quintal e pomar", 520.0, 111.0, 3, True, 2)
    assert tuple(two)[1:] == (None,) * 9


def test_saved_pages_are_routed_once(spark, tmp_path) -> None:
    landing, target = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    cards = '<title>3 Casas em São Paulo</title><div data-to-posting="/p/1.html">x</div><div data-to-posting="/p/2.html">y</div>'
    save = lambda name, *rows: (landing / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(dict(zip(("url", "html", "saved_at"), r, strict=False))) for r in rows))
    rows = lambda kind: sorted((r.asDict() for r in spark.read.parquet(f"{target}/{kind}").collect()), key=str)
    save("a.json", ("http://x/1?q", DETAIL.replace("Bela", "Older"), "2024-01-01 00:00:00"), ("http://x/1", DETAIL, "2024-01-02 00:00:00"), ("http://x/l", cards), ("http://x/n", cards.replace("em São Paulo", "no Brasil")), ("http://x/o", None), "not JSON")
    cp.capture(spark, str(landing), str(target), site="http://x")
    assert [(r["url"], r["description"][:4]) for r in rows("details")] == [("http://x/1", "Bela")]
    assert sorted(r["url"] for r in rows("cards")) == ["http://x/p/1.html", "http://x/p/2.html"]
    assert sorted((r["url"] or "", r["kind"]) for r in rows("left")) == [("", "other"), ("http://x/n", "fallback"), ("http://x/o", "other")]
    save("b.json", ("http://x/2", DETAIL))
    cp.capture(spark, str(landing), str(target), site="http://x")
    cp.capture(spark, str(landing), str(target), site="http://x")
    assert sorted((r["url"], r["batch"]) for r in rows("details")) == [("http://x/1", 0), ("http://x/2", 1)] and len(rows("cards")) == 2


def test_cut_entities_of_titles_stay_as_they_are(spark, tmp_path) -> None:
    from lotlens.plans import QUERIES

    html = "<html><title>Casa &amp; jardim, 1 &lt 2 &amp</title></html>"
    spark.createDataFrame([(1, "https://x.org/1", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["detail_pages"](spark, str(tmp_path)).first()
    assert found["title"] == "Casa jardim, 1 &lt 2 &amp" and found["description"].startswith("Casa jardim, 1 &lt 2 &amp terreno de 151 m²")


def test_dashes_at_the_ends_of_titles_stay(spark, tmp_path) -> None:
    from lotlens.plans import QUERIES

    titles = ["Casa com quintal, +1 (907) 555-", "– Casa com quintal —", "--", "Casa", "", "Casa com quintal por R$ 5"]
    spark.createDataFrame([(k, f"https://x.org/{k}", f"<html><title>{t}</title></html>") for k, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["k"]: r["title"] for r in QUERIES["detail_pages"](spark, str(tmp_path)).collect()}
    assert found == {k: t if len(t) > 6 else f"Casa {k}" for k, t in enumerate(titles)}
    reader = pg.detail_pages(spark.createDataFrame([("u", "<h1>– Casa - por R$ 770.000</h1>")], "url string, html string"))
    assert reader.first()["title"] == "Casa"


def test_pages_without_html_are_those_of_the_sql(spark, tmp_path) -> None:
    import duckdb
    from lotlens.plans import QUERIES, SQL

    rows = [(k, f"https://x.org/{k}", None if k % 2 else f"<html><title>Casa com quintal {k}-</title></html>") for k in range(12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        wanted = db.execute(SQL["detail_pages"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["detail_pages"](spark, str(tmp_path)).collect()) == sorted(wanted)
