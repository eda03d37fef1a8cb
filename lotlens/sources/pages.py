"""Listings from HTML pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import brazilian_number
from ..functions.rules import accepts_financing, built_area, canonical_url, land_area, sized_photo, usable_photo

_SKIP = {"script", "style", "nav", "template"}


class _Reader(HTMLParser):
    """Title, headings, paragraphs, links and images of a page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.open: list[str] = []
        self.texts: dict[str, list[str]] = {"title": [], "h1": [], "p": []}
        self.links: list[str] = []
        self.images: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = dict(attrs)
        if tag in _SKIP:
            self.depth += 1
        elif tag == "a" and found.get("href"):
            self.links.append(found["href"])
        elif tag == "img" and (found.get("src") or found.get("data-src")):
            self.images.append(found.get("data-src") or found["src"])
        if tag in self.texts:
            self.open.append(tag)
            self.texts[tag].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.depth = max(self.depth - 1, 0)
        elif tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.depth or "title" in self.open:
            for tag in dict.fromkeys(self.open):
                self.texts[tag][-1] += data


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def parse_page(html: str | None) -> dict:
    """A page without HTML gives empty fields."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    one = lambda tag: next((t for t in map(_squeezed, reader.texts[tag]) if t), "")
    paragraphs = [t for t in map(_squeezed, reader.texts["p"]) if t]
    return {"title": one("title"), "heading": one("h1"), "description": max(paragraphs, key=len, default=""), "paragraphs": len(paragraphs), "links": list(dict.fromkeys(reader.links)), "images": list(dict.fromkeys(reader.images))}


PAGE_SCHEMA = "title string, heading string, description string, paragraphs int, links array<string>, images array<string>"


def parsed_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns but the HTML, and what the page says. A parser has no column expression; it runs on Arrow batches."""

    def parse(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in frames:
            yield pd.DataFrame([parse_page(x) for x in s], columns=["title", "heading", "description", "paragraphs", "links", "images"])

    udf = F.pandas_udf(parse, PAGE_SCHEMA)
    return pages.withColumn("__page", udf(F.col(html))).drop(html).select("*", "__page.*").drop("__page")


# How a portal marks the cards of a page of listings, and their parts.
CARD_MARK, CARD_PART = 'data-to-posting="', r'data-qa="POSTING_CARD_{part}"[^>]*>(.*?)</div>'
CARD_PLACE = r'class="postingLocations-module__location-{part}"[^>]*>(.*?)</h\d>'
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def visible_text(html: Column) -> Column:
    """What a piece of HTML shows: no tags, common entities as characters, one space for each run of spaces."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, character in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def listing_cards(pages: DataFrame, html: str = "html", site: str = "") -> DataFrame:
    """Page columns, url, price, built, rooms, baths, parking, street, place, description, photos: the cards of pages of listings.

    Cards without an address go; what a card doesn't say is null, a text that it lacks empty. Photos are those that are no
    marks of the site, each once, in order.
    """
    keys = [c for c in pages.columns if c != html]
    cards = pages.select(*keys, F.posexplode(F.split(F.col(html), CARD_MARK)).alias("__at", "__card")).where("__at > 0")
    href = F.regexp_extract("__card", r'^([^"]*)"', 1)
    part = lambda pattern, name: visible_text(F.regexp_extract("__card", "(?s)" + pattern.replace("{part}", name), 1))
    features = part(CARD_PART, "FEATURES")
    number = lambda pattern: brazilian_number(F.nullif(F.regexp_extract(features, f"(?i){pattern}", 1), F.lit("")))
    images = F.regexp_extract_all("__card", F.lit(r'<img[^>]*?src="([^"]+)"'), F.lit(1))
    return cards.where(href != "").select(
        *keys, canonical_url(F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))).alias("url"), brazilian_number(F.nullif(part(CARD_PART, "PRICE"), F.lit(""))).alias("price"),
        number(r"(\d+(?:[.,]\d+)*)\s*m[²2]").alias("built"), number(r"(\d+)\s*quart").cast("int").alias("rooms"), number(r"(\d+)\s*ban").cast("int").alias("baths"), number(r"(\d+)\s*vaga").cast("int").alias("parking"),
        part(CARD_PLACE, "address").alias("street"), part(CARD_PLACE, "text").alias("place"), part(CARD_PART, "DESCRIPTION").alias("description"), F.array_distinct(F.filter(images, usable_photo)).alias("photos"),
    )


def page_kind(html: Column, detail: str, listing: str) -> Column:
    """Routes a stored page by what it holds."""
    return F.when(F.contains(html, F.lit(detail)), "detail").when(F.contains(html, F.lit(listing)), "listing").otherwise("other")


def embedded_array(html: str | None, name: str) -> str | None:
    """The JSON array behind ``name``, by counting brackets outside strings; null if it doesn't end."""
    start = (html or "").find(name)
    start = html.find("[", start) if start >= 0 else -1
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(html)):
        c = html[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 0:
                return html[start : i + 1]
    return None


# How a portal marks a listing's own page, and the codes of its features.
DETAIL_TEXT, DETAIL_PILLS = "description-module__wrapper-description", ("pill-item", "pills-module")
FEATURES_MARK, PICTURES_MARK, PICTURE_SIZES = "const mainFeatures = ", r"""['"]pictures['"]\s*:\s*\[""", "url1200x1200|resizeUrl1200x1200|url730x532|resizeUrl720x532"
BUILT_CODES, ROOMS_CODE, BATHS_CODE, PARKING_CODE, FINANCE_PILL = ("CFT100", "CFT101"), "CFT2", "CFT3", "CFT7", "melhor financiamento"
_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track"}


class _Detail(HTMLParser):
    """The texts of the elements that a listing's own page marks by class, its first heading and its description for searches."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.texts: dict[str, list[str]] = {"text": [], "pill": [], "h1": []}
        self.begun: set[str] = set()
        self.meta, self.hidden = "", 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = dict(attrs)
        if tag == "meta" and found.get("name") == "description" and not self.meta:
            self.meta = found.get("content") or ""
        if tag in _VOID:
            return
        marks = found.get("class") or ""
        kind = "text" if DETAIL_TEXT in marks else "pill" if any(p in marks for p in DETAIL_PILLS) else "h1" if tag == "h1" else ""
        if kind in ("text", "h1") and kind in self.begun:
            kind = ""  # only the first counts
        self.begun.add(kind)
        self.hidden += tag in ("script", "style")
        self.open.append((tag, kind))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                last, _ = self.open.pop()
                self.hidden -= last in ("script", "style")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for kind in {k for _, k in self.open if k}:
                self.texts[kind].append(data)


def page_features(html: str) -> dict[str, str]:
    """Values by code of the page's own object of features; empty if it isn't JSON."""
    at = html.find(FEATURES_MARK)
    try:
        found = json.JSONDecoder().raw_decode(html[at + len(FEATURES_MARK) :].lstrip())[0] if at >= 0 else {}
    except ValueError:
        return {}
    return {k: str(v["value"]) for k, v in found.items() if isinstance(v, dict) and v.get("value") is not None} if isinstance(found, dict) else {}


def page_pictures(html: str) -> list[str]:
    """The gallery in its own order, each file once; empty if its list doesn't end."""
    begin = re.search(PICTURES_MARK, html)
    block = embedded_array(html[begin.end() - 1 :], "[") if begin else None
    found: dict[str, tuple[int, str]] = {}
    for item in re.findall(r"\{[^{}]*\}", block or ""):
        url, order = re.search(rf'"(?:{PICTURE_SIZES})"\s*:\s*"([^"]+)"', item), re.search(r'"order"\s*:\s*(\d+)', item)
        if url:
            found.setdefault(url[1].split("?")[0].rsplit("/", 1)[-1], (int(order[1]) if order else len(found), url[1]))
    return [url for _, url in sorted(found.values(), key=lambda x: x[0])]


def parse_detail(html: str | None) -> dict:
    reader = _Detail()
    reader.feed(html or "")
    reader.close()
    text = {k: _squeezed(" ".join(v)) for k, v in reader.texts.items()}
    return {"description": text["text"], "heading": text["h1"], "meta": reader.meta, "pills": text["pill"], "features": page_features(html or ""), "pictures": page_pictures(html or "")}


DETAIL_SCHEMA = "description string, heading string, meta string, pills string, features map<string, string>, pictures array<string>"


def detail_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Page columns, title, description, land, built, rooms, baths, parking, financing, photos of listings' own pages.

    The parser runs on Arrow batches; what it finds is read by column expressions. Areas that the text states come before
    the features'; what a page doesn't say is null, a text that it lacks empty.
    """

    def parse(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in frames:
            yield pd.DataFrame([parse_detail(x) for x in s], columns=["description", "heading", "meta", "pills", "features", "pictures"])

    keys = [c for c in pages.columns if c != html]
    d = pages.select(*keys, F.pandas_udf(parse, DETAIL_SCHEMA)(F.col(html)).alias("__d")).select(*keys, "__d.*")
    feature = lambda code: F.replace(F.try_element_at("features", F.lit(code)), F.lit(","), F.lit(".")).try_cast("double")
    whole = lambda code: F.try_element_at("features", F.lit(code)).try_cast("double").cast("int")
    said = F.coalesce(*[F.nullif(feature(c), F.lit(0.0)) for c in BUILT_CODES])
    title = F.regexp_replace(F.regexp_replace("heading", r"\s+por\s+R\$\s*[\d.,]+\s*$", ""), r"^[ \-–—]+|[ \-–—]+$", "")
    return d.select(
        *keys, title.alias("title"), "description", F.coalesce(land_area(F.col("description")), land_area(F.col("meta"))).alias("land"), F.coalesce(built_area(F.col("description")), said).alias("built"),
        whole(ROOMS_CODE).alias("rooms"), whole(BATHS_CODE).alias("baths"), whole(PARKING_CODE).alias("parking"), accepts_financing(F.col("description"), F.contains(F.lower("pills"), F.lit(FINANCE_PILL))).alias("financing"), F.transform("pictures", lambda p: sized_photo(p)).alias("photos"),
    )


def merged_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Listings with what their own pages say: the longer title and description, the larger gallery, areas and numbers that the page has; financing that was known stays.

    Of several pages of an address the one with the longest description counts.
    """
    known = {"title": "", "description": "", "land": None, "built": None, "rooms": None, "baths": None, "parking": None, "financing": None, "photos": None}
    one = details.withColumn("__url", canonical_url(F.col("url"))).groupBy("__url").agg(F.max_by(F.struct(*known), F.struct(F.length("description"), F.col("url"))).alias("__d"))
    joined = listings.join(one, canonical_url(F.col("url")) == F.col("__url"), "left")
    new, own = (lambda c: F.col(f"__d.{c}")), F.col
    longer = {c: F.when(F.length(F.coalesce(new(c), F.lit(""))) > F.length(F.coalesce(own(c), F.lit(""))), new(c)).otherwise(own(c)) for c in ("title", "description")}
    size = lambda x: F.coalesce(F.size(x), F.lit(-1))
    larger = {"photos": F.when(F.greatest(size(new("photos")), F.lit(0)) > F.greatest(size(own("photos")), F.lit(0)), new("photos")).otherwise(own("photos"))}
    filled = {c: F.coalesce(new(c), own(c)) for c in ("land", "built", "rooms", "baths", "parking")}
    return joined.withColumns(longer | larger | filled | {"financing": F.when(own("financing"), True).otherwise(F.coalesce(new("financing"), own("financing")))}).select(*listings.columns)
