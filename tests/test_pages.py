"""Page extraction: one small page per layout."""

import json

from pyspark.sql import functions as F

from hearthline.operators import canonical, pages
from hearthline.schemas import LISTING_SCHEMA

OPTIONS_PAGE = """<html><head><style>.x{}</style></head><body>
<div class="product-title-h1"><h1 itemprop="name">Belle villa à vendre</h1><p>www.agency.com, Djerba - Midoun, Médenine</p></div>
<div class="product-price"><p>990 000 DT</p></div>
<div class="block-ref">Rèf: 142024 <time itemprop="datePublished" datetime="2022-01-01">1 jan</time></div>
<div class="slider-product"><img src="/upload/photos/1.jpg"><img src="/upload/photos/1.jpg"><img src="/logo.png"></div>
<div class="block-descr"><p itemprop="text">Grande maison<br/>Vue mer &amp; jardin<br> </p></div>
<div class="block-detail"><div class="block-over"><span>Chambres :</span><strong>4</strong></div>
<div class="block-over"><span>Surf habitable :</span><strong>150</strong></div></div>
<div class="span-opts"><strong>Garage fermé</strong><strong>Climatisation</strong></div>
<p>Tel 71 123 456</p><script>var phone = "22 222 222";</script></body></html>"""

BOXES_PAGE = """<html><body><span class="a favDivPickId" id="8124624"></span>
<div class="mainInfoProp"><h3 class="orangeTit">1,070,000 TND</h3></div>
<h3 class="greyTit">Sidi Daoued in La Marsa</h3>
<div class="blockProp"><h1 class="searchTitle">Flat for rent</h1><p>Nice place with balcony<br>Price 4,100 TND</p></div>
<div class="adDetails"><div class="adDetailFeature"><span>287 m²</span></div><div class="adDetailFeature"><span>3 Rooms</span></div>
<div class="adDetailFeature"><span>2 Bathrooms</span></div></div>
<div class="adMainFeature"><div class="adMainFeatureContent"><p class="adMainFeatureContentLabel">Type of property</p>
<p class="adMainFeatureContentValue">Apartment</p></div></div>
<div class="adFeatures"><div class="adFeature"><span>Garage</span></div><div class="adFeature"><span>Heating</span></div></div>
<div id="fl-8124624" pics="[{&quot;photo&quot;:{&quot;url&quot;:&quot;https://p/1.jpg&quot;}},{&quot;photo&quot;:null}]"></div></body></html>"""

ESTATE = {
    "id": 57418, "numeric_price": 0, "price": "400 000 €", "type": {"title": "Appartement"}, "province": {"title": "Bizerte"}, "city": {"title": "Menzel"},
    "data": [{"label": "Surface", "valore": "120 m²"}, {"label": "Pièces", "valore": "S+3"}], "features": {"floor": "2", "build_year": "2015"},
    "agency": {"name": "Agence X", "phone": "71 22", "whatsapp": "+216 11", "zip_code": "7000"},
    "media": {"images": [{"url": {"detail": "d1"}}, {"url": {"card": "c2"}}, {"url": {"detail": "d1"}}]},
    "description": "&lt;p&gt;Bel appartement avec balcons&lt;/p&gt;&lt;p&gt; &lt;/p&gt;", "last_published_at": "2022-01-01 00:00:00",
    "contract": {"slug": "louer"},
}


def _listing(spark, layout, html, url="https://s.tn/bizerte/57418.html"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    out = canonical.listings_from_pages(df, layout, "site")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in LISTING_SCHEMA]
    return out.first()


def test_options_page(spark):
    r = _listing(spark, "options", OPTIONS_PAGE)
    assert (r.id, r.price, r.currency, r.property_type, r.transaction_type) == ("142024", 990000.0, "TND", "Maison", "sale")
    assert (r.address, r.governorate, r.delegation, r.locality) == ("Djerba - Midoun, Médenine", "Médenine", "Djerba", "Midoun")
    assert (r.room_count, r.living_area, r.has_garage, r.air_conditioning, r.has_pool) == (4, 150.0, True, "true", None)
    assert r.description == ["Grande maison", "Vue mer & jardin"] and r.photos == ["/upload/photos/1.jpg"]
    assert r.phone == ["71 123 456"] and r.listing_date == 1640995200000


def test_boxes_page(spark):
    r = _listing(spark, "boxes", BOXES_PAGE)
    assert (r.id, r.price, r.currency, r.transaction_type, r.property_type) == ("8124624", 4100.0, "TND", "rent", "Apartment")
    assert (r.locality, r.delegation, r.living_area, r.room_count, r.bathroom_count) == ("Sidi Daoued", "La Marsa", 287.0, 3, 2)
    assert (r.has_garage, r.has_balcony, r.has_garden, r.heating) == (True, True, None, "true")
    assert r.photos == ["https://p/1.jpg"] and r.features == ["Garage", "Heating", "Type of property: Apartment"]


def test_estate_page(spark):
    attribute = json.dumps(ESTATE).replace("&", "&amp;").replace('"', "&quot;")
    r = _listing(spark, "estate", f'<html><bottom-menu :estate="{attribute}"></bottom-menu></html>')
    assert (r.id, r.price, r.currency, r.property_type, r.transaction_type) == ("57418", 400000.0, "EUR", "Appartement", "rent")
    assert (r.address, r.postal_code, r.room_count, r.floor, r.construction_year) == ("Menzel, Bizerte", "7000", 3, 2, 2015)
    assert r.description == ["Bel appartement avec balcons"] and r.has_balcony is True and r.has_pool is False
    assert r.phone == ["7122", "+21611"] and r.photos == ["d1", "c2"] and r.listing_date == 1640995200000


def test_estate_page_without_json(spark):
    html = '<html><div class="costs-container"><div class="row">Prix: 250 000 DT</div></div></html>'
    r = _listing(spark, "estate", html)
    assert (r.id, r.price, r.currency, r.transaction_type) == ("57418", 250000.0, "TND", "sale")


def test_selectors_and_nesting(spark):
    html = '<div class="a"><p>one <b>two</b></p><span data-x="1">s</span></div><p>three</p><div><p class="q r">four</p></div>'
    df = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    rules = [pages.Rule("nested", "div.a p"), pages.Rule("q", "p.q"), pages.Rule("all", "p"), pages.Rule("x", "[data-x]", "data-x"), pages.Rule("none", "div.z p")]
    got = {r.page_id: r.fields for r in pages.extract_fields(df, rules).collect()}
    assert got[1] == {"nested": ["one two"], "q": ["four"], "all": ["one two", "three", "four"], "x": ["1"]} and got[2] == {}


def test_reduce_and_links(spark):
    html = ('<head><meta name="Description" content="Nice &amp; big"><meta name="robots" content="x"></head><style>p{}</style>'
            '<img src="a.png"><img src="b.png"><img src="a.png"><p>Text</p><noscript>no</noscript><a href="/en/a/1#x">l</a><a href="/en/a/1">m</a><a href="">e</a>')
    df = spark.createDataFrame([(1, "https://h.tn/en/list", html)], "page_id long, url string, html string")
    reduced = pages.reduce_pages(df).first().reduced
    assert "Description: Nice & big" in reduced and "a.png\nb.png\n" in reduced and "robots" not in reduced and "no\n" not in reduced
    assert pages.reduce_pages(df, keep_chars=20).first().reduced == reduced[:20]
    assert [r.link for r in pages.page_links(df, "/en/a/").collect()] == ["https://h.tn/en/a/1"]


def test_every_page_is_read_by_its_provider_only(spark):
    rows = [(1, "https://one.tn/1", "<h3 class='greyTit'>x</h3>", "one"), (2, "https://two.tn/2", "<p>y</p>", "two"), (3, "https://else.tn/3", "<p>z</p>", "else"), (4, "https://no.tn/4", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, site string")
    out = canonical.listings_by_provider(pages, F.col("site"), {"one": "boxes", "two": "options"})
    assert sorted((r.url, r.source) for r in out.collect()) == [("https://else.tn/3", "else"), ("https://one.tn/1", "one"), ("https://two.tn/2", "two")]
    assert len(out.columns) == len(set(out.columns)) == 35
