"""Golden rows of the column functions."""

from pyspark.sql import functions as F
import pytest

from hearthline.functions import dates, jsontext, labels, money, numbers, place, scores, text, urls

X = F.col("x")


def test_clean_text(eval_column):
    assert eval_column(text.clean_text(X), ["  a  b\n", " ", None]) == ["a b", None, None]


def test_price_and_currency(eval_column):
    got = eval_column(money.price_and_currency(X), ["990 000 DT", "320,000 TND", "1 200 000 Dinars", "250.000 DT", "DT 250,000", "1.200.000 DT", "sur demande", None])
    assert [tuple(r) for r in got] == [(990000, "TND"), (320000, "TND"), (1200000, "TND"), (250, "TND"), (250000, "TND"), (None, "TND"), (None, None), (None, None)]


def test_description_price(eval_column):
    got = eval_column(money.description_price(X), ["Rent. Price 4,100 TND", "price: 900", "free"])
    assert [tuple(r) for r in got] == [(4100, "TND"), (900, None), (None, None)]


def test_text_price(eval_column):
    got = eval_column(money.text_price(X), ["Prix: 400 000 DT", "250000 €", "1500 eur", "12"])
    assert [tuple(r) for r in got] == [(400000, "TND"), (250000, "EUR"), (1500, "EUR"), (None, "TND")]


def test_clean_price(eval_column):
    values = ["nan", "", "none", "9999", "50000001", "250,000", "1 200 000", "10000", "50000000", "abc", None, "NaN", "inf", "5d"]
    assert eval_column(numbers.clean_price(X), values) == [None] * 5 + [250000.0, 1200000.0, 10000.0, 50000000.0, None, None, None, None, None]


def test_safe_numbers(eval_column):
    assert eval_column(numbers.safe_float(X), ["12.5", "nan", "", None, "x", "-3"]) == [12.5, 0.0, 0.0, 0.0, 0.0, -3.0]
    assert eval_column(numbers.safe_int(X), ["12.9", "nan", None, "-3.7"]) == [12, 0, 0, -3]


def test_digits(eval_column):
    assert eval_column(numbers.digits_to_int(X), ["150 m2", "120.5", "none"]) == [1502, 1205, None]
    assert eval_column(numbers.decimal_to_int(X), ["4,100.7 TND", "1.2.3", ""]) == [4100, None, None]
    assert eval_column(numbers.first_number(X), ["150 m2", "a 12.5", "x"]) == [150.0, 12.5, None]


def test_address(eval_column):
    got = eval_column(place.split_address(X), ["www.visavis-immobilier.com, Djerba - Midoun, Médenine", "Tunis", None])
    assert tuple(got[0]) == ("Djerba - Midoun, Médenine", "Médenine", "Djerba", "Midoun")
    assert tuple(got[1]) == ("Tunis", "Tunis", None, None)
    assert tuple(got[2]) == (None, "nan", None, None)


def test_place_phrase(eval_column):
    got = eval_column(place.split_in_phrase(X), ["Sidi Daoued in La Marsa", "La Marsa"])
    assert [tuple(r) for r in got] == [("Sidi Daoued, La Marsa", "La Marsa", "Sidi Daoued"), (None, None, None)]


def test_governorate(eval_column):
    assert eval_column(place.standard_governorate(X), [None, "", "Grand Tunis", "kef", "cap bon", "ben-arous o'neil"]) == [
        "Unknown", "Unknown", "Tunis", "Le Kef", "Cap Bon", "Ben-Arous O'Neil"]


@pytest.mark.parametrize("raw, want", [
    ('{"test": "value", "number": 123}', '{"test": "value", "number": 123}'),
    ('```json\n{"test": "value"}\n```', '{"test": "value"}'),
    ('Here is {"property_type": "Villa", "room_count": 3} and more', '{"property_type": "Villa", "room_count": 3}'),
    ('{"address": {"city": "Tunis"}, "features": {"pool": {"heated": true}}}', '{"address": {"city": "Tunis"}, "features": {"pool": {"heated": true}}}'),
    ('deep {"a":{"b":{"c":{"d":{"e":1}}}}} end', '{"a":{"b":{"c":{"d":{"e":1}}}}}'),
    ('stray { then {"a": 1}', '{"a": 1}'),
    ('{"test": "value", "missing_quote: 123}', None),
    ("This is just text without JSON", None),
    ("list [1, [2]] only", "[1, [2]]"),
    (None, None),
    ('Use {placeholder} then {"a": 1}', '{"a": 1}'),
    ('{"a":1,} then {"b":2}', '{"b":2}'),
    ('{no {"a":{"b":{"c":{"d":1}}}} } and {"e":{"f":{"g":{"h":2}}}}', '{"e":{"f":{"g":{"h":2}}}}'),
])
def test_json_in_text(eval_column, raw, want):
    assert eval_column(jsontext.json_in_text(X), [raw]) == [want]


def test_urls(eval_column):
    assert eval_column(urls.normalize_strict(X), ["HTTP://www.Site.tn/annonce/x/?a=1#f"]) == ["https://www.site.tn/annonce/x"]
    assert eval_column(urls.normalize_keep_query(X), ["HTTP://www.Site.tn/en/a/1/?a=1#f"]) == ["http://www.site.tn/en/a/1?a=1"]
    base = F.lit("https://h.tn/en/list?p=2")
    assert eval_column(urls.normalize_keep_query(X, base), ["/en/a/1", "x/2", "//c.tn/y/", "?p=3", ""]) == [
        "https://h.tn/en/a/1", "https://h.tn/en/x/2", "https://c.tn/y", "https://h.tn/en/list?p=3", None]
    assert eval_column(urls.set_query_param(X, "page", F.lit(3)), ["h?a=1&page=2&b=2#z", "h", "h?page=1&page=2"]) == [
        "h?a=1&page=3&b=2#z", "h?page=3", "h?page=3"]
    assert eval_column(urls.listing_id(X), ["https://x/bizerte/57418.html", "https://x/y"]) == ["57418", None]
    assert eval_column(urls.with_scheme(X), [" www.a.tn ", "http://b"]) == ["https://www.a.tn", "http://b"]


def test_dates(eval_column):
    assert eval_column(dates.epoch_ms(X), ["2022-01-01", "2022-01-01 00:00:00", "2022-01-01T00:00:00Z", "2022-01-01T00:00:00+01:00", "soon"]) == [1640995200000] * 4 + [None]
    assert eval_column(dates.display_date(X), [1640995200000], "long") == ["January 01, 2022"]


def test_types(eval_column):
    assert eval_column(labels.property_type(X), ["Belle Villa et terrain", "terrain nu", "duplex", "château"]) == ["Maison", "Terrain", "Duplex", None]
    assert eval_column(labels.transaction_type(X, "options"), ["Villa à louer ou a vendre", "à louer", "x"]) == ["sale", "rent", None]
    assert eval_column(labels.transaction_type(X, "boxes"), ["Flat for rent or for sale", "for  sale"]) == ["rent", "sale"]


def test_pool_alternation_keeps_one_sided_bounds(eval_column):
    flag = labels.label_or_text_flag(F.array().cast("array<string>"), ["Pool"], X, r"\bpool|piscine\b")
    assert eval_column(flag, ["poolside", "minipiscine", "piscines", "carpool"]) == [True, True, None, None]


def test_phones(eval_column):
    assert eval_column(text.phones(X), ["call 71 123 456 or +216 98 765 432, 71 123 456"]) == [["+216 98 765 432", "71 123 456"]]
    fields = text.phones_from_fields(X, F.lit("+216 11"), F.lit(None).cast("string"), X)
    assert eval_column(fields, ["71 22"]) == [["7122", "+21611"]]


def test_tiers_and_segments(eval_column):
    assert eval_column(scores.tier_by_area(X), [79.0, 80.0, 120.0, 200.0], "double") == ["Basic", "Standard", "Premium", "Economy"]
    assert eval_column(scores.market_segment(X), [99999.0, 100000.0, 200000.0, 400000.0, 800000.0], "double") == ["Budget", "Entry-Level", "Mid-Market", "Upper-Mid", "Luxury"]
    assert eval_column(scores.market_segment(X, "serve"), [199999.0, 200000.0, 400000.0, 800000.0, 1500000.0, 0.0], "double") == [
        "Budget", "Entry-Level", "Mid-Market", "Upper-Mid", "Luxury", "Mid-Market"]


def test_fallback_and_gap(eval_column):
    got = eval_column(scores.fallback_prediction(X, F.lit(None).cast("string")), [100000.0, 0.0], "double")
    assert (got[0]["predicted_price"], got[0]["price_range"]["min"], got[0]["price_range"]["max"], got[0]["confidence"]) == (95000, 85500, 104500, 0.65)
    assert (got[1]["predicted_price"], got[1]["price_range"]["min"], got[1]["price_range"]["max"]) == (450000, 400000, 500000)
    assert eval_column(scores.price_gap(F.lit(275000.0), X), [250000.0, 275000.0, 300000.0], "double")[0]["gap_text"] == "+10.0% above market"


def test_hash_and_metrics(eval_column):
    h = eval_column(text.description_hash(X), ["A  b", "a b", "", None, "   "])
    assert h[0] == h[1] and len(h[0]) == 16 and h[2:] == ["", "", ""]
    assert eval_column(text.word_count(text.clean_text(X)), ["a bb  ccc ", "", None]) == [3, 0, 0]
    assert eval_column(text.avg_word_length(text.clean_text(X)), ["a bb  ccc ", ""]) == [2.0, 0.0]
    assert eval_column(text.fix_description(X), ["Ã©tage â\x80\x93 Â", None]) == ["étage - â", ""]
    assert eval_column(text.to_text_array(X), ['["a","b"]', "plain", None]) == [["a", "b"], ["plain"], None]
    assert eval_column(text.is_empty(X), ["NaN ", "n/a", "x", None, ""]) == [True, True, False, True, True]
    assert eval_column(text.paragraphs(X), ["<p>one <b>x</b></p><p> </p><p>two</p>"]) == [["one x", "two"]]
    assert eval_column(text.preview(X, 3), ["abcd", "abc"]) == ["abc...", "abc"]


def test_dates_of_other_shapes(eval_column):
    got = eval_column(dates.epoch_ms(X), ["2022-01-01", "2022-01-01T10:00:00.123", "20220101", "2022-01-01 10:00", "2022-01-01T10:00:00+01:00", "2022-01-01T10:00:00Z", "20220101T100000", "x", None, "2022-13-01"])
    day, ten = 1640995200000, 1641031200000
    assert got == [day, ten + 123, day, ten, ten, ten, ten, None, None, None]


def test_label_flags_and_measures_of_odd_spellings(eval_column):
    assert eval_column(labels.label_flag(F.array(X), ["Meublé", "a+b"]), ["MEUBLÉ", "x A+B", "aab", None]) == [True, True, None, None]
    assert eval_column(labels.measure(F.array(X), "m²"), ["1,200 m²", "1 287 m²", "90 m²", "no"]) == [1200, 1287, 90, None]
