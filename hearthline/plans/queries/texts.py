"""Text, URL, price-text, address and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import constants as K
from hearthline.functions import dates, labels, money, place, text, urls
from hearthline.operators import similar, text_terms
from hearthline.plans.catalog import query
from hearthline.plans.tables import LISTINGS_SQL, listings, table

WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query("text_clean", r"""
SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS cleaned, lower(text) AS repaired FROM documents""")
def _clean(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("cleaned"), text.fix_description(F.col("text")).alias("repaired"))


@query("text_metrics", rf"""
WITH d AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents)
SELECT doc_id, length(text) AS n_chars, len(w) AS n_words,
       round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0), 6) AS avg_word_length,
       round(coalesce(length(regexp_replace(text, '[^.,!?;:]', '', 'g')) / nullif(length(text), 0), 0), 6) AS punctuation_density,
       round(len(w) / greatest(len(regexp_extract_all(text, '[.!?]+')), 1)
             + coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0), 6) AS readability
FROM d""")
def _metrics(spark, sf):
    t, clean = F.col("text"), F.col("clean")
    return table(spark, sf, "documents").withColumn("clean", text.clean_text(t)).select(
        "doc_id", F.length(t).cast("bigint").alias("n_chars"), text.word_count(clean).cast("bigint").alias("n_words"),
        F.round(text.avg_word_length(clean), 6).alias("avg_word_length"), F.round(text.punctuation_density(t), 6).alias("punctuation_density"),
        F.round(text.readability_score(clean), 6).alias("readability"))


FLAG_GROUPS = {"article": ["der ", "the ", "les "], "ending": ["tion", "ment", "ung"], "license": ["license", "copyright"]}


def _flag_sql(keywords):
    return "CAST(" + " OR ".join(f"contains(lower(text), '{k}')" for k in keywords) + " AS INT)"


@query("keyword_flags", "SELECT doc_id, " + ", ".join(f"{_flag_sql(v)} AS has_{k}" for k, v in FLAG_GROUPS.items()) + " FROM documents")
def _flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[
        v.alias(k) for k, v in text.keyword_flags(F.lower("text"), FLAG_GROUPS, "has_").items()])


def _score_sql(keywords):
    return " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in keywords)


@query("keyword_scores", f"""
SELECT doc_id, {_score_sql(K.LUXURY_WORDS)} AS luxury, {_score_sql(K.POSITIVE_WORDS)} AS positive,
       {_score_sql(['the', 'les', 'der', 'ou', 'an'])} AS common FROM documents""")
def _scores(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.keyword_score(low, K.LUXURY_WORDS).alias("luxury"), text.keyword_score(low, K.POSITIVE_WORDS).alias("positive"),
        text.keyword_score(low, ["the", "les", "der", "ou", "an"]).alias("common"))


@query("stored_or_keyword_flags", f"""
SELECT l.listing_id, CAST(bathroom_count = 3 OR contains(lower(d.text), 'tion') AS INT) AS has_garage, CAST(contains(lower(d.text), 'der ') AS INT) AS has_lift
FROM ({LISTINGS_SQL}) l JOIN documents d ON d.doc_id = l.listing_id % (SELECT count(*) FROM documents)""")
def _stored(spark, sf):
    from hearthline.plans.tables import described_listings

    df, low = described_listings(spark, sf), F.lower("description")
    return df.select("listing_id", text.stored_or_keyword_flag(F.col("bathroom_count") == 3, low, ["tion"]).alias("has_garage"),
                     text.stored_or_keyword_flag(None, low, ["der "]).alias("has_lift"))


@query("phones", rf"""
SELECT doc_id, list_aggregate(list_sort(list_distinct(list_transform(
       regexp_extract_all(text, '(?:\+?216[-.\s]?)?(?:\d{{2}}[-.\s]?\d{{3}}[-.\s]?\d{{3,4}}|\d{{8}})'), lambda x: trim(x)))), 'string_agg', '|') AS phones
FROM documents""")
def _phones(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", text.phones(F.col("text")).alias("p"))
    return found.select("doc_id", F.when(F.size("p") > 0, F.array_join("p", "|")).alias("phones"))


@query("description_lines", r"""
SELECT doc_id, len(l) AS n_lines, l[1] AS first_line, array_to_string(l, ' ') AS flat
FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), '<br/>'), '(?i)<br\s*/?>', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '') AS l FROM documents)""")
def _lines(spark, sf):
    html = F.replace("text", F.lit("\n"), F.lit("<br/>"))
    return table(spark, sf, "documents").select("doc_id", text.description_lines(html).alias("l")).select(
        "doc_id", F.size("l").cast("bigint").alias("n_lines"), F.get("l", F.lit(0)).alias("first_line"), text.flatten_to_text(F.col("l")).alias("flat"))


@query("text_preview", """
SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview FROM documents""")
def _preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("array_head", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, array_to_string(w[1:6], ' ') AS head, greatest(len(w) - 6, 0) AS more FROM d""")
def _head(spark, sf):
    headed = table(spark, sf, "documents").select("doc_id", labels.array_head(text.words(F.col("text"))).alias("h"))
    return headed.select("doc_id", F.array_join("h.head", " ").alias("head"), F.col("h.more").cast("bigint").alias("more"))


HOST_SQL = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
PATH_SQL = "regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query("url_normalize", f"SELECT page_id, 'https://' || {HOST_SQL} || {PATH_SQL} AS url_key FROM pages")
def _strict(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_strict(F.col("url")).alias("url_key"))


@query("url_normalize_keep_query", f"""
SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || {HOST_SQL} || {PATH_SQL} || regexp_extract(url, '\\?[^#]*') AS url_key FROM pages""")
def _keep(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_keep_query(F.col("url")).alias("url_key"))


@query("set_query_param", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(url, '([?&])page=[^&#]*', '\1page=7')
    WHEN contains(url, '?') THEN regexp_replace(url, '(\?[^#]*)', '\1&page=7') ELSE regexp_replace(url, '^([^#]*)', '\1?page=7') END AS url
FROM pages""")
def _param(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.set_query_param(F.col("url"), "page", F.lit(7)).alias("url"))


@query("page_urls", f"""
SELECT host, page, host || '/list?page=' || page AS page_url, CASE WHEN page <= 1 THEN host ELSE host || '/pag-' || page END AS path_url
FROM (SELECT host, unnest(range(1, n + 1)) AS page FROM (SELECT 'https://' || {HOST_SQL} AS host, count(*) + 1 AS n FROM pages GROUP BY 1))""")
def _page_urls(spark, sf):
    host = F.regexp_extract(urls.normalize_strict(F.col("url")), "^https://[^/]*", 0)
    hosts = table(spark, sf, "pages").groupBy(host.alias("host")).agg((F.count("*") + 1).cast("int").alias("n"))
    numbered = urls.page_urls(hosts, F.concat("host", F.lit("/list")), F.col("n"))
    return numbered.select("host", F.col("page").cast("bigint").alias("page"), "page_url", urls.path_page_url(F.col("host"), F.col("page")).alias("path_url"))


@query("listing_ids", "SELECT page_id, nullif(regexp_extract(url, '/(\\d+)\\.html?$', 1), '') AS listing_id FROM pages")
def _ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.listing_id(F.col("url")).alias("listing_id"))


@query("sorted_urls", "SELECT DISTINCT url FROM pages")
def _sorted(spark, sf):
    return table(spark, sf, "pages").select("url").distinct().orderBy("url")


@query("price_from_text", f"""
SELECT listing_id, CASE WHEN raw_price NOT IN ('nan', '') THEN CAST(raw_price AS BIGINT) END AS price, 'TND' AS currency,
       CASE WHEN raw_price NOT IN ('nan', '') THEN CAST(raw_price AS BIGINT) END AS described,
       CASE WHEN raw_price NOT IN ('nan', '') THEN 'EUR' ELSE 'TND' END AS unit
FROM ({LISTINGS_SQL})""")
def _prices(spark, sf):
    spaced = F.regexp_replace("raw_price", r"(\d)(?=(\d{3})+$)", "$1 ")
    commas = F.regexp_replace("raw_price", r"(\d)(?=(\d{3})+$)", "$1,")
    df = listings(spark, sf).select(
        "listing_id", money.price_and_currency(F.concat(spaced, F.lit(" DT"))).alias("p"),
        money.description_price(F.concat(F.lit("Nice flat. Price "), commas, F.lit(" TND per month"))).alias("d"),
        money.text_price(F.concat(F.lit("Prix: "), spaced, F.lit(" €"))).alias("e"))
    return df.select("listing_id", "p.price", "p.currency", F.col("d.price").alias("described"), F.col("e.currency").alias("unit"))


@query("address_split", f"""
SELECT listing_id, coalesce(property_type, 'X') || ' - ' || data_source || ', ' || governorate AS address, governorate,
       coalesce(property_type, 'X') AS delegation, data_source AS locality FROM ({LISTINGS_SQL})""")
def _address(spark, sf):
    raw = F.concat(F.lit("www.site.example, "), F.coalesce("property_type", F.lit("X")), F.lit(" - "), "data_source", F.lit(", "), "governorate")
    return listings(spark, sf).select("listing_id", place.split_address(raw).alias("a")).select("listing_id", "a.*")


@query("place_phrase", f"""
SELECT listing_id, coalesce(property_type, 'X') || ', ' || governorate AS address, governorate AS delegation, coalesce(property_type, 'X') AS locality FROM ({LISTINGS_SQL})""")
def _phrase(spark, sf):
    raw = F.concat(F.coalesce("property_type", F.lit("X")), F.lit("  in "), "governorate")
    return listings(spark, sf).select("listing_id", place.split_in_phrase(raw).alias("a")).select("listing_id", "a.*")


@query("title_labels", f"""
SELECT listing_id, CASE room_count WHEN 0 THEN 'Maison' WHEN 1 THEN 'Maison' WHEN 2 THEN 'Appartement' WHEN 3 THEN 'Terrain' WHEN 4 THEN 'Studio' END AS kind,
       CASE bathroom_count WHEN 1 THEN 'sale' WHEN 2 THEN 'rent' END AS deal,
       CASE bathroom_count WHEN 3 THEN 'rent' WHEN 1 THEN 'sale' WHEN 2 THEN 'rent' END AS deal_rent_first
FROM ({LISTINGS_SQL})""")
def _labels(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Belle VILLA", "maison", "Appartement S+2", "terrain maraîcher", "studio", "bureau", "ferme")]), F.col("room_count") + 1)
    deal = F.element_at(F.array(F.lit("à  vendre"), F.lit("A Louer"), F.lit("for rent")), F.col("bathroom_count"))
    title = F.concat_ws(" ", F.coalesce(kind, F.lit("lot")), deal)
    return listings(spark, sf).select("listing_id", labels.property_type(title).alias("kind"), labels.transaction_type(title, "options").alias("deal"),
                                      labels.transaction_type(title, "boxes").alias("deal_rent_first"))


@query("standard_governorate", f"""
SELECT listing_id, CASE WHEN governorate LIKE '%1%' THEN 'One' ELSE 'Nation' || substr(governorate, 7) END AS governorate_clean FROM ({LISTINGS_SQL})""")
def _governorate(spark, sf):
    return listings(spark, sf).select("listing_id", place.standard_governorate(F.col("governorate"), {"1": "One"}).alias("governorate_clean"))


@query("date_text", """
SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%B %d, %Y') AS shown, epoch_ms(o_orderdate) AS iso_ms FROM orders""")
def _dates(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    df = table(spark, sf, "orders").select(
        "o_orderkey", dates.epoch_ms(day).alias("ms"), dates.epoch_ms(F.concat(day, F.lit("T00:00:00Z"))).alias("iso_ms"))
    return df.withColumn("shown", dates.display_date(F.col("ms")))


@query("thousands", f"SELECT listing_id, format('{{:,}}', TRY_CAST(raw_price AS BIGINT)) AS shown FROM ({LISTINGS_SQL})")
def _thousands(spark, sf):
    from hearthline.functions.numbers import thousands

    return listings(spark, sf).select("listing_id", thousands(F.col("raw_price").try_cast("bigint")).alias("shown"))


@query("tfidf_top_terms", r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
vocab AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 100),
n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(df) AS df FROM tok JOIN vocab USING (term) GROUP BY 1, 2),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf, n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 5) AS weight FROM w""")
def _tfidf(spark, sf):
    terms = text_terms.tfidf(table(spark, sf, "documents"), "doc_id", "text", 100)
    return terms.withColumn("weight", F.round("weight", 5))


@query("near_duplicates", r"""
WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
o AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS c FROM tok a JOIN tok b ON a.w = b.w AND b.doc_id < a.doc_id GROUP BY 1, 2),
d AS (SELECT DISTINCT o.doc_id FROM o JOIN n x ON x.doc_id = o.doc_id JOIN n y ON y.doc_id = o.other WHERE 5 * c > 4 * (x.n + y.n - c))
SELECT doc_id, doc_id IN (SELECT doc_id FROM d) AS is_duplicate FROM documents""")
def _near(spark, sf):
    return similar.near_duplicates(table(spark, sf, "documents"), "doc_id", "text")
