"""Registered queries of parsers, search and entities; imported by the catalogue. Texts are composed from
columns, and the SQL gives the columns back: a round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import scalars as S
from ..operators import records as R
from ..operators import search as X
from ..session import table
from .catalogue import _events, _lots, _texts, query, r

_LINES = "WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INT) AS q, l_extendedprice AS price, CAST(l_shipdate AS DATE) AS day FROM lineitem)"


def _lines(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").cast("date").alias("day"))


KEY = ["o", "n", "p", "s"]


def _q(c: str):
    return F.col(c).cast("string")


@query(_LINES + " SELECT o, n, p, s, CASE WHEN q <= 12 OR q % 2 = 0 THEN q END AS size FROM l", with_lots=False)
def parsed_set_size(s, d):
    word = F.element_at(F.array(*[F.lit(w) for w in P.NUMBER_WORDS[1:]]), F.least(F.col("q"), F.lit(12)))
    title = F.when(F.col("q") <= 12, F.concat(F.lit("A Set of "), word, F.lit(" prints"))).when(F.col("q") % 2 == 0, F.concat(F.lit("Tea service, "), _q("q"), F.lit(" pieces"))).otherwise(F.concat(_q("q"), F.lit(" things")))
    return _lines(s, d).select(*KEY, P.set_size(title).alias("size"))


@query(_LINES + " SELECT o, n, p, s, q AS value FROM l", with_lots=False)
def parsed_roman(s, d):
    rest, numeral = F.col("q"), F.lit("")
    for letters, value in [x for x in P.ROMAN if x[1] <= 50]:
        numeral, rest = F.concat(numeral, F.repeat(F.lit(letters), F.floor(rest / value).cast("int"))), rest % value
    return _lines(s, d).withColumn("numeral", numeral).select(*KEY, P.roman(F.col("numeral")).alias("value"))


@query(_LINES + " SELECT o, n, p, s, CAST(year(day) AS INT) AS year, 'Base Set ' || s AS set, 'A-' || p AS number, CASE WHEN q % 3 > 0 THEN 'PSA' END AS grader, CASE WHEN q % 3 > 0 THEN CAST(q % 10 + 1 AS DOUBLE) END AS grade, CASE WHEN q % 3 > 0 THEN year(day) || '|base set ' || s || '|A-' || p || '|PSA|' || (q % 10 + 1) || '.0' END AS key FROM l", with_lots=False)
def parsed_card(s, d):
    title = F.concat(F.year("day").cast("string"), F.lit(" Base Set "), _q("s"), F.lit(" #a-"), _q("p"), F.when(F.col("q") % 3 > 0, F.concat(F.lit(" PSA "), (F.col("q") % 10 + 1).cast("string"))).otherwise(F.lit(" raw")))
    rows = _lines(s, d).withColumn("c", P.card(title))
    return rows.select(*KEY, "c.year", "c.set", F.upper("c.number").alias("number"), "c.grader", "c.grade", P.card_key(F.col("c"), True).alias("key"))


@query(_LINES + " SELECT o, n, p, s, CASE WHEN q % 4 > 1 THEN 'AB-' || (p + 10000) END AS ref, CASE WHEN q % 2 = 0 THEN (p + 1000) || ',' || (o + 100) ELSE '' END AS serials FROM l", with_lots=False)
def parsed_reference(s, d):
    ref = F.when(F.col("q") % 4 == 0, "a fine watch").when(F.col("q") % 4 == 1, "Ref. 1998 anniversary").otherwise(F.concat(F.lit("Steel, reference No. ab-"), (F.col("p") + 10000).cast("string"), F.lit(".")))
    own = F.when(F.col("q") % 2 == 0, F.concat(F.lit(" Case no. "), (F.col("p") + 1000).cast("string"), F.lit(", Movement "), (F.col("o") + 100).cast("string"))).otherwise(F.lit(" case closed"))
    rows = _lines(s, d).withColumn("t", ref).withColumn("u", own)
    return rows.select(*KEY, P.reference(F.col("t")).alias("ref"), F.array_join(P.serials(F.col("u")), ",").alias("serials"))


@query(_LINES + " SELECT o, n, p, s, CASE WHEN q % 5 = 0 THEN q END AS number, CASE WHEN q % 5 = 0 THEN q + 50 END AS size, 'm' || s || '|ed night the watch' AS key FROM l", with_lots=False)
def parsed_edition(s, d):
    cases = [F.concat(F.lit("The Night Watch ed "), _q("q"), F.lit(" / "), (F.col("q") + 50).cast("string")), F.concat(F.lit("The Night Watch, ed. scale 1/"), (F.col("q") + 1).cast("string")), F.concat(F.lit("The Night Watch ed "), _q("q"), F.lit("/12/1998")), F.concat(F.lit("The Night Watch ed "), (F.col("q") + 50).cast("string"), F.lit("/"), _q("q")), F.lit("The Night Watch ed")]
    title = F.element_at(F.array(*cases), F.col("q") % 5 + 1)
    rows = _lines(s, d).withColumn("t", title).withColumn("e", P.edition(F.col("t")))
    return rows.select(*KEY, "e.number", "e.size", P.edition_key(F.concat(F.lit("m"), _q("s")), F.concat(F.lit("The Night Watch, ed "), _q("q"), F.lit("/"), _q("n"))).alias("key"))


@query(_LINES + " SELECT o, n, p, s, CASE q % 3 WHEN 0 THEN round((q + 0.5) * 2.54, 3) WHEN 1 THEN CAST(q AS DOUBLE) ELSE round(q * 0.1, 3) END AS largest, CASE WHEN CASE q % 3 WHEN 0 THEN (q + 0.5) * 2.54 WHEN 1 THEN q ELSE q * 0.1 END < 10 THEN 'small' WHEN CASE q % 3 WHEN 0 THEN (q + 0.5) * 2.54 WHEN 1 THEN q ELSE q * 0.1 END < 40 THEN 'medium' ELSE 'large' END AS class FROM l", with_lots=False)
def parsed_dimensions(s, d):
    text = F.when(F.col("q") % 3 == 0, F.concat(F.lit("Oil on board, 1 x "), _q("q"), F.lit(" 1/2 in framed"))).when(F.col("q") % 3 == 1, F.concat(F.lit("image: "), _q("q"), F.lit(" × 1 cm"))).otherwise(F.concat(F.lit("Bronze 1 x 2 x "), _q("q"), F.lit(" mm high")))
    rows = _lines(s, d).withColumn("cm", P.dimensions(text))
    return rows.select(*KEY, F.when(F.col("q") >= 1, F.array_max("cm")).alias("largest"), P.size_class(F.col("cm"), [(10.0, "small"), (40.0, "medium")], "large").alias("class")).withColumn("largest", F.col("largest"))


@query(_LINES + " SELECT o, n, p, s, day AS named, last_day(day) AS month_end FROM l", with_lots=False)
def parsed_dates(s, d):
    month = F.date_format("day", "MMMM")
    named = F.when(F.col("q") % 2 == 0, F.concat(F.lit("Sold "), F.dayofmonth("day").cast("string"), F.lit(" "), month, F.lit(" "), F.year("day").cast("string"))).otherwise(F.concat(month, F.lit(" "), F.dayofmonth("day").cast("string"), F.lit("th, "), F.year("day").cast("string")))
    rows = _lines(s, d).withColumn("t", named).withColumn("u", F.concat(F.lit("The "), month, F.lit(" sale of "), F.year("day").cast("string")))
    return rows.select(*KEY, P.named_date(F.col("t")).alias("named"), P.named_date(F.col("u")).alias("month_end"))


@query(_LINES + " SELECT o, n, p, s, CAST(least(q * 100, p * 10) AS DOUBLE) AS low, CAST(greatest(q * 100, p * 10) AS DOUBLE) AS high, CASE WHEN price > q * 1000 THEN CAST(floor((price / (q * 1000) - 1) * 100 + 0.5) AS BIGINT) WHEN price < q * 500 THEN CAST(floor((price / (q * 500) - 1) * 100 + 0.5) AS BIGINT) ELSE 0 END AS over FROM l", with_lots=False)
def parsed_estimates(s, d):
    text = F.concat(F.lit("Estimate $"), F.format_number(F.col("q") * 100, 0), F.lit(" - "), F.format_number(F.col("p") * 10, 0))
    rows = _lines(s, d).withColumn("e", P.estimate_range(text))
    return rows.select(*KEY, "e.low", "e.high", P.over_estimate(F.col("price"), F.col("q") * 500, F.col("q") * 1000).alias("over"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '\\bold\\b', 'vintage'), '\\bhot\\b', 'warm') AS rewritten, CASE WHEN p_size % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS title, replace(p_name, ' ', ' B') AS parted FROM part", with_lots=False)
def cleaned_titles(s, d):
    part = table(s, d, "part")
    shouted = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("id"), P.rewritten(F.col("p_name"), [("old", "vintage"), ("hot", "warm")]).alias("rewritten"), P.unshouted(shouted).alias("title"), P.unglued(F.replace("p_name", F.lit(" "), F.lit("B"))).alias("parted"))


@query("SELECT event_id, CAST(timezone('UTC', ts) AT TIME ZONE CASE user_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' ELSE 'UTC' END AS DATE) AS local_day, to_timestamp(floor(epoch(ts)) + 60 * CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 30 ELSE 15 END) AT TIME ZONE 'UTC' AS live_until FROM events", with_lots=False)
def sale_local_days(s, d):
    e = _events(s, d)
    zones = {0: "America/New_York", 1: "Asia/Tokyo"}
    return e.select("event_id", P.local_day(F.col("ts"), F.col("user_id") % 3, zones).alias("local_day"), P.live_until(F.col("ts"), F.col("event_type"), {"view": 5, "click": 30}, 15).cast("timestamp_ntz").alias("live_until"))


@query("SELECT p_partkey AS id, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part", with_lots=False)
def filter_codec(s, d):
    text = P.encoded_filters({"name": F.col("p_name"), "size": F.col("p_size"), "none": F.lit(None).cast("string")})
    return table(s, d, "part").withColumn("m", P.decoded_filters(text)).select(F.col("p_partkey").alias("id"), F.col("m")["name"].alias("name"), F.col("m")["size"].alias("size"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o, o_orderstatus AS first, CASE WHEN o_orderkey % 3 > 0 THEN 'F' END AS second FROM orders", with_lots=False)
def dictionary_codes(s, d):
    names = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    codes = F.array(F.array_position(names, F.col("o_orderstatus")).cast("int") - 1, F.when(F.col("o_orderkey") % 3 > 0, 0).otherwise(-1))
    got = P.dictionary_decoded(codes, names)
    return table(s, d, "orders").withColumn("d", got).select(F.col("o_orderkey").alias("o"), F.col("d")[0].alias("first"), F.col("d")[1].alias("second"))


@query("SELECT n_name AS name, round(ln(n_nationkey + 2), 6) AS ln, round(CASE WHEN n_nationkey > 0 THEN ln(n_nationkey) END, 6) AS safe_ln FROM nation", with_lots=False)
def safe_logarithms(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name"), r(F.ln(F.col("n_nationkey") + 2)).alias("ln"), r(S.positive_ln(F.col("n_nationkey"))).alias("safe_ln"))


@query("WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS t FROM part) SELECT id FROM w WHERE len(list_filter(t, lambda x: starts_with(x, 'ge'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'ho'))) > 0", with_lots=False)
def feed_text_match(s, d):
    return X.text_matches(table(s, d, "part").withColumn("id", F.col("p_partkey")), "id", F.col("p_name"), ["ge", "ho"])


@query("WITH r AS (SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS ref, p_name AS name, p_size AS n FROM part), k AS (SELECT *, CASE WHEN ref = '12' THEN 0 WHEN starts_with(ref, '12') THEN 1 WHEN contains(name, '12') THEN 2 END AS rank FROM r) SELECT id, rank FROM k WHERE rank IS NOT NULL", with_lots=False)
def reference_match(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("ref"), F.col("p_name").alias("name"), F.col("p_size").alias("n"))
    return X.ranked_references(rows, "ref", "name", "n", "12").select("id", "rank")


@query("+n AS (SELECT p_name AS label, CAST(count(*) AS DOUBLE) AS score, min(p_partkey) AS id FROM part GROUP BY p_name), c AS (SELECT category AS label, CAST(count(*) AS DOUBLE) AS score, min(lot_id) AS id FROM lots GROUP BY category), k AS (SELECT 0 AS section_rank, 'names' AS section, *, row_number() OVER (ORDER BY score DESC, id) AS n FROM n UNION ALL SELECT 1, 'markets', *, row_number() OVER (ORDER BY score DESC, id) FROM c) SELECT section_rank, section, label, score, id FROM k WHERE n <= 6")
def palette_sections(s, d):
    names = table(s, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").cast("double").alias("score"), F.min("p_partkey").alias("id"))
    markets = _lots(s, d).groupBy(F.col("category").alias("label")).agg(F.count("*").cast("double").alias("score"), F.min("lot_id").alias("id"))
    return X.sections({"names": names, "markets": markets}, ["names", "markets"], 6)


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 2 ORDER BY n DESC, name LIMIT 25", with_lots=False)
def top_names(s, d):
    return X.top_names(table(s, d, "part").select(F.col("p_name").alias("name")), "name", 2, 25)


@query("+u AS (SELECT * FROM lots WHERE status = 'upcoming'), f AS (SELECT unnest([{'kind': 'maker', 'label': CAST(maker AS VARCHAR)}, {'kind': 'category', 'label': category}], recursive := true), day FROM u) SELECT kind, label, count(*) AS n, min(day) AS next FROM f GROUP BY kind, label")
def live_buckets(s, d):
    return X.buckets(_lots(s, d).where("status = 'upcoming'"), {"maker": "maker", "category": "category"})


@query("+k AS (SELECT lot_id, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY price DESC, lot_id) <= 12 THEN 'main' ELSE 'tail' END AS tier FROM lots) SELECT * FROM k")
def main_and_tail(s, d):
    return X.tiers(_lots(s, d), ["category"], [F.desc("price"), "lot_id"], 12).select("lot_id", "tier")


@query("WITH p AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS s, lower(replace(p_brand, '#', '-')) AS q FROM part), k AS (SELECT *, count(*) OVER (PARTITION BY s) AS many, row_number() OVER (PARTITION BY s, q ORDER BY id) AS again FROM p) SELECT id, CASE WHEN many = 1 THEN s WHEN again = 1 THEN s || '-' || q ELSE s || '-' || q || '-' || again END AS slug FROM k", with_lots=False)
def entity_slugs(s, d):
    return X.slugs(table(s, d, "part").withColumn("id", F.col("p_partkey")), "p_name", "p_brand", "id")


@query("SELECT p_partkey AS id, p_size % 3 = 0 AS about FROM part", with_lots=False)
def attribution_flags(s, d):
    part = table(s, d, "part")
    title = F.concat(F.when(F.col("p_size") % 3 == 0, "Print after ").otherwise("Print by "), F.col("p_brand"))
    return part.select(F.col("p_partkey").alias("id"), X.about_not_by(title, F.col("p_brand"), ["after", "portrait of"]).alias("about"))


@query()
def spelling(s, d):
    """Misspelt forms of frequent words of the documents; OSA has no SQL, tests compare with brute force."""
    words = s.createDataFrame([("teh",), ("adn",), ("whcih",), ("thier",), ("the",), ("nciht",)], "word string")
    vocabulary = _texts(s, d).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 20")
    return X.spelled(words, vocabulary, 5.0)


@query("WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[''\"]', '', 'g'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS tokens FROM documents) SELECT count(*) AS total FROM t WHERE list_contains(tokens, 'the') AND list_contains(tokens, 'and') AND list_contains(tokens, 'that')", with_lots=False)
def search_total(s, d):
    return X.total(R.posting_chunks(_texts(s, d), "id", F.col("tokens")), ["the", "and", "that"], False)


@query("+k AS (SELECT lot_id, unnest([0.0005, 0.01, 0.2, 0.5, 0.8, 0.999]) AS p FROM lots WHERE sale = (SELECT min(sale) FROM lots)) SELECT DISTINCT CAST(p AS DOUBLE) AS p, CAST(CASE p WHEN 0.0005 THEN -3.2905 WHEN 0.01 THEN -2.3263 WHEN 0.2 THEN -0.8416 WHEN 0.5 THEN 0.0 WHEN 0.8 THEN 0.8416 ELSE 3.0902 END AS DOUBLE) AS z FROM k")
def normal_quantiles(s, d):
    points = s.createDataFrame([(p,) for p in (0.0005, 0.01, 0.2, 0.5, 0.8, 0.999)], "p double")
    return points.select("p", F.round(P.normal_quantile(F.col("p")), 4).alias("z"))


@query("WITH k AS (SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS n FROM events) SELECT a.user_id, round(a.value - b.value, 6) AS delta, floor(epoch(a.ts)) - floor(epoch(b.ts)) <= 86400 AS fresh FROM k a JOIN k b ON a.user_id = b.user_id WHERE a.n = 1 AND b.n = 2", with_lots=False)
def stream_velocity(s, d):
    from ..streaming.flows import velocity

    return velocity(_events(s, d), "user_id", "ts", "value", "1 day").withColumn("delta", r("delta"))


@query("+a AS (SELECT status, date_diff('day', day, DATE '1999-06-01') AS age FROM lots) SELECT CASE WHEN status <> 'upcoming' THEN status WHEN age < 0 THEN 'live' WHEN age <= 7 THEN 'awaiting' WHEN age <= 60 THEN 'stale' ELSE 'lost' END AS state, count(*) AS n FROM a GROUP BY 1")
def late_results(s, d):
    from ..streaming.flows import late_status

    return _lots(s, d).groupBy(late_status("status", "day", F.lit("1999-06-01").cast("date"), 7, 60).alias("state")).agg(F.count("*").alias("n"))


@query("+o AS (SELECT object, max(day) AS day, max(price) AS price FROM sold WHERE house < 3 GROUP BY object), n AS (SELECT object, max(day) AS day, min(price) AS price FROM sold WHERE house > 1 GROUP BY object) SELECT coalesce(o.object, n.object) AS object, CASE WHEN n.object IS NOT NULL AND (o.object IS NULL OR date_diff('day', coalesce(o.day, n.day), DATE '2000-01-01') <= 400) THEN n.day ELSE o.day END AS day, CASE WHEN n.object IS NOT NULL AND (o.object IS NULL OR date_diff('day', coalesce(o.day, n.day), DATE '2000-01-01') <= 400) THEN n.price ELSE o.price END AS price FROM o FULL JOIN n ON o.object = n.object")
def restated_results(s, d):
    from ..streaming.flows import restated
    from .catalogue import _sold

    rows = _sold(s, d)
    before = rows.where("house < 3").groupBy("object").agg(F.max("day").alias("day"), F.max("price").alias("price"))
    fresh = rows.where("house > 1").groupBy("object").agg(F.max("day").alias("day"), F.min("price").alias("price"))
    return restated(before, fresh, "object", "day", F.lit("2000-01-01").cast("date"), 400)


@query("WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT a.event_id AS click, b.event_id AS purchase FROM a JOIN b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR", with_lots=False)
def matched_events(s, d):
    from ..streaming.flows import matched_streams

    e = _events(s, d)
    pairs = matched_streams(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", "12 hours")
    return pairs.select(F.col("a.event_id").alias("click"), F.col("b.event_id").alias("purchase"))


@query("WITH m AS (SELECT event_type, date_trunc('minute', ts) AS w, least(count(*), 2) AS n FROM events GROUP BY ALL) SELECT CAST(w AS DATE) AS day, event_type, least(CAST(sum(n) AS BIGINT), 40) AS counted FROM m GROUP BY ALL", with_lots=False)
def day_capped_counts(s, d):
    from ..streaming.flows import day_capped

    return day_capped(_events(s, d), "ts", "event_type", 2, 40)
