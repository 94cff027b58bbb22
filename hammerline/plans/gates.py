"""Registered queries of predicates, gates and aggregates over feeds; imported by the catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as B
from ..operators import gates as G
from ..session import table
from .catalogue import _events, _lots, _sold, query, r

NOW = "1998-12-31"


def _day(text: str):
    return F.lit(text).cast("date")


@query(f"SELECT lot_id FROM lots WHERE status = 'upcoming' AND day >= DATE '{NOW}' - 5")
def served_live(s, d):
    return _lots(s, d).where(G.served_live("status", "day", _day(NOW), 5)).select("lot_id")


@query(f"SELECT lot_id FROM lots WHERE status = 'upcoming' AND day BETWEEN DATE '{NOW}' AND DATE '{NOW}' + 90 AND house IN (1, 2) AND category IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AND (est_low + est_high) / 2 BETWEEN 2000 AND 60000 AND (discount > 0.02 OR tax > 0.02) AND (quantity > 10 OR size > 25)")
def triage_filter(s, d):
    held = F.array_compact(F.array(F.when(F.col("discount") > 0.02, "discounted"), F.when(F.col("tax") > 0.02, "taxed"), F.when(F.col("quantity") > 10, "many"), F.when(F.col("size") > 25, "large")))
    rows = _lots(s, d).where("status = 'upcoming'").withColumn("facets", held)
    window = F.col("day").between(_day(NOW), F.date_add(_day(NOW), 90))
    return rows.where(G.triage(window, {"house": [1, 2], "category": ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]}, ("facets", [["discounted", "taxed"], ["many", "large"]]), (F.col("est_low") + F.col("est_high")) / 2, 2000, 60000)).select("lot_id")


@query("+f AS (SELECT lot_id, house, day - CAST(quantity AS INT) AS seen FROM lots), h AS (SELECT house, min(seen) AS start FROM f GROUP BY house) SELECT lot_id, seen >= DATE '1996-01-01' AND date_diff('day', start, seen) > 400 AS is_new FROM f JOIN h ON f.house = h.house")
def new_lots(s, d):
    rows = _lots(s, d).select("lot_id", "house", F.date_sub("day", F.col("quantity").cast("int")).alias("seen"))
    return G.new_since(rows, "house", "seen", _day("1996-01-01"), 400).select("lot_id", "is_new")


@query("WITH t AS (SELECT p_partkey AS lot_id, p_brand AS category, regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9#]+') AS t FROM part), s(query_id, category, words, keys) AS (VALUES (1, NULL, ['hot', 'gear'], ['text']), (2, 'Brand#3', ['gear'], ['text', 'category']), (3, NULL, [], ['text', 'colour']), (4, 'Brand#5', [], ['category'])) SELECT query_id, lot_id FROM t JOIN s ON (s.category IS NULL OR s.category = t.category) AND len(list_filter(words, lambda w: NOT list_contains(t.t, w))) = 0 WHERE len(list_filter(keys, lambda k: k NOT IN ('text', 'category'))) = 0", with_lots=False)
def saved_text_match(s, d):
    saved = s.createDataFrame([(1, None, ["hot", "gear"], ["text"]), (2, "Brand#3", ["gear"], ["text", "category"]), (3, None, [], ["text", "colour"]), (4, "Brand#5", [], ["category"])], "query_id int, category string, words array<string>, keys array<string>")
    lots = table(s, d, "part").select(F.col("p_partkey").alias("lot_id"), F.col("p_brand").alias("category"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return G.text_query_matches(lots, F.broadcast(saved), F.col("title"), ["text", "category"])  # one row a saved query


@query("SELECT lot_id, CASE WHEN status <> 'sold' THEN 'unsold' WHEN price IS NULL OR price <= 0 THEN 'no-price' WHEN price < 1500 THEN 'tiny' WHEN day > DATE '2001-06-30' THEN 'future' WHEN price > 3 * est_high THEN 'high' WHEN price < est_low / 3 THEN 'low' WHEN est_high < 2000 THEN 'small-estimate' WHEN quantity >= 50 THEN 'bulk' WHEN tax >= 0.08 AND discount >= 0.1 THEN 'odd-terms' END AS excluded FROM lots")
def comp_excludes(s, d):
    p = F.col("price")
    rules = [(F.col("status") != "sold", "unsold"), (p.isNull() | (p <= 0), "no-price"), (p < 1500, "tiny"), (F.col("day") > _day("2001-06-30"), "future"), (p > 3 * F.col("est_high"), "high"), (p < F.col("est_low") / 3, "low"), (F.col("est_high") < 2000, "small-estimate"), (F.col("quantity") >= 50, "bulk"), ((F.col("tax") >= 0.08) & (F.col("discount") >= 0.1), "odd-terms")]
    return G.stamp(_lots(s, d), rules, "excluded").select("lot_id", "excluded")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE NOT regexp_matches(lower(p_name), '^(hot|old) | (bolt|nut)$')", with_lots=False)
def junk_gate(s, d):
    return table(s, d, "part").where(~F.lower("p_name").rlike("^(hot|old) | (bolt|nut)$")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT category, form, count(*) AS n FROM lots WHERE CASE category WHEN 'Brand#1' THEN form IN ('ECONOMY', 'SMALL') WHEN 'Brand#2' THEN form IN ('PROMO') ELSE true END GROUP BY category, form")
def market_fit(s, d):
    fits = G.fits_market("category", "form", {"Brand#1": ["ECONOMY", "SMALL"], "Brand#2": ["PROMO"]})
    return _lots(s, d).where(fits).groupBy("category", "form").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts > TIMESTAMP '2024-01-15 12:00:00' AS is_open, floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-15 12:00:00') > 0 AND floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-15 12:00:00') <= 86400 AS soon, date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS days FROM events", with_lots=False)
def closing_state(s, d):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return _events(s, d).select("event_id", G.is_open(F.col("ts"), now).alias("is_open"), G.closes_within(F.col("ts"), now, 24).alias("soon"), F.datediff(F.to_date("ts"), F.to_date(now)).cast("long").alias("days"))


_ATTRIBUTES = "+a AS (SELECT lot_id, maker, form, object, day, status, price, quantity, size, CASE WHEN tax > 0.02 THEN CAST(floor(tax * 50) AS INT) END AS medium, CASE WHEN discount > 0.02 THEN CAST(floor(discount * 50) AS INT) END AS support FROM lots)"


def _attributes(s, d):
    return _lots(s, d).select("lot_id", "maker", "form", "object", "day", "status", "price", "quantity", "size", F.when(F.col("tax") > 0.02, F.floor(F.col("tax") * 50).cast("int")).alias("medium"), F.when(F.col("discount") > 0.02, F.floor(F.col("discount") * 50).cast("int")).alias("support"))


_GATES = [("differ", "medium", None), ("differ", "support", None), ("apart", "quantity", 2.0), ("gap", "size", 8.0)]
_GATED = _ATTRIBUTES + ", g AS (SELECT t.lot_id AS target, c.lot_id AS comp, c.price, CASE WHEN coalesce(t.medium <> c.medium, false) THEN 'differ:medium' WHEN coalesce(t.support <> c.support, false) THEN 'differ:support' WHEN greatest(t.quantity, c.quantity) / least(t.quantity, c.quantity) > 2.0 THEN 'apart:quantity' WHEN abs(t.size - c.size) > 8 THEN 'gap:size' END AS conflict FROM a t JOIN a c ON t.maker = c.maker AND t.form = c.form AND c.day < t.day WHERE t.status = 'upcoming' AND c.status = 'sold' AND c.price > 0)"


def _gated(s, d):
    rows = _attributes(s, d)
    targets, comps = rows.where("status = 'upcoming'"), rows.where("status = 'sold' and price > 0")
    pairs = G.gated_pairs(targets, comps, ["maker", "form"], _GATES, [F.col("c.day") < F.col("t.day")])
    return pairs.select(F.col("t.lot_id").alias("target"), F.col("c.lot_id").alias("comp"), F.col("c.price").alias("price"), "conflict")


@query(_GATED + " SELECT target, count(*) AS n, round(median(price), 6) AS median FROM g WHERE conflict IS NULL GROUP BY target")
def gated_pool(s, d):
    return _gated(s, d).where("conflict is null").groupBy("target").agg(F.count("*").alias("n"), r(F.median("price")).alias("median"))


@query(_GATED + " SELECT coalesce(conflict, 'none') AS conflict, count(*) AS n FROM g GROUP BY 1")
def conflict_reasons(s, d):
    return _gated(s, d).groupBy(F.coalesce("conflict", F.lit("none")).alias("conflict")).agg(F.count("*").alias("n"))


@query("+u AS (SELECT lot_id, object, house FROM lots WHERE status = 'upcoming'), h AS (SELECT object, count(DISTINCT house) - 1 AS n FROM u GROUP BY object HAVING count(DISTINCT house) > 1) SELECT lot_id, u.object, house, n AS n_elsewhere FROM u JOIN h ON u.object = h.object")
def cross_house_collisions(s, d):
    return G.collisions(_lots(s, d).where("status = 'upcoming'"), "object", "house", "lot_id")


@query("+k AS (SELECT lot_id, status, unnest(['object|' || object, 'lot|' || maker || '|' || form || '|' || size]) AS k FROM lots), p AS (SELECT DISTINCT a.lot_id AS target, b.lot_id AS comp FROM k a JOIN k b ON a.k = b.k AND a.lot_id <> b.lot_id WHERE a.status = 'upcoming' AND b.status = 'sold') SELECT target, count(*) AS n FROM p GROUP BY target")
def superset_candidates(s, d):
    rows = _lots(s, d)
    pairs = G.superset_pairs(rows.where("status = 'upcoming'"), rows.where("status = 'sold'"), {"object": ["object"], "lot": ["maker", "form", "size"]}, "lot_id")
    return pairs.groupBy("target").agg(F.count("*").alias("n"))


@query("+a AS (SELECT object, max(price) AS price, 0 AS rank FROM lots WHERE house = 1 GROUP BY object UNION ALL SELECT object, max(price), 1 FROM lots WHERE house = 2 GROUP BY object UNION ALL SELECT object, max(price), 2 FROM lots GROUP BY object) SELECT object, arg_min(price, rank) AS price, min(rank) AS source_rank FROM a GROUP BY object")
def source_priority_union(s, d):
    rows = _lots(s, d)
    tops = [part.groupBy("object").agg(F.max("price").alias("price")) for part in (rows.where("house = 1"), rows.where("house = 2"), rows)]
    return G.first_source(tops, "object").select("object", "price", "source_rank")


@query("+w AS (SELECT category, maker, price, lot_id, quantity AS w, sum(quantity) OVER (PARTITION BY category, maker) AS total, sum(quantity) OVER o AS upto, row_number() OVER o AS k, count(*) OVER (PARTITION BY category, maker) AS n FROM sold WINDOW o AS (PARTITION BY category, maker ORDER BY quantity DESC, lot_id ROWS UNBOUNDED PRECEDING)), c AS (SELECT category, maker, any_value(n) AS n, min(CASE WHEN k * 0.3 < 1 AND coalesce(nw, 0) * (1 - k * 0.3) <= 0.3 * (total - upto) THEN k END) AS cut, bool_or(k = 1 AND w <= 0.3 * total) AS free FROM (SELECT *, lead(w) OVER (PARTITION BY category, maker ORDER BY k) AS nw FROM w) GROUP BY category, maker), v AS (SELECT w.category, w.maker, price, lot_id, CASE WHEN c.n * 0.3 <= 1 THEN 1.0 / c.n WHEN free THEN w / total WHEN k <= cut THEN 0.3 ELSE w * (1 - cut * 0.3) / (total - max(CASE WHEN k = cut THEN upto END) OVER (PARTITION BY w.category, w.maker)) END AS cw FROM w JOIN c ON w.category = c.category AND w.maker = c.maker), m AS (SELECT category, maker, price, sum(cw) OVER (PARTITION BY category, maker ORDER BY price, lot_id ROWS UNBOUNDED PRECEDING) AS cum FROM v) SELECT category, maker, min(price) AS median FROM m WHERE cum >= 0.5 - 1e-9 GROUP BY category, maker")
def capped_weighted_median(s, d):
    return B.capped_weighted_median(_sold(s, d), ["category", "maker"], "price", "quantity", "lot_id", 0.3, "median")


@query(f"+g AS (SELECT house, category, date_diff('day', day, DATE '{NOW}') AS age, price > est_high AS beat, abs(ln(price / ((est_low + est_high) / 2))) AS e FROM sold), w AS (SELECT unnest([30, 90, 365]) AS win) SELECT win AS days, CASE WHEN grouping(house) = 0 THEN house END AS house, CASE WHEN grouping(category) = 0 THEN category END AS category, count(*) AS n, round(avg(CAST(beat AS INT)), 6) AS beat, round(median(e), 6) AS error FROM g JOIN w ON age >= 0 AND age < win GROUP BY GROUPING SETS ((win), (win, house), (win, category))")
def ledger_rollup(s, d):
    rows = _sold(s, d).select("house", "category", F.datediff(_day(NOW), "day").alias("age"), (F.col("price") > F.col("est_high")).cast("int").alias("b"), F.abs(F.ln(F.col("price") / ((F.col("est_low") + F.col("est_high")) / 2))).alias("e"))
    return B.window_rollup(rows, "age", [30, 90, 365], ["house", "category"], [F.count("*").alias("n"), r(F.avg("b")).alias("beat"), r(F.median("e")).alias("error")])


@query("SELECT category, count(*) AS n, round(avg(price), 4) AS mean, round(var_samp(price) / 1e6, 4) AS variance FROM sold GROUP BY category HAVING count(*) > 1")
def merged_states(s, d):
    legs = [B.partial_state(_sold(s, d).where(F.col("house") == h), ["category"], "price") for h in range(5)]
    return B.merge_states(legs, ["category"]).where("n > 1").select("category", "n", r("mean", 4).alias("mean"), r(F.col("variance") / 1e6, 4).alias("variance"))


@query("+p AS (SELECT house, day, count(*) AS n, round(sum(price), 2) AS total FROM sold WHERE lot_id % 3 = 0 GROUP BY house, day), t AS (SELECT house, day, count(*) AS n, round(sum(price), 2) AS total FROM sold GROUP BY house, day) SELECT coalesce(p.house, t.house) AS house, coalesce(p.day, t.day) AS day, CASE WHEN coalesce(p.day, t.day) < DATE '1998-06-01' AND p.n IS NOT NULL THEN p.n ELSE coalesce(t.n, p.n) END AS n, CASE WHEN coalesce(p.day, t.day) < DATE '1998-06-01' AND p.n IS NOT NULL THEN p.total ELSE coalesce(t.total, p.total) END AS total FROM p FULL JOIN t ON p.house = t.house AND p.day = t.day WHERE coalesce(p.day, t.day) >= DATE '1996-01-01'")
def frozen_daily(s, d):
    sums = lambda rows: rows.groupBy("house", "day").agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("total"))
    rows = _sold(s, d)
    return B.merge_daily(sums(rows.where("lot_id % 3 = 0")), sums(rows), ["house", "day"], "day", ["n", "total"], _day("1998-06-01"), _day("1996-01-01"))


@query("+f AS (SELECT unnest([{'k': 'house', 'v': CAST(house AS VARCHAR)}, {'k': 'form', 'v': form}, {'k': 'large', 'v': CASE WHEN size > 2 THEN 'yes' END}], recursive := true) FROM lots WHERE price < 50000), n AS (SELECT count(*) AS total FROM lots WHERE price < 50000) SELECT k AS facet, v AS label, count(*) AS n FROM f, n WHERE v IS NOT NULL GROUP BY k, v, total HAVING count(*) < 0.9 * total")
def facet_chips(s, d):
    return B.chips(_lots(s, d).where("price < 50000"), {"house": F.col("house"), "form": F.col("form"), "large": F.when(F.col("size") > 2, "yes")}, 0.9)


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 5", with_lots=False)
def known_entities(s, d):
    return table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).where("n >= 5")


@query("WITH e AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS item, CAST(ts AS DATE) AS saved FROM events WHERE event_type = 'click'), l AS (SELECT l_partkey AS item, CAST(l_shipdate AS DATE) + 9000 AS day, l_extendedprice AS price, l_returnflag = 'A' AS owned FROM lineitem WHERE l_linestatus = 'F') SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (owned) AS owned FROM e JOIN l ON e.item = l.item AND saved <= day WHERE price > 0 AND day < DATE '2024-12-31' GROUP BY 1", with_lots=False)
def weekly_saves(s, d):
    saves = _events(s, d).where("event_type = 'click'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item"), F.to_date("ts").alias("saved"))
    sold = table(s, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_partkey").alias("item"), F.date_add(F.col("l_shipdate").cast("date"), 9000).alias("day"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "A").alias("owned"))
    hits = saves.join(sold, "item").where((F.col("saved") <= F.col("day")) & (F.col("price") > 0) & (F.col("day") < _day("2024-12-31")))
    return hits.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if("owned").alias("owned"))


@query("+c AS (SELECT house, floor(price / 100) AS p, count(*) AS c FROM sold GROUP BY ALL) SELECT house, max(c) AS longest, round(max(c) / sum(c), 6) AS share FROM c GROUP BY house")
def longest_repeat(s, d):
    return B.top_value_share(_sold(s, d).withColumn("p", F.floor(F.col("price") / 100)), ["house"], "p").withColumn("share", r("share"))


@query("+k AS (SELECT lot_id, maker, row_number() OVER (PARTITION BY maker ORDER BY price DESC, lot_id) AS n FROM sold) SELECT lot_id, maker FROM k WHERE (n - 1) % 7 = 0")
def stride_sample(s, d):
    return B.stride(_sold(s, d), ["maker"], [F.desc("price"), "lot_id"], 7).select("lot_id", "maker")


@query(_GATED + ", k AS (SELECT target, comp, row_number() OVER (PARTITION BY target ORDER BY round(price, -2) DESC, comp) AS n FROM g WHERE conflict IS NULL) SELECT target, comp, CAST(n AS INT) AS n FROM k WHERE n <= 5")
def top_comps(s, d):
    best = W.partitionBy("target").orderBy(F.desc(F.round("price", -2)), "comp")
    return _gated(s, d).where("conflict is null").withColumn("n", F.row_number().over(best)).where("n <= 5").select("target", "comp", "n")


@query("+w AS (SELECT p_partkey AS id, p_brand AS brand, string_split(p_name, ' ') AS words, p_size AS size FROM part), o AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) AS overlap, abs(a.size - b.size) AS d FROM w a JOIN w b ON a.brand = b.brand AND a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, d, b) AS n FROM o WHERE overlap > 0) SELECT a AS target, b AS comp, overlap FROM k WHERE n <= 12".replace("+w", "WITH w"), with_lots=False)
def overlap_pool(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.split("p_name", " ").alias("words"), F.col("p_size").alias("size"))
    return B.overlap_pool(rows, "id", ["brand"], "words", "size", 12)


@query("+q AS (SELECT maker, q, max(price) AS top FROM sold GROUP BY maker, q) SELECT maker, q, top, max(top) OVER (PARTITION BY maker ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q")
def prior_period_record(s, d):
    before = W.partitionBy("maker").orderBy("q").rowsBetween(W.unboundedPreceding, -1)
    return _sold(s, d).groupBy("maker", "q").agg(F.max("price").alias("top")).withColumn("before", F.max("top").over(before))


@query("+s AS (SELECT maker, price, day, lot_id, count(*) OVER (PARTITION BY maker) AS n FROM sold) SELECT maker, coalesce(CASE WHEN max(n) >= 3 THEN round(median(price), 6) END, -1.0) AS median FROM s GROUP BY maker")
def median_or_default(s, d):
    return _sold(s, d).groupBy("maker").agg(r(B.median_or("price", -1.0, 3)).alias("median"))
