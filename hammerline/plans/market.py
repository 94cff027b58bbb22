"""Registered queries of the market operators; imported by the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import market as M
from ..operators import records as R
from ..session import table
from .catalogue import PREMIUM, _events, _lots, _sold, query, r

NOW = "1998-12-31"
LAST_EVENT = "2024-01-31"


def _day(text: str):
    return F.lit(text).cast("date")


@query("+d AS (SELECT house, ln(price) - avg(ln(price)) OVER (PARTITION BY object) AS dev, min(house) OVER (PARTITION BY object) <> max(house) OVER (PARTITION BY object) AS two FROM sold), g AS (SELECT house, count(*) AS n, exp(sum(dev) / (count(*) + 40)) AS f FROM d WHERE two GROUP BY house) SELECT house, n, round(greatest(CASE WHEN n >= 250 THEN 0.75 ELSE 0.85 END, least(CASE WHEN n >= 250 THEN 1.25 ELSE 1.15 END, f)), 6) AS factor FROM g")
def venue_factors(s, d):
    return M.venue_factors(_sold(s, d), "object", "house", "price", k=40, wide_from=250, limit=0.15, wide_limit=0.25).withColumn("factor", r("factor"))


@query("+o AS (SELECT category, maker, median(price) AS own, count(*) AS n FROM sold GROUP BY category, maker HAVING count(*) >= 3), w AS (SELECT category, median(own) AS whole FROM o GROUP BY category HAVING count(*) >= 5) SELECT o.category, maker, n, round(own / whole, 6) AS factor FROM o JOIN w ON o.category = w.category")
def roster_factors(s, d):
    return M.roster_factors(_sold(s, d), "category", "maker", "price", least_rows=3, least_members=5).withColumn("factor", r("factor"))


_VARIANTS = "+v AS (SELECT object, price, CASE CAST(quantity AS INT) % 4 WHEN 0 THEN NULL WHEN 3 THEN 'gold' ELSE 'steel' END AS material, list_filter([CASE WHEN tax > 0.05 THEN 'limited' END, CASE WHEN discount > 0.02 THEN 'signed' END], lambda m: m IS NOT NULL) AS markers FROM sold)"


@query(
    _VARIANTS
    + """, m AS (SELECT object, unnest(markers) AS marker FROM v), z AS (SELECT object, count(*) AS n FROM v GROUP BY object),
odd AS (SELECT m.object, marker FROM m JOIN z ON m.object = z.object GROUP BY m.object, marker, z.n HAVING count(*) < 0.6 * z.n),
p AS (SELECT v.* FROM v WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.object = v.object AND list_contains(v.markers, odd.marker))),
b AS (SELECT object, material, count(*) AS n, median(price) AS med FROM p WHERE material IS NOT NULL GROUP BY object, material),
t AS (SELECT object, max(n) < 0.75 * sum(n) AS mixed, arg_min(material, (-n, material)) AS lead, arg_min(material, (med, material)) FILTER (n >= 2) AS cheap, arg_min(n, (med, material)) FILTER (n >= 2) AS cheap_n FROM b GROUP BY object),
c AS (SELECT object, mixed, mixed AND coalesce(cheap_n, 0) < 4 AS abstain, CASE WHEN mixed THEN cheap ELSE lead END AS keep FROM t),
k AS (SELECT p.object, p.price, c.keep, coalesce(c.abstain, false) AS abstain FROM p LEFT JOIN c ON p.object = c.object WHERE c.keep IS NULL OR p.material = c.keep OR (p.material IS NULL AND NOT c.mixed))
SELECT object, CASE WHEN bool_or(abstain) THEN 0 ELSE count(*) END AS n, CASE WHEN NOT bool_or(abstain) THEN round(median(price), 6) END AS median, CASE WHEN NOT bool_or(abstain) THEN max(keep) END AS material, CASE WHEN bool_or(abstain) THEN 'mixed' END AS abstain FROM k GROUP BY object"""
)
def purified_pools(s, d):
    quantity = F.col("quantity").cast("int") % 4
    rows = _sold(s, d).withColumn("material", F.when(quantity == 3, "gold").when(quantity != 0, "steel")).withColumn("markers", F.array_compact(F.array(F.when(F.col("tax") > 0.05, "limited"), F.when(F.col("discount") > 0.02, "signed"))))
    return M.purify_pools(rows, "object", "material", "markers", "price", intrinsic=0.6, dominance=0.75, least=4).withColumn("median", r("median"))


@query(
    """+g AS (SELECT object, CAST(quantity AS INT) AS grade, maker, price FROM sold), e AS (SELECT object, grade, median(price) AS v FROM g GROUP BY object, grade HAVING count(*) >= 2),
n AS (SELECT object, grade + s AS grade, median(price) AS v FROM g, (VALUES (-1), (1)) t(s) GROUP BY object, grade + s HAVING count(*) >= 3), w AS (SELECT maker, median(price) AS v FROM g GROUP BY maker HAVING count(*) >= 6)
SELECT lot_id, round(coalesce(e.v, n.v, w.v), 6) AS price, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN n.v IS NOT NULL THEN 'grade' WHEN w.v IS NOT NULL THEN 'wide' END AS tier
FROM lots l LEFT JOIN e ON l.object = e.object AND CAST(l.quantity AS INT) = e.grade LEFT JOIN n ON l.object = n.object AND CAST(l.quantity AS INT) = n.grade LEFT JOIN w ON l.maker = w.maker WHERE l.status = 'upcoming'"""
)
def tiered_prices(s, d):
    grade = F.col("quantity").cast("int").alias("grade")
    targets = _lots(s, d).where("status = 'upcoming'").select("lot_id", "object", grade, "maker")
    return M.tiered_prices(targets, _sold(s, d).select("object", grade, "maker", "price"), ["object"], "grade", ["maker"], "price", step=1, least=(2, 3, 6)).select("lot_id", r("price").alias("price"), "tier")


_RESIDUAL = "+z AS (SELECT house, category, ln(price / ((est_low + est_high) / 2)) AS z FROM sold)"


@query(_RESIDUAL + ", c AS (SELECT house, category, count(*) AS n, avg(CASE WHEN abs(z) <= ln(1.5) THEN 1.0 ELSE 0.0 END) AS w, exp(median(z)) AS b FROM z GROUP BY house, category), e AS (SELECT *, CASE WHEN n < 25 THEN 'few' WHEN w < 0.4 THEN 'inaccurate' WHEN b > 1.25 OR b < 1 / 1.25 THEN 'biased' END AS reason FROM c) SELECT house, category, n, round(CASE WHEN n >= 25 THEN w END, 6) AS close_share, round(CASE WHEN n >= 25 THEN b END, 6) AS bias, reason IS NULL AS open, reason FROM e")
def accuracy_gates(s, d):
    rows = _sold(s, d).withColumn("z", F.ln(F.col("price") / ((F.col("est_low") + F.col("est_high")) / 2)))
    return M.gate_cells(rows, ["house", "category"], "z", least=25, factor=1.5, share=0.4, max_bias=1.25).withColumn("close_share", r("close_share")).withColumn("bias", r("bias"))


@query("+t AS (SELECT category, day, price / est_high AS ratio FROM sold), b AS (SELECT category, quantile_cont(ratio, 0.15) AS lo, quantile_cont(ratio, 0.85) AS hi, count(*) AS n_fit FROM t WHERE day < DATE '1997-01-01' GROUP BY category HAVING count(*) >= 10) SELECT t.category, round(lo, 6) AS lo, round(hi, 6) AS hi, n_fit, count(*) AS n_test, round(avg(CASE WHEN ratio BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM t JOIN b ON t.category = b.category WHERE day >= DATE '1997-01-01' GROUP BY t.category, lo, hi, n_fit")
def band_coverage_oos(s, d):
    rows = _sold(s, d).withColumn("ratio", F.col("price") / F.col("est_high"))
    out = M.band_coverage(rows, ["category"], "ratio", F.col("day") < _day("1997-01-01"), 0.15, 0.85, 10)
    return out.select("category", r("lo").alias("lo"), r("hi").alias("hi"), "n_fit", "n_test", r("coverage").alias("coverage"))


_BLEND = """+o AS (SELECT CASE WHEN quantity > 33 THEN 'high' WHEN quantity > 16 THEN 'medium' ELSE 'low' END AS conf, house, lot_id, CAST(quantity AS BIGINT) AS weight, round(ln(est_high / est_low * (1 + discount)), 9) AS x, round(ln(price / est_low), 9) AS y FROM sold),
g AS (SELECT *, round(y - k * 0.04 * x, 9) AS res FROM o, (SELECT unnest(range(21)) AS k)),
c AS (SELECT *, sum(weight) OVER (PARTITION BY conf, k, house ORDER BY res, lot_id ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY conf, k, house) AS tot FROM g),
a AS (SELECT conf, k, house, min(res) AS a FROM c WHERE cum >= tot / 2 GROUP BY conf, k, house),
e AS (SELECT g.conf, g.k, lot_id, weight, round(abs(res - a.a), 9) AS err FROM g JOIN a ON g.conf = a.conf AND g.k = a.k AND g.house = a.house),
f AS (SELECT *, sum(weight) OVER (PARTITION BY conf, k ORDER BY err, lot_id ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY conf, k) AS tot FROM e),
h AS (SELECT conf, k, min(err) AS error FROM f WHERE cum >= tot / 2 GROUP BY conf, k)
SELECT conf, CAST(arg_min(k, (error, k)) AS DOUBLE) * 0.04 AS w, round(min(error), 6) AS error FROM h GROUP BY conf"""


@query(_BLEND)
def blend_weights(s, d):
    conf = F.when(F.col("quantity") > 33, "high").when(F.col("quantity") > 16, "medium").otherwise("low")
    rows = _sold(s, d).select(conf.alias("conf"), "house", "lot_id", F.col("quantity").cast("long").alias("weight"), F.round(F.ln(F.col("est_high") / F.col("est_low") * (1 + F.col("discount"))), 9).alias("x"), F.round(F.ln(F.col("price") / F.col("est_low")), 9).alias("y"))
    return M.blend_weights(rows, "conf", "house", "x", "y", "weight", "lot_id", steps=21, step=0.04).select("conf", r("w").alias("w"), r("error").alias("error"))


@query(
    """+n AS (SELECT category, q, count(*) AS n FROM sold GROUP BY category, q), b AS (SELECT *, median(n) OVER (PARTITION BY category ORDER BY q ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before FROM n),
l AS (SELECT category, max(q) AS last_q, arg_max(n, q) AS n_last FROM b WHERE n >= 0.7 * before GROUP BY category),
t AS (SELECT category, max(c) / sum(c) AS top FROM (SELECT category, maker, count(*) AS c FROM sold GROUP BY category, maker) GROUP BY category),
h AS (SELECT category, house, count(*) FILTER (day >= DATE '1998-01-01' AND day < DATE '1999-01-01') AS a, count(*) FILTER (day >= DATE '1997-01-01' AND day < DATE '1998-01-01') AS z FROM sold GROUP BY category, house),
w AS (SELECT category, a / sum(a) OVER (PARTITION BY category) AS sa, z / sum(z) OVER (PARTITION BY category) AS sz FROM h),
f AS (SELECT category, max(abs(sa - sz)) AS shift FROM w GROUP BY category)
SELECT t.category, last_q, n_last, round(top, 6) AS top_share, round(shift, 6) AS shift, CASE WHEN last_q IS NULL THEN 'no-complete-quarter' WHEN n_last < 8 THEN 'thin' WHEN top > 0.25 THEN 'dominated' WHEN shift >= 0.15 THEN 'composition' ELSE 'publish' END AS verdict FROM t LEFT JOIN l ON t.category = l.category LEFT JOIN f ON t.category = f.category"""
)
def publish_gates(s, d):
    rows = _sold(s, d)
    last = M.complete_quarters(rows, ["category"], "q", share=0.7)
    by_maker = rows.groupBy("category", "maker").agg(F.count("*").alias("c")).groupBy("category").agg((F.max("c") / F.sum("c")).alias("top_share"))
    shift = M.house_shift(rows, ["category"], "house", F.year("day") == 1998, F.year("day") == 1997)
    reason = R.first_reason([(F.col("last_q").isNull(), "no-complete-quarter"), (F.col("n_last") < 8, "thin"), (F.col("top_share") > 0.25, "dominated"), (F.col("shift") >= 0.15, "composition")])
    return by_maker.join(last, "category", "left").join(shift, "category", "left").select("category", "last_q", "n_last", r("top_share").alias("top_share"), r("shift").alias("shift"), F.coalesce(reason, F.lit("publish")).alias("verdict"))


@query("+v AS (SELECT category, q, median(price) AS v FROM sold GROUP BY category, q), i AS (SELECT category, q, v / first(v) OVER (PARTITION BY category ORDER BY q) AS level FROM v), w AS (SELECT category, sum(price) / (SELECT sum(price) FROM sold) AS w FROM sold GROUP BY category) SELECT q, round(exp(sum(w * ln(level)) / sum(w)), 6) AS value, count(*) AS n, round(sum(w), 6) AS coverage FROM i JOIN w ON i.category = w.category GROUP BY q HAVING count(*) >= 4 AND sum(w) >= 0.6")
def composite_index(s, d):
    from pyspark.sql import Window as W

    rows = _sold(s, d)
    levels = rows.groupBy("category", "q").agg(F.median("price").alias("v")).withColumn("level", F.col("v") / F.first("v").over(W.partitionBy("category").orderBy("q")))
    out = M.composite(levels, rows.groupBy("category").agg(F.sum("price").alias("size")), "category", "q", "level", "size", cap=0.4, least=4, coverage=0.6)
    return out.select("q", r("value").alias("value"), "n", r("coverage").alias("coverage"))


@query(f"SELECT lot_id, round(1 - price / est_low, 6) AS depth, CASE WHEN date_diff('day', DATE '{NOW}', day) <= 2 THEN 'soon' ELSE 'later' END AS shelf FROM lots WHERE status = 'upcoming' AND date_diff('day', DATE '{NOW}', day) BETWEEN 1 AND 6 AND 1 - price / est_low BETWEEN CASE WHEN date_diff('day', DATE '{NOW}', day) <= 2 THEN 0.3 ELSE 0.5 END AND 0.95")
def gap_lane(s, d):
    depth, shelf = M.gap_lane(F.datediff("day", _day(NOW)), F.col("price"), F.col("est_low"), near=(2, 0.3), far=(6, 0.5), deepest=0.95)
    return _lots(s, d).where("status = 'upcoming'").select("lot_id", r(depth).alias("depth"), shelf.alias("shelf")).where("shelf is not null")


@query(f"WITH k AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS item, event_type, count(*) AS n, max(CAST(ts AS DATE)) AS t FROM events GROUP BY ALL), c AS (SELECT user_id, item, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 4.0 END * pow(0.5, date_diff('day', t, DATE '{LAST_EVENT}') / 14.0) * least(2.0, 1 + 0.25 * (n - 1)) AS score FROM k) SELECT user_id, item, round(max(score), 6) AS score FROM c WHERE score IS NOT NULL GROUP BY user_id, item", with_lots=False)
def decayed_signals(s, d):
    rows = _events(s, d).select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item"), "event_type", F.col("ts").cast("date").alias("seen"))
    return M.decayed_signals(rows, ["user_id", "item"], "event_type", "seen", _day(LAST_EVENT), {"view": 1.0, "click": 2.0, "purchase": 4.0}, half_life_days=14, lift=0.25, most=2.0).withColumn("score", r("score"))


@query("+f AS (SELECT maker, price, unnest([{'facet': 'form', 'label': form}, {'facet': 'size', 'label': CAST(CAST(floor(size / 10) AS INT) AS VARCHAR)}], recursive := true) FROM sold), c AS (SELECT maker, facet, label, count(*) AS n, median(price) AS median FROM f GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY maker, facet) AS share FROM c) SELECT maker, facet, label, n, round(median, 6) AS median, round(share, 6) AS share FROM w WHERE n >= 3")
def facet_splits(s, d):
    out = M.facet_splits(_sold(s, d), "maker", {"form": F.col("form"), "size": F.floor(F.col("size") / 10).cast("int")}, "price", least=3)
    return out.withColumn("median", r("median")).withColumn("share", r("share"))


@query(f"""+o AS (SELECT lot_id, max({{'sold': status = 'sold' AND price > 0, 'price': price, 'status': status}}) AS o FROM lots WHERE status <> 'upcoming' GROUP BY lot_id),
p AS (SELECT house, CASE WHEN o.o.sold THEN 'hammered' WHEN o.o.status = 'bought_in' THEN 'passed' WHEN day <= DATE '{NOW}' THEN 'awaited' ELSE 'ahead' END AS state, (o.o.price / est_high - 1) * 100 AS v, (o.o.price / ((est_low + est_high) / 2) - 1) * 100 AS e, o.o.price BETWEEN est_low AND est_high AS inside FROM lots l LEFT JOIN o ON l.lot_id = o.lot_id)
SELECT house, count(*) FILTER (state = 'hammered') AS n, CASE WHEN count(*) FILTER (state = 'hammered') >= 10 THEN round(median(v) FILTER (state = 'hammered'), 6) END AS med_vs_value, CASE WHEN count(*) FILTER (state = 'hammered') >= 10 THEN round(median(e) FILTER (state = 'hammered'), 6) END AS med_vs_est, CASE WHEN count(*) FILTER (state = 'hammered') >= 10 THEN count(*) FILTER (state = 'hammered' AND inside) END AS in_range, count(*) FILTER (state = 'awaited') AS awaited, count(*) FILTER (state = 'passed') AS passed FROM p GROUP BY house""")
def pick_outcomes(s, d):
    rows = _lots(s, d)
    picks = rows.select("lot_id", "house", F.col("day").alias("close"), F.col("est_high").alias("value"), F.col("est_low").alias("low"), F.col("est_high").alias("high"), ((F.col("est_low") + F.col("est_high")) / 2).alias("est_mid"))
    resolved = M.resolve_picks(picks, rows.where("status <> 'upcoming'").select("lot_id", "status", "price"), "lot_id", _day(NOW))
    return M.summarise_picks(resolved, ["house"], 10).withColumn("med_vs_value", r("med_vs_value")).withColumn("med_vs_est", r("med_vs_est"))


@query(f"""+v AS (SELECT lot_id, price AS value, (est_low + est_high) / 2 AS mid, CASE WHEN price <= 12500 THEN price / 1.25 WHEN price <= 48500 THEN 10000 + (price - 12500) / 1.2 ELSE 40000 + (price - 48500) / 1.12 END AS expected, CASE WHEN 0.85 * price <= 12500 THEN 0.85 * price / 1.25 WHEN 0.85 * price <= 48500 THEN 10000 + (0.85 * price - 12500) / 1.2 ELSE 40000 + (0.85 * price - 48500) / 1.12 END AS max_bid FROM lots WHERE status = 'upcoming')
SELECT lot_id, round(expected, 6) AS expected, round((expected / mid - 1) * 100, 6) AS vs_est_pct, round(max_bid, 6) AS max_bid FROM v WHERE value / mid <= 5 AND value / mid >= 0.2""")
def lot_verdict(s, d):
    rows = _lots(s, d).where("status = 'upcoming'").withColumn("mid", (F.col("est_low") + F.col("est_high")) / 2)
    sane = rows.where((F.col("price") / F.col("mid") <= 5) & (F.col("price") / F.col("mid") >= 0.2))
    expected = S.marginal_inverse(F.col("price"), PREMIUM)
    return sane.select("lot_id", r(expected).alias("expected"), r((expected / F.col("mid") - 1) * 100).alias("vs_est_pct"), r(S.marginal_inverse(F.col("price") * 0.85, PREMIUM)).alias("max_bid"))


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey AS sale, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS vote FROM orders), c AS (SELECT a.id, b.vote, count(*) AS n FROM o a JOIN o b ON a.sale = b.sale AND b.id BETWEEN a.id - 3000 AND a.id + 3000 AND b.vote IS NOT NULL WHERE a.vote IS NULL GROUP BY a.id, b.vote) SELECT id, arg_min(vote, (-n, vote)) AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY id HAVING sum(n) >= 3 AND max(n) >= 0.75 * sum(n)", with_lots=False)
def neighbour_labels(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sale"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("vote"))
    return M.neighbour_labels(rows, "sale", "id", "vote", "id", 3000, 3, 0.75)


@query(f"WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last_good FROM events GROUP BY user_id) SELECT user_id, last_good, last_good IS NULL OR epoch(TIMESTAMP '{LAST_EVENT}') - floor(epoch(last_good)) > 36 * 3600 AS stale FROM l", with_lots=False)
def stale_sources(s, d):
    return M.stale_sources(_events(s, d), "user_id", "ts", F.col("event_type") != "error", F.lit(LAST_EVENT).cast("timestamp"), hours=36).withColumn("last_good", F.col("last_good").cast("timestamp_ntz"))


@query("+t AS (SELECT DISTINCT object FROM sold WHERE day < DATE '1995-03-01') SELECT lot_id, object, day FROM sold WHERE object NOT IN (SELECT object FROM t) AND day >= DATE '1995-06-01' ORDER BY day, lot_id LIMIT 500")
def incremental_targets(s, d):
    rows = _sold(s, d)
    return M.incremental_targets(rows.select("lot_id", "object", "day"), rows.where(F.col("day") < _day("1995-03-01")), "object", F.col("day") >= _day("1995-06-01"), ["day", "lot_id"], 500)


@query("WITH k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-10')) SELECT event_id, user_id FROM k WHERE n <= 20", with_lots=False)
def retention(s, d):
    rows = _events(s, d)
    return M.retained(rows, "user_id", [F.desc("ts"), F.desc("event_id")], (F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp")), 20).select("event_id", "user_id")


@query("WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS item, event_type, value, ts FROM events), c AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-20' AND event_type IN ('view', 'click')), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = c.user_id AND e.item = c.item AND e.ts < TIMESTAMP '2024-01-20')) SELECT user_id, item, event_id FROM f WHERE n <= 2", with_lots=False)
def notification_plan(s, d):
    rows = _events(s, d).select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("item"), "event_type", "value", "ts")
    cut = F.lit("2024-01-20").cast("timestamp")
    fresh = rows.where((F.col("ts") >= cut) & F.col("event_type").isin("view", "click"))
    return M.notification_plan(fresh, rows.where(F.col("ts") < cut), "user_id", ["user_id", "item"], [F.desc("value"), "event_id"], cap=2).select("user_id", "item", "event_id")


@query(f"""+a AS (SELECT maker, CASE WHEN status = 'sold' AND price > 0 THEN price END AS p, date_diff('day', day, DATE '{NOW}') AS age, status = 'upcoming' AS live FROM lots),
g AS (SELECT maker, max(p) AS record, arg_min(age, (-p, age)) FILTER (p IS NOT NULL) AS record_age, max(p) FILTER (age >= 0 AND age < 60) AS biggest, CASE WHEN count(p) FILTER (age >= 0 AND age < 365) >= 4 AND count(p) FILTER (age >= 365 AND age < 730) >= 4 THEN median(p) FILTER (age >= 0 AND age < 365) / median(p) FILTER (age >= 365 AND age < 730) - 1 END AS move, count(*) FILTER (live) AS n_live FROM a GROUP BY maker)
SELECT maker, record, CAST(record_age AS INT) AS record_age, biggest, round(move, 6) AS move, n_live, CASE WHEN record_age BETWEEN 0 AND 59 THEN 'record' WHEN abs(move) >= 0.15 THEN 'move' WHEN biggest IS NOT NULL THEN 'sale' WHEN n_live > 0 THEN 'live' END AS lead FROM g""")
def name_digest(s, d):
    sold = (F.col("status") == "sold") & (F.col("price") > 0)
    return M.name_digest(_lots(s, d), "maker", "day", "price", sold, F.col("status") == "upcoming", _day(NOW), window=60, year=365, least=4, moves=0.15).withColumn("move", r("move"))


@query()
def grade_ladder(s, d):
    rows = _sold(s, d).withColumn("grade", F.least(F.ceil(F.col("quantity") / 10), F.lit(5)).cast("int"))
    found = M.grade_ladder(rows, "object", "grade", "price", [1, 2, 3, 4, 5], 3, least_cell=1, least_pairs=4)
    return s.createDataFrame([(g, v) for g, v in found.items()], "grade int, multiplier double")
