"""Registered queries of valuation, ledgers and reports; imported by the catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import market as M
from ..operators import series as Q
from ..operators import stats as A
from ..operators import valuation as V
from ..session import table
from .catalogue import PREMIUM, _events, _lots, _sold, query, r

NOW, LAST_EVENT = "1998-12-31", "2024-01-31"
RULES = V.Rules(least=3, top=8, half_life_days=700.0, share=0.4, carry=(0.6, 1.7), spread=1.4, scale=4.0, weights={"high": 0.7, "medium": 0.5, "low": 0.3}, signal=0.1, margin=0.85)


def _day(text: str):
    return F.lit(text).cast("date")


def _inverse(x: str) -> str:
    return f"CASE WHEN {x} <= 12500 THEN {x} / 1.25 WHEN {x} <= 48500 THEN 10000 + ({x} - 12500) / 1.2 ELSE 40000 + ({x} - 48500) / 1.12 END"


def _capped(src: str, p: str, value: str, name: str) -> str:
    """CTEs of the capped weighted median of ``value`` by target in ``src`` (columns target, comp, w)."""
    return f"""{p}1 AS (SELECT target, comp, {value} AS v, w, sum(w) OVER (PARTITION BY target) AS total, sum(w) OVER o AS upto, row_number() OVER (PARTITION BY target ORDER BY w DESC, comp) AS k, count(*) OVER (PARTITION BY target) AS n FROM {src} WINDOW o AS (PARTITION BY target ORDER BY w DESC, comp ROWS UNBOUNDED PRECEDING)),
{p}2 AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY target ORDER BY k), 0) AS nw FROM {p}1),
{p}3 AS (SELECT target, min(k) FILTER (k * 0.4 < 1 AND nw * (1 - k * 0.4) <= 0.4 * (total - upto)) AS cut, max(w) AS top FROM {p}2 GROUP BY target),
{p}4 AS (SELECT a.*, cut, top, max(total - upto) FILTER (k = cut) OVER (PARTITION BY a.target) AS rest FROM {p}2 a JOIN {p}3 b ON a.target = b.target),
{p}5 AS (SELECT target, v, sum(CASE WHEN n * 0.4 <= 1 THEN 1.0 / n WHEN top <= 0.4 * total THEN w / total WHEN k <= cut THEN 0.4 ELSE w * (1 - cut * 0.4) / rest END) OVER (PARTITION BY target ORDER BY v, comp ROWS UNBOUNDED PRECEDING) AS cum FROM {p}4),
{p} AS (SELECT target, min(v) AS {name} FROM {p}5 WHERE cum >= 0.5 - 1e-9 GROUP BY target)"""


_VALUED = f"""+x AS (SELECT lot_id, object, CAST(floor(quantity / 10) AS INT) AS band, category, day, CAST(year(day) * 4 + quarter(day) - 1 AS INT) AS q, price, (est_low + est_high) / 2 AS mid, status FROM lots),
lv AS (SELECT category, q, median(price / mid) AS level FROM x WHERE status = 'sold' AND price > 0 GROUP BY category, q),
cal AS (SELECT category, unnest(range(min(q), 8009)) AS q FROM lv GROUP BY category),
ff AS (SELECT c.category, c.q, last_value(level IGNORE NULLS) OVER (PARTITION BY c.category ORDER BY c.q ROWS UNBOUNDED PRECEDING) AS level FROM cal c LEFT JOIN lv ON c.category = lv.category AND c.q = lv.q),
pr AS (SELECT t.lot_id AS target, c.lot_id AS comp, t.category, t.q AS tq, c.q AS cq, t.day AS tday, c.day AS cday, c.price, t.band = c.band AS strict, count(*) FILTER (t.band = c.band) OVER (PARTITION BY t.lot_id) AS ns FROM x t JOIN x c ON t.object = c.object AND c.day < t.day WHERE t.status = 'upcoming' AND c.status = 'sold' AND c.price > 0),
po AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cday DESC, comp) AS rn FROM pr WHERE strict OR ns < 3),
w AS (SELECT po.target, po.comp, po.price, CASE WHEN ns >= 3 THEN 'strict' ELSE 'wide' END AS path, po.price * coalesce(greatest(0.6, least(1.7, a.level / b.level)), 1.0) AS carried, round(pow(0.5, date_diff('day', cday, tday) / 700.0), 9) AS w FROM po LEFT JOIN ff a ON a.category = po.category AND a.q = tq - 1 LEFT JOIN ff b ON b.category = po.category AND b.q = least(cq, tq - 1) WHERE rn <= 8),
st AS (SELECT target, path, count(*) AS n, (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) AS spread, quantile_cont(carried, 0.15) AS low, quantile_cont(carried, 0.85) AS high FROM w GROUP BY target, path),
{_capped("w", "ra", "price", "raw")},
{_capped("w", "va", "carried", "value")},
j AS (SELECT x.lot_id, x.mid, st.*, ra.raw, va.value, CASE WHEN n IS NULL THEN 'none' WHEN n < 3 THEN 'thin' WHEN spread > 1.4 THEN 'dispersed' WHEN value / mid > 4 OR value / mid < 0.25 THEN 'scale' END AS reason FROM x LEFT JOIN st ON x.lot_id = st.target LEFT JOIN ra ON x.lot_id = ra.target LEFT JOIN va ON x.lot_id = va.target WHERE x.status = 'upcoming'),
k AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN n >= 6 AND spread <= 0.7 THEN 'high' WHEN path = 'strict' THEN 'medium' ELSE 'low' END END AS confidence FROM j),
bl AS (SELECT *, CASE WHEN reason IS NULL THEN mid * exp(CASE confidence WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.5 ELSE 0.3 END * ln(value / mid)) END AS blend FROM k)"""


def _valued(s, d):
    rows = _lots(s, d).withColumn("band", F.floor(F.col("quantity") / 10).cast("int")).withColumn("q", S.quarter_ordinal(F.col("day"))).withColumn("est_mid", (F.col("est_low") + F.col("est_high")) / 2)
    done = rows.where("status = 'sold' and price > 0")
    levels = done.groupBy("category", "q").agg(F.median(F.col("price") / F.col("est_mid")).alias("level"))
    return V.value_lots(rows.where("status = 'upcoming'"), done, V.level_calendar(levels, ["category"], "q", "level", 8008), "object", "band", "category", RULES, PREMIUM)


@query(_VALUED + f" SELECT lot_id, coalesce(n, 0) AS n, path, reason, confidence, CASE WHEN reason IS NULL THEN round(raw + 1e-7, 4) END AS raw, CASE WHEN reason IS NULL THEN round(value + 1e-7, 4) END AS value, CASE WHEN reason IS NULL THEN round(low + 1e-7, 4) END AS low, CASE WHEN reason IS NULL THEN round(high + 1e-7, 4) END AS high, round(blend + 1e-7, 4) AS blend, CASE WHEN blend / mid > 1.1 THEN 'above' WHEN blend / mid < 0.9 THEN 'below' WHEN blend IS NOT NULL THEN 'fair' END AS signal, round({_inverse('blend')} + 1e-7, 4) AS hammer, round({_inverse('(0.85 * blend)')} + 1e-7, 4) AS max_bid FROM bl")
def valuation(s, d):
    out = _valued(s, d)
    return out.select("lot_id", "n", "path", "reason", "confidence", "signal", *[r(F.col(c) + 1e-7, 4).alias(c) for c in ("raw", "value", "low", "high", "blend", "hammer", "max_bid")])


@query(_VALUED + " SELECT coalesce(reason, 'valued') AS reason, count(*) AS n FROM k GROUP BY 1")
def abstain_reasons(s, d):
    return _valued(s, d).groupBy(F.coalesce("reason", F.lit("valued")).alias("reason")).agg(F.count("*").alias("n"))


@query(_VALUED + " SELECT lot_id, round(greatest(blend, 0.95 * price), 4) AS floored, CASE WHEN 1.25 * price > blend * 1.15 THEN 'over' WHEN 1.25 * price < blend * 0.85 THEN 'under' WHEN blend IS NOT NULL THEN 'at' END AS bid FROM bl JOIN (SELECT lot_id AS l, price FROM lots) p ON bl.lot_id = p.l WHERE blend IS NOT NULL")
def bid_reads(s, d):
    rows = _valued(s, d).where("blend is not null").select("lot_id", "blend").join(_lots(s, d).select("lot_id", "price"), "lot_id")
    return rows.select("lot_id", r(V.floor_at_bid(F.col("blend"), 0.95 * F.col("price")), 4).alias("floored"), V.bid_read(1.25 * F.col("price"), F.col("blend"), 0.15).alias("bid"))


@query("+b AS (SELECT *, count(*) FILTER (day >= DATE '1997-01-01') OVER (PARTITION BY maker, form) AS recent FROM sold), k AS (SELECT *, row_number() OVER (PARTITION BY maker, form ORDER BY day DESC, lot_id) AS n FROM b WHERE recent < 5 OR day >= DATE '1997-01-01'), g AS (SELECT maker, form, count(*) AS n, quantile_cont(price, 0.2) AS low, median(price) AS mid, quantile_cont(price, 0.8) AS high, (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) AS spread FROM k WHERE n <= 40 GROUP BY maker, form) SELECT maker, form, n, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high FROM g WHERE n >= 5 AND spread <= 2")
def maker_reference_band(s, d):
    out = V.newest_band(_sold(s, d), ["maker", "form"], "day", "price", "lot_id", 5, 40, _day("1997-01-01"), 2.0, (0.2, 0.8))
    return out.select("maker", "form", "n", *[r(c).alias(c) for c in ("low", "mid", "high")])


@query("+b AS (SELECT *, count(*) FILTER (day >= DATE '1996-01-01') OVER (PARTITION BY object) AS recent FROM sold), k AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY day DESC, lot_id) AS n FROM b WHERE recent < 3 OR day >= DATE '1996-01-01'), g AS (SELECT object, count(*) AS n, min(price) AS low, median(price) AS mid, max(price) AS high, (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) AS spread FROM k WHERE n <= 20 GROUP BY object) SELECT object, n, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high FROM g WHERE n >= 3 AND spread <= 3")
def object_band(s, d):
    out = V.newest_band(_sold(s, d), ["object"], "day", "price", "lot_id", 3, 20, _day("1996-01-01"), 3.0, (0.0, 1.0))
    return out.select("object", "n", *[r(c).alias(c) for c in ("low", "mid", "high")])


@query("+p AS (SELECT lot_id, price / est_low AS x FROM lots) SELECT lot_id, round(CASE WHEN x <= 1.2 THEN x ELSE sqrt(1.2 * (2 * x - 1.2)) END, 6) AS k FROM p")
def projection_knee(s, d):
    return _lots(s, d).select("lot_id", r(V.knee(F.col("price") / F.col("est_low"), 1.2)).alias("k"))


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(floor(l_extendedprice / 100) AS BIGINT) AS price, floor(l_extendedprice / 100) >= 50 AND round(50 * pow(1.1, round(ln(floor(l_extendedprice / 100) / 50) / ln(1.1)))) = floor(l_extendedprice / 100) AS rung FROM lineitem WHERE l_extendedprice >= 100", with_lots=False)
def percent_ladder(s, d):
    price = F.floor(F.col("l_extendedprice") / 100)
    return table(s, d, "lineitem").where("l_extendedprice >= 100").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), price.alias("price"), V.on_ladder(price.cast("double"), 50.0, 0.1).alias("rung"))


@query(f"SELECT lot_id, round(CASE WHEN day >= DATE '1997-07-01' THEN price * 1.3 WHEN day >= DATE '1996-01-01' THEN price * 1.2 + least(price, 20000) * 0.05 ELSE price + least(price, 10000) * 0.25 + greatest(least(price, 40000) - 10000, 0) * 0.2 + greatest(price - 40000, 0) * 0.12 END, 6) AS all_in FROM sold")
def era_premium(s, d):
    eras = [("1900-01-01", PREMIUM), ("1996-01-01", [(0.0, 0.25), (20_000.0, 0.2)]), ("1997-07-01", [(0.0, 0.3)])]
    return _sold(s, d).select("lot_id", r(V.dated(F.col("price"), F.col("day"), eras)).alias("all_in"))


@query("+o AS (SELECT category, q, CAST(floor(least(price / est_low, 1.99) * 2) AS INT) AS bucket, CAST(price > est_high AS INT) AS hit FROM sold), c AS (SELECT category, bucket, q, count(*) AS c, sum(hit) AS h FROM o GROUP BY ALL), e AS (SELECT q, sum(c) AS c, sum(h) AS h FROM c GROUP BY q), p AS (SELECT q, sum(h) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(c) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e), b AS (SELECT category, bucket, q, sum(c) OVER w AS n, sum(h) OVER w AS x FROM c WINDOW w AS (PARTITION BY category, bucket ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT category, bucket, b.q, CAST(n AS BIGINT) AS n, round((x + 30 * p) / (n + 30), 6) AS rate FROM b JOIN p ON b.q = p.q WHERE n > 0")
def replay_calibration(s, d):
    rows = _sold(s, d).select("category", "q", F.floor(F.least(F.col("price") / F.col("est_low"), F.lit(1.99)) * 2).cast("int").alias("bucket"), (F.col("price") > F.col("est_high")).cast("int").alias("hit"))
    return V.rates_before(rows, ["category", "bucket"], "q", "hit", 30).select("category", "bucket", "q", "n", r("rate").alias("rate"))


@query("+m AS (SELECT a.lot_id, a.status, a.price, a.est_high, a.est_low, count(b.price) AS n, median(b.price) AS prior FROM lots a JOIN sold b ON a.object = b.object AND b.day < a.day WHERE a.status <> 'upcoming' GROUP BY ALL HAVING count(b.price) >= 2), f AS (SELECT *, prior > 1.1 * (est_low + est_high) / 2 AS flagged FROM m) SELECT flagged, count(*) AS n, count(*) FILTER (status = 'sold') AS n_sold, round(median(price / est_high - 1) FILTER (status = 'sold'), 6) AS perf, round(avg(CASE WHEN price > est_high THEN 1.0 ELSE 0.0 END) FILTER (status = 'sold'), 6) AS beat, round(avg(CASE WHEN status = 'bought_in' THEN 1.0 ELSE 0.0 END), 6) AS failed, round(avg(CASE WHEN status = 'sold' AND price > est_high THEN 1.0 ELSE 0.0 END), 6) AS honest_beat FROM f GROUP BY flagged")
def flagged_outcomes(s, d):
    every = _lots(s, d).where("status <> 'upcoming'")
    prior = W.partitionBy("object").orderBy(F.unix_date("day")).rangeBetween(W.unboundedPreceding, -1)
    price = F.when((F.col("status") == "sold") & (F.col("price") > 0), F.col("price"))
    rows = every.withColumn("p", price).withColumn("n", F.count("p").over(prior)).withColumn("prior", F.percentile("p", F.lit(0.5)).over(prior)).where("n >= 2")
    sold, beat = F.col("status") == "sold", F.col("price") > F.col("est_high")
    flagged = rows.withColumn("flagged", F.col("prior") > 1.1 * (F.col("est_low") + F.col("est_high")) / 2)
    return flagged.groupBy("flagged").agg(F.count("*").alias("n"), F.count_if(sold).alias("n_sold"), r(F.median(F.when(sold, F.col("price") / F.col("est_high") - 1))).alias("perf"), r(F.avg(F.when(sold, beat.cast("double")))).alias("beat"), r(F.avg((F.col("status") == "bought_in").cast("double"))).alias("failed"), r(F.avg((sold & beat).cast("double"))).alias("honest_beat"))


@query("SELECT house, CAST(year(day) * 4 + quarter(day) - 1 AS INT) AS q, count(*) FILTER (status = 'bought_in') AS unsold, count(*) AS offered FROM lots WHERE status <> 'upcoming' GROUP BY ALL HAVING count(*) FILTER (status = 'bought_in') >= 4")
def unsold_cells(s, d):
    rows = _lots(s, d).where("status <> 'upcoming'").withColumn("q", S.quarter_ordinal(F.col("day")))
    return rows.groupBy("house", "q").agg(F.count_if(F.col("status") == "bought_in").alias("unsold"), F.count("*").alias("offered")).where("unsold >= 4")


@query("WITH k AS (SELECT user_id, event_type, floor(value / 10) AS v, row_number() OVER w AS n, lag(floor(value / 10)) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), c AS (SELECT * FROM k WHERE n = 1 OR v <> was) SELECT user_id, event_type, CAST(arg_min(v, n) AS BIGINT) AS first, CAST(arg_max(v, n) AS BIGINT) AS last_changed, count(*) - 1 AS changes FROM c GROUP BY user_id, event_type", with_lots=False)
def tape_append(s, d):
    return V.tape(_events(s, d).withColumn("v", F.floor(F.col("value") / 10)), ["user_id", "event_type"], ["ts", "event_id"], "v")


@query(f"+e AS (SELECT house, category, date_diff('day', day, DATE '{NOW}') AS age, abs(ln(price / ((est_low + est_high) / 2))) AS e FROM sold), g AS (SELECT house, category, count(*) FILTER (age < 180) AS n_now, count(*) FILTER (age >= 180 AND age < 900) AS n_then, median(e) FILTER (age < 180) AS a, median(e) FILTER (age >= 180 AND age < 900) AS b FROM e WHERE age >= 0 GROUP BY house, category) SELECT house, category, n_now, n_then, round(a, 6) AS error_now, round(b, 6) AS error_then, coalesce(n_now >= 3 AND n_then >= 3 AND a > 1.1 * b, false) AS alert FROM g")
def drift_alerts(s, d):
    rows = _sold(s, d).select("house", "category", F.datediff(_day(NOW), "day").alias("age"), F.abs(F.ln(F.col("price") / ((F.col("est_low") + F.col("est_high")) / 2))).alias("e"))
    return V.drift(rows, ["house", "category"], "age", "e", 180, 720, 3, 1.1).withColumn("error_now", r("error_now")).withColumn("error_then", r("error_then"))


@query("+p AS (SELECT a.lot_id, a.category, a.price, (a.est_low + a.est_high) / 2 AS one, median(b.price) AS other FROM sold a LEFT JOIN sold b ON a.object = b.object AND b.day < a.day GROUP BY ALL), e AS (SELECT category, abs(ln(one / price)) AS a, abs(ln(other / price)) AS b FROM p WHERE other IS NOT NULL) SELECT category, count(*) AS n, round(median(a), 6) AS error_one, round(median(b), 6) AS error_other, round(avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END), 6) AS nearer FROM e GROUP BY category")
def compare_engines(s, d):
    from ..operators import joins as J

    rows = J.prior_median(_sold(s, d), ["object"], "day", "price").select("category", "price", ((F.col("est_low") + F.col("est_high")) / 2).alias("one"), F.col("median_prior").alias("other"))
    return V.compared(rows, ["category"], "price", "one", "other").select("category", "n", *[r(c).alias(c) for c in ("error_one", "error_other", "nearer")])


@query("+o AS (SELECT a.lot_id, any_value(a.price) AS price, date_diff('day', any_value(a.day), DATE '2001-12-31') // 730 AS cohort, count(b.price) AS n, median(b.price) AS m FROM sold a LEFT JOIN sold b ON a.object = b.object AND a.lot_id <> b.lot_id GROUP BY a.lot_id) SELECT cohort, count(*) AS n, count(*) FILTER (n >= 3) AS valued, round(median(abs(ln(m / price))) FILTER (n >= 3), 6) AS error FROM o GROUP BY cohort")
def settled_appraisal(s, d):
    rows = V.leave_one_out(_sold(s, d), ["object"], "price", "lot_id", "m", 3)
    return rows.groupBy(F.floor(F.datediff(_day("2001-12-31"), "day") / 730).alias("cohort")).agg(F.count("*").alias("n"), F.count("m").alias("valued"), r(F.median(F.abs(F.ln(F.col("m") / F.col("price"))))).alias("error"))


@query("+a AS (SELECT category, form, median(price / est_low) AS v FROM sold WHERE day < DATE '1998-01-01' GROUP BY ALL), b AS (SELECT category, form, median(price / est_low) AS v FROM sold WHERE day >= DATE '1998-01-01' GROUP BY ALL), j AS (SELECT coalesce(a.category, b.category) AS category, coalesce(a.form, b.form) AS form, a.v AS was, b.v AS is_now, b.v / a.v - 1 AS change FROM a FULL JOIN b ON a.category = b.category AND a.form = b.form) SELECT category, form, round(was, 6) AS was, round(is_now, 6) AS is_now, round(change, 6) AS change FROM j WHERE was IS NULL OR is_now IS NULL OR abs(change) >= 0.05")
def cells_moved(s, d):
    rows, cell = _sold(s, d), lambda x: x.groupBy("category", "form").agg(F.median(F.col("price") / F.col("est_low")).alias("v"))
    out = V.cells_moved(cell(rows.where("day < date '1998-01-01'")), cell(rows.where("day >= date '1998-01-01'")), ["category", "form"], "v", 0.05)
    return out.select("category", "form", *[r(c).alias(c) for c in ("was", "is_now", "change")])


@query("+s AS (SELECT category, ln(price) AS v, CASE WHEN q > 7988 AND q <= 7992 THEN 'now' WHEN q > 7984 AND q <= 7988 THEN 'then' END AS side FROM sold), m AS (SELECT category, side, count(*) AS n, median(v) AS m, 1.2533 * stddev_samp(v) / sqrt(count(*)) AS se FROM s WHERE side IS NOT NULL GROUP BY category, side), p AS (SELECT a.category, a.n AS n_now, b.n AS n_then, a.m - b.m AS move, sqrt(a.se * a.se + b.se * b.se) AS se FROM m a JOIN m b ON a.category = b.category WHERE a.side = 'now' AND b.side = 'then') SELECT category, n_now, n_then, round(exp(move) - 1, 6) AS yoy, round(exp(move - 1.96 * se) - 1, 6) AS low, round(exp(move + 1.96 * se) - 1, 6) AS high, CASE WHEN least(n_now, n_then) < 8 THEN 'thin' WHEN 1.96 * se > 0.6 THEN 'wide' WHEN abs(move) < 1.96 * se THEN 'flat' ELSE 'publish' END AS verdict FROM p")
def yoy_published(s, d):
    out = Q.two_sample_yoy(_sold(s, d), ["category"], "price", 7992, least=8, widest=0.6)
    return out.select("category", "n_now", "n_then", *[r(c).alias(c) for c in ("yoy", "low", "high")], "verdict")


_RECENT = f"+w AS (SELECT house, category, lot_id, round(ln(price / est_high), 9) AS e, round(pow(0.5, date_diff('day', day, DATE '{NOW}') / 500.0), 9) AS w FROM sold WHERE day <= DATE '{NOW}')"


def _median_sql(keys: str, name: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"{name} AS (SELECT {keys + ', ' if keys else ''}min(e) AS m, any_value(t) AS t FROM (SELECT *, sum(w) OVER ({part} ORDER BY e, lot_id ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER ({part}) AS t FROM w) WHERE c >= t / 2 {'GROUP BY ' + keys if keys else ''})"


@query(f"{_RECENT}, {_median_sql('', 'g')}, {_median_sql('house', 'h')}, {_median_sql('house, category', 'c')}, hs AS (SELECT house, (h.t * h.m + 20 * g.m) / (h.t + 20) AS m FROM h, g) SELECT c.house, category, round(exp((c.t * c.m + 20 * hs.m) / (c.t + 20)), 6) AS factor FROM c JOIN hs ON c.house = hs.house")
def house_bias_recent(s, d):
    rows = _sold(s, d).where(F.col("day") <= _day(NOW)).select("house", "category", "lot_id", F.round(F.ln(F.col("price") / F.col("est_high")), 9).alias("e"), F.round(S.half_life(F.datediff(_day(NOW), "day"), 500.0), 9).alias("w"), F.lit(0).alias("all"))
    cell = lambda keys, m, t: A.weighted_median(rows, keys, "e", "w", "lot_id", m).join(rows.groupBy(*keys).agg(F.sum("w").alias(t)), keys)
    top = cell(["all"], "m0", "t0").select("m0")
    house = cell(["house"], "m1", "t1").crossJoin(F.broadcast(top)).select("house", A.shrunk(F.col("m1"), F.col("t1"), F.col("m0"), 20).alias("m1"))
    return cell(["house", "category"], "m", "t").join(house, "house").select("house", "category", r(F.exp(A.shrunk(F.col("m"), F.col("t"), F.col("m1"), 20))).alias("factor"))


@query("+k AS (SELECT * FROM sold WHERE day < DATE '1998-04-01' AND q >= 7993 - 16 AND q < 7993), o AS (SELECT house, category, median(price) AS own FROM k GROUP BY house, category), c AS (SELECT house, category, q, median(price) AS m, count(*) AS n FROM k GROUP BY house, category, q HAVING count(*) >= 2), l AS (SELECT c.house, q, exp(avg(ln(m / own))) AS v, count(*) AS n_cohorts, CAST(sum(n) AS BIGINT) AS n FROM c JOIN o ON c.house = o.house AND c.category = o.category GROUP BY c.house, q HAVING count(*) >= 2), z AS (SELECT house, q, n_cohorts, n, avg(v) OVER (PARTITION BY house ORDER BY q ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM l) SELECT house, q, round(100 * v / first_value(v) OVER (PARTITION BY house ORDER BY q), 6) AS value, n_cohorts, n, max(q) OVER (PARTITION BY house) AS last_q FROM z")
def time_index_asof(s, d):
    return Q.index_as_of(_sold(s, d), ["house"], ["category"], "price", "day", _day("1998-04-01"), 7993, quarters=16, least=2, cohorts=2).withColumn("value", r("value"))


@query(f"+a AS (SELECT maker, house, price, date_diff('day', day, DATE '{NOW}') AS age, q FROM sold WHERE day <= DATE '{NOW}'), h AS (SELECT maker, house, count(*) AS c FROM a GROUP BY ALL), t AS (SELECT maker, max(c) / sum(c) AS top_house FROM h GROUP BY maker) SELECT a.maker, count(*) AS n, count(*) FILTER (age < 365) AS n12, round(avg(price) FILTER (age < 365), 6) AS mean12, round(median(price) FILTER (age < 365), 6) AS median12, max(price) AS record, round(sum(price), 2) AS revenue, round(pow(median(price) FILTER (age < 365) / median(price) FILTER (age >= 1095 AND age < 1460), 1 / 3.0) - 1, 6) AS cagr, round(any_value(top_house), 6) AS top_house FROM a JOIN t ON a.maker = t.maker GROUP BY a.maker")
def maker_summary(s, d):
    rows = _sold(s, d).where(F.col("day") <= _day(NOW)).withColumn("age", F.datediff(_day(NOW), "day"))
    top = rows.groupBy("maker", "house").agg(F.count("*").alias("c")).groupBy("maker").agg(r(F.max("c") / F.sum("c")).alias("top_house"))
    year = F.when(F.col("age") < 365, F.col("price"))
    old = F.when((F.col("age") >= 1095) & (F.col("age") < 1460), F.col("price"))
    figures = rows.groupBy("maker").agg(F.count("*").alias("n"), F.count(year).alias("n12"), r(F.avg(year)).alias("mean12"), r(F.median(year)).alias("median12"), F.max("price").alias("record"), r(F.sum("price"), 2).alias("revenue"), r(F.pow(F.median(year) / F.median(old), F.lit(1 / 3)) - 1).alias("cagr"))
    return figures.join(top, "maker")


@query("+q AS (SELECT q, count(*) AS n, sum(price) AS revenue, median(price) AS m, count(*) FILTER (price > est_high) AS beat FROM sold GROUP BY q), p AS (SELECT maker, q, max(price) AS top FROM sold GROUP BY maker, q), f AS (SELECT q, top > max(top) OVER (PARTITION BY maker ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rec FROM p), n AS (SELECT q, count(*) FILTER (rec) AS records FROM f GROUP BY q) SELECT a.q, a.n, round(a.revenue, 2) AS revenue, round(a.m, 6) AS median, a.beat, n.records, round(a.m / b.m - 1, 6) AS yoy FROM q a JOIN n ON a.q = n.q LEFT JOIN q b ON b.q = a.q - 4")
def quarter_report(s, d):
    rows = _sold(s, d)
    by = rows.groupBy("q").agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("revenue"), F.median("price").alias("m"), F.count_if(F.col("price") > F.col("est_high")).alias("beat"))
    before = W.partitionBy("maker").orderBy("q").rowsBetween(W.unboundedPreceding, -1)
    records = rows.groupBy("maker", "q").agg(F.max("price").alias("top")).withColumn("rec", F.col("top") > F.max("top").over(before)).groupBy("q").agg(F.count_if("rec").alias("records"))
    # one row a quarter from here on
    last = by.select((F.col("q") + 4).alias("q"), F.col("m").alias("was"))
    return by.join(records, "q").join(last, "q", "left").select("q", "n", "revenue", r("m").alias("median"), "beat", "records", r(F.col("m") / F.col("was") - 1).alias("yoy"))


@query("+g AS (SELECT category, count(*) AS n, median(price) AS m, (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) AS spread FROM sold GROUP BY category) SELECT count(*) FILTER (n >= 20 AND spread <= 1.2) AS passed_a, count(*) FILTER (n >= 10 AND spread <= 1.1) AS passed_b, count(*) FILTER ((n >= 20 AND spread <= 1.2) AND NOT (n >= 10 AND spread <= 1.1)) AS lost, count(*) FILTER (NOT (n >= 20 AND spread <= 1.2) AND (n >= 10 AND spread <= 1.1)) AS gained FROM g")
def gate_ab(s, d):
    g = _sold(s, d).groupBy("category").agg(F.count("*").alias("n"), ((A.quantile("price", 0.75) - A.quantile("price", 0.25)) / F.median("price")).alias("spread"))
    return M.gates_compared(g, (F.col("n") >= 20) & (F.col("spread") <= 1.2), (F.col("n") >= 10) & (F.col("spread") <= 1.1))


@query(f"+c AS (SELECT category, count(*) AS n, count(*) FILTER (day > DATE '{NOW}' - 365 AND day <= DATE '{NOW}') AS fresh FROM sold GROUP BY category) SELECT category, n, fresh, CASE WHEN n < 15 THEN 'thin' WHEN fresh < 2 THEN 'stale' ELSE 'ok' END AS verdict FROM c")
def coverage_gate(s, d):
    recent = (F.col("day") > F.date_sub(_day(NOW), 365)) & (F.col("day") <= _day(NOW))
    c = _sold(s, d).groupBy("category").agg(F.count("*").alias("n"), F.count_if(recent).alias("fresh"))
    return c.withColumn("verdict", F.when(F.col("n") < 15, "thin").when(F.col("fresh") < 2, "stale").otherwise("ok"))


@query("WITH c AS (SELECT user_id, event_type, event_id, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'click')), o AS (SELECT user_id, max(value) AS top FROM events WHERE event_type = 'purchase' GROUP BY user_id), g AS (SELECT c.*, top, abs(ln(value / top)) AS e FROM c LEFT JOIN o ON c.user_id = o.user_id AND top > 0 WHERE n = 1 AND value > 0) SELECT event_type AS product, count(*) AS calls, count(top) AS graded, round(median(e), 6) AS error, round(avg(CASE WHEN top > value THEN 1.0 ELSE 0.0 END) FILTER (top IS NOT NULL), 6) AS beat FROM g GROUP BY event_type", with_lots=False)
def calls_summary(s, d):
    from ..operators import records as R

    e = _events(s, d)
    calls = R.keep_first(e.where("event_type in ('view', 'click')"), ["user_id", "event_type"], ["ts", "event_id"]).where("value > 0")
    outcome = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("top")).where("top > 0")
    graded = calls.join(outcome, "user_id", "left")
    return graded.groupBy(F.col("event_type").alias("product")).agg(F.count("*").alias("calls"), F.count("top").alias("graded"), r(F.median(F.abs(F.ln(F.col("value") / F.col("top"))))).alias("error"), r(F.avg(F.when(F.col("top").isNotNull(), (F.col("top") > F.col("value")).cast("double")))).alias("beat"))


@query(f"+p AS (SELECT object, CASE WHEN tax > 0.04 THEN 'a' ELSE 'b' END AS variant, price, day, q FROM sold), v AS (SELECT object, max(c) / sum(c) AS purity, arg_max(variant, (c, variant)) AS lead FROM (SELECT object, variant, count(*) AS c FROM p GROUP BY ALL) GROUP BY object), k AS (SELECT p.*, purity FROM p JOIN v ON p.object = v.object AND (purity < 0.7 OR variant = lead)) SELECT object, count(*) AS n, count(*) FILTER (day > DATE '{NOW}' - 365 AND day <= DATE '{NOW}') AS n12, round(any_value(purity), 6) AS purity, CASE WHEN any_value(purity) < 0.7 THEN 'mixed' WHEN count(*) < 3 THEN 'thin' ELSE 'ok' END AS reason, CASE WHEN any_value(purity) >= 0.7 AND count(*) >= 3 THEN round(median(price), 6) END AS value, CASE WHEN count(*) >= 4 THEN round(regr_slope(ln(price), q) * 4, 6) END AS trend FROM k GROUP BY object")
def pure_value_book(s, d):
    rows = _sold(s, d).withColumn("variant", F.when(F.col("tax") > 0.04, "a").otherwise("b"))
    counts = rows.groupBy("object", "variant").agg(F.count("*").alias("c"))
    lead = counts.groupBy("object").agg((F.max("c") / F.sum("c")).alias("purity"), F.max_by("variant", F.struct("c", "variant")).alias("lead"))
    kept = rows.join(lead, "object").where((F.col("purity") < 0.7) | (F.col("variant") == F.col("lead")))
    recent = (F.col("day") > F.date_sub(_day(NOW), 365)) & (F.col("day") <= _day(NOW))
    out = kept.groupBy("object").agg(F.count("*").alias("n"), F.count_if(recent).alias("n12"), F.max("purity").alias("p"), F.median("price").alias("m"), F.regr_slope(F.ln("price"), F.col("q").cast("double")).alias("slope"))
    reason = F.when(F.col("p") < 0.7, "mixed").when(F.col("n") < 3, "thin").otherwise("ok")
    return out.select("object", "n", "n12", r("p").alias("purity"), reason.alias("reason"), F.when(reason == "ok", r("m")).alias("value"), F.when(F.col("n") >= 4, r(F.col("slope") * 4)).alias("trend"))


@query("+t AS (SELECT category, CASE WHEN quantity > 33 THEN 'high' WHEN quantity > 16 THEN 'medium' ELSE 'low' END AS tier, price / est_high AS x FROM sold), a AS (SELECT tier, quantile_cont(x, 0.15) AS lo, quantile_cont(x, 0.85) AS hi, exp(median(abs(ln(x)))) - 1 AS e FROM t GROUP BY tier), c AS (SELECT category, tier, count(*) AS n, quantile_cont(x, 0.15) AS lo, quantile_cont(x, 0.85) AS hi, exp(median(abs(ln(x)))) - 1 AS e FROM t GROUP BY category, tier) SELECT category, c.tier, n, round(CASE WHEN n >= 12 THEN c.lo ELSE a.lo END, 6) AS lo, round(CASE WHEN n >= 12 THEN c.hi ELSE a.hi END, 6) AS hi, round(CASE WHEN n >= 12 THEN c.e ELSE a.e END, 6) AS error FROM c JOIN a ON c.tier = a.tier")
def tier_bands(s, d):
    tier = F.when(F.col("quantity") > 33, "high").when(F.col("quantity") > 16, "medium").otherwise("low")
    t = _sold(s, d).select("category", tier.alias("tier"), (F.col("price") / F.col("est_high")).alias("x"))
    figures = lambda p: [A.quantile("x", 0.15).alias(f"{p}lo"), A.quantile("x", 0.85).alias(f"{p}hi"), (F.exp(F.median(F.abs(F.ln("x")))) - 1).alias(f"{p}error")]
    own = t.groupBy("category", "tier").agg(F.count("*").alias("n"), *figures(""))
    whole = t.groupBy("tier").agg(*figures("a_"))  # three rows
    return own.join(whole, "tier").select("category", "tier", "n", *[r(F.when(F.col("n") >= 12, F.col(c)).otherwise(F.col(f"a_{c}"))).alias(c) for c in ("lo", "hi", "error")])
