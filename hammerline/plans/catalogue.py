"""Registered queries of the analytics operators and their SQL oracles.

Every query reads whole tables. Doubles are rounded to six places, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import records as R
from ..operators import series as Q
from ..operators import stats as A
from ..operators.similarity import text_similarity
from ..session import table
from ..sources.lots import LOTS_SQL, lots, sold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Our own sample premium schedule: lower limit and marginal rate.
PREMIUM = [(0.0, 0.25), (10_000.0, 0.2), (40_000.0, 0.12)]
EDGES = [0.0, 1000.0, 5000.0, 10_000.0, 25_000.0, 50_000.0, 75_000.0]
LAST_Q = 1998 * 4 + 1


def query(sql: str | None = None, with_lots: bool = True) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if sql.startswith("RECURSIVE") else ""
            body = sql.removeprefix("RECURSIVE")
            ORACLE_SQL[f.__name__] = f"WITH {recursive}{LOTS_SQL}{', ' if body.startswith('+') else ' '}{body.removeprefix('+')}" if with_lots else sql
        return f

    return register


def _lots(s: SparkSession, d: str) -> DataFrame:
    return lots(s, d)


def _sold(s: SparkSession, d: str) -> DataFrame:
    return sold(lots(s, d))


def r(c, n: int = 6):
    return F.round(c, n)


@query("SELECT maker, q, count(*) AS n, round(avg(price), 6) AS mean_price, round(median(price), 6) AS median_price, max(price) AS max_price FROM sold GROUP BY maker, q")
def maker_stats(s, d):
    return _sold(s, d).groupBy("maker", "q").agg(F.count("*").alias("n"), r(F.avg("price")).alias("mean_price"), r(F.median("price")).alias("median_price"), F.max("price").alias("max_price"))


@query("SELECT maker, arg_max(lot_id, (price, -lot_id)) AS lot_id, max(price) AS price FROM sold GROUP BY maker")
def maker_records(s, d):
    return _sold(s, d).groupBy("maker").agg(F.max_by("lot_id", F.struct(F.col("price"), -F.col("lot_id"))).alias("lot_id"), F.max("price").alias("price"))


@query("SELECT lot_id, maker, price, day FROM sold WHERE price > 50000")
def sold_predicate_filter(s, d):
    return _sold(s, d).where("price > 50000").select("lot_id", "maker", "price", "day")


@query("SELECT category, q, count(*) AS n, round(quantile_cont(price, 0.25), 6) AS q1, round(median(price), 6) AS q2, round(quantile_cont(price, 0.75), 6) AS q3 FROM sold GROUP BY category, q")
def quarter_history(s, d):
    return _sold(s, d).groupBy("category", "q").agg(F.count("*").alias("n"), *[r(A.quantile("price", p)).alias(a) for p, a in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])


@query("+cal AS (SELECT category, unnest(generate_series(min(q), max(q))) AS q FROM sold GROUP BY category) SELECT c.category, c.q, round(median(price), 6) AS median, count(*) AS n FROM cal c JOIN sold s ON s.category = c.category AND s.q BETWEEN c.q - 3 AND c.q GROUP BY c.category, c.q HAVING count(*) >= 3")
def trailing_demand_median(s, d):
    return Q.trailing_median(_sold(s, d).select("category", "q", "price"), ["category"], "price", 4, 3).withColumn("median", r("median"))


@query("SELECT category, CASE WHEN count(*) >= 20 THEN round(quantile_cont(price / ((est_low + est_high) / 2), 0.15), 6) END AS low, CASE WHEN count(*) >= 20 THEN round(quantile_cont(price / ((est_low + est_high) / 2), 0.85), 6) END AS high, count(*) AS n FROM sold GROUP BY category")
def realized_band(s, d):
    rows = _sold(s, d).withColumn("ratio", F.col("price") / ((F.col("est_low") + F.col("est_high")) / 2))
    return rows.groupBy("category").agg(A.at_least(F.count("*"), 20, r(A.quantile("ratio", 0.15), 6)).alias("low"), A.at_least(F.count("*"), 20, r(A.quantile("ratio", 0.85), 6)).alias("high"), F.count("*").alias("n"))


def _weighted(s, d):
    return _sold(s, d).withColumn("weight", F.round(S.half_life(F.datediff(F.lit("1998-12-31").cast("date"), "day") / 365.25, 2.0), 9))


_WEIGHTED = "+w AS (SELECT *, round(pow(0.5, (date_diff('day', day, DATE '1998-12-31') / 365.25) / 2.0), 9) AS weight FROM sold)"


@query(_WEIGHTED + ", c AS (SELECT maker, price, sum(weight) OVER (PARTITION BY maker ORDER BY price, lot_id ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY maker) AS tot FROM w) SELECT maker, min(price) AS weighted_median FROM c WHERE cum >= tot / 2 GROUP BY maker")
def weighted_median_recency(s, d):
    return A.weighted_median(_weighted(s, d), ["maker"], "price", "weight", "lot_id")


@query(_WEIGHTED + ", c AS (SELECT maker, price, (sum(weight) OVER o - weight / 2) / sum(weight) OVER (PARTITION BY maker) AS p, row_number() OVER (PARTITION BY maker ORDER BY price, lot_id) AS n FROM w WINDOW o AS (PARTITION BY maker ORDER BY price, lot_id ROWS UNBOUNDED PRECEDING)), l AS (SELECT *, lead(p) OVER (PARTITION BY maker ORDER BY n) AS np, lead(price) OVER (PARTITION BY maker ORDER BY n) AS nv FROM c) SELECT maker, round(coalesce(max(CASE WHEN p <= 0.8 AND np > 0.8 THEN price + (nv - price) * (0.8 - p) / (np - p) END), min(CASE WHEN n = 1 AND p >= 0.8 THEN price END), max(CASE WHEN np IS NULL AND p <= 0.8 THEN price END)), 6) AS q80 FROM l GROUP BY maker")
def weighted_quantile(s, d):
    return A.weighted_quantile(_weighted(s, d), ["maker"], "price", "weight", 0.8, "lot_id", "q80").withColumn("q80", r("q80"))


@query(_WEIGHTED + " SELECT maker, round(sum(weight) * sum(weight) / sum(weight * weight), 4) AS n_eff FROM w GROUP BY maker")
def kish_neff(s, d):
    return _weighted(s, d).groupBy("maker").agg(r(A.kish("weight"), 4).alias("n_eff"))


@query("+m AS (SELECT category, median(ln(price)) AS m FROM sold GROUP BY category) SELECT s.category, round(median(abs(ln(price) - m)) / 0.6745, 6) AS scale FROM sold s JOIN m ON s.category = m.category GROUP BY s.category")
def mad_scale(s, d):
    return A.mad_scale(_sold(s, d).withColumn("v", F.ln("price")), ["category"], "v").withColumn("scale", r("scale", 6))


@query("+c AS (SELECT maker, form, count(*) AS n FROM sold GROUP BY maker, form), k AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY n DESC, form) AS k FROM c) SELECT maker, form AS mode FROM k WHERE k = 1")
def mode_tiebreak(s, d):
    return A.mode(_sold(s, d), ["maker"], "form")


@query("SELECT category, form, house, count(*) AS n, round(sum(price), 2) AS revenue FROM sold GROUP BY ROLLUP(category, form, house) HAVING count(*) >= 5")
def rollup_category(s, d):
    return _sold(s, d).rollup("category", "form", "house").agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("revenue")).where("n >= 5")


@query("SELECT house, category, count(*) AS n, round(avg(price), 6) AS mean_price FROM sold GROUP BY GROUPING SETS ((house, category), (house))")
def grouping_sets_house_market(s, d):
    rows = _sold(s, d)
    return rows.groupingSets([["house", "category"], ["house"]], "house", "category").agg(F.count("*").alias("n"), r(F.avg("price")).alias("mean_price"))


@query("SELECT category, house, count(*) AS n FROM lots GROUP BY CUBE(category, house)")
def cube_facets(s, d):
    return _lots(s, d).cube("category", "house").agg(F.count("*").alias("n"))


@query("+e AS (SELECT row_number() OVER (ORDER BY edge) - 1 AS bin, edge, lead(edge, 1, 1e300) OVER (ORDER BY edge) AS upper FROM (VALUES (0.0::DOUBLE), (1000.0), (5000.0), (10000.0), (25000.0), (50000.0), (75000.0)) t(edge)) SELECT CAST(bin AS INT) AS bin, CAST(edge AS DOUBLE) AS edge, count(price) AS n FROM e LEFT JOIN sold ON price >= edge AND price < upper GROUP BY bin, edge")
def histogram_buckets(s, d):
    return A.histogram(_sold(s, d), "price", EDGES)


@query("SELECT house, count(*) FILTER (status <> 'upcoming') AS offered, round(avg(CASE WHEN status = 'sold' THEN 1.0 ELSE 0.0 END) FILTER (status <> 'upcoming'), 6) AS sell_through, round(avg(CASE WHEN price > est_high THEN 1.0 ELSE 0.0 END) FILTER (status = 'sold'), 6) AS beat_high FROM lots GROUP BY house")
def sell_through(s, d):
    offered, done = F.col("status") != "upcoming", F.col("status") == "sold"
    return _lots(s, d).groupBy("house").agg(F.count_if(offered).alias("offered"), r(F.count_if(done) / F.count_if(offered), 6).alias("sell_through"), r(F.count_if(done & (F.col("price") > F.col("est_high"))) / F.count_if(done), 6).alias("beat_high"))


@query("SELECT category, round(exp(median(abs(ln(price / ((est_low + est_high) / 2))))) - 1, 6) AS mdape, round(exp(median(ln(price / ((est_low + est_high) / 2)))), 6) AS bias FROM sold GROUP BY category")
def log_error_metrics(s, d):
    rows = _sold(s, d).withColumn("e", F.ln(F.col("price") / ((F.col("est_low") + F.col("est_high")) / 2)))
    return rows.groupBy("category").agg(r(F.exp(F.median(F.abs("e"))) - 1, 6).alias("mdape"), r(F.exp(F.median("e")), 6).alias("bias"))


@query("SELECT CAST(floor(least(n_chars, 9999) / 1000.0) AS INT) AS bucket, count(*) AS n, round(avg(pow(least(n_chars, 10000) / 10000.0 - quality, 2)), 6) AS brier, round(avg(quality), 6) AS rate FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL GROUP BY 1", with_lots=False)
def brier_buckets(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").where("quality is not null")
    p = F.least("n_chars", F.lit(10000)) / 10000.0
    return rows.groupBy(F.floor(F.least("n_chars", F.lit(9999)) / 1000.0).cast("int").alias("bucket")).agg(F.count("*").alias("n"), r(F.avg(F.pow(p - F.col("quality"), F.lit(2))), 6).alias("brier"), r(F.avg("quality"), 6).alias("rate"))


@query("SELECT house, category, count(*) AS n, round(median(ln(price / ((est_low + est_high) / 2))), 6) AS bias FROM sold GROUP BY house, category HAVING count(*) >= 5")
def house_calibration(s, d):
    rows = _sold(s, d).withColumn("e", F.ln(F.col("price") / ((F.col("est_low") + F.col("est_high")) / 2)))
    return rows.groupBy("house", "category").agg(F.count("*").alias("n"), r(F.median("e"), 6).alias("bias")).where("n >= 5")


@query("SELECT month(day) AS month, count(*) AS n, round(median(price), 6) AS median_price, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM sold GROUP BY month(day)")
def seasonality_month(s, d):
    by = _sold(s, d).groupBy(F.month("day").alias("month")).agg(F.count("*").alias("n"), r(F.median("price")).alias("median_price"))
    # twelve rows from here on
    return by.withColumn("share", r(F.col("n") / F.sum("n").over(W.partitionBy()), 6)).withColumn("month", F.col("month").cast("long"))


@query("SELECT lot_id, maker, price FROM sold ORDER BY price DESC, lot_id LIMIT 20")
def top_sales(s, d):
    return _sold(s, d).orderBy(F.desc("price"), "lot_id").limit(20).select("lot_id", "maker", "price")


@query("+k AS (SELECT maker, lot_id, row_number() OVER (PARTITION BY maker ORDER BY price DESC, lot_id) AS n, count(*) OVER (PARTITION BY maker) AS total FROM sold) SELECT maker, lot_id, CAST((n - 1) // 20 AS INT) AS page, total, total > 500 AS capped FROM k WHERE n <= 500")
def paged_table(s, d):
    order = W.partitionBy("maker").orderBy(F.desc("price"), "lot_id")
    rows = _sold(s, d).withColumn("n", F.row_number().over(order)).withColumn("total", F.count("*").over(W.partitionBy("maker"))).where("n <= 500")
    return rows.select("maker", "lot_id", F.floor((F.col("n") - 1) / 20).cast("int").alias("page"), "total", (F.col("total") > 500).alias("capped"))


@query("SELECT lot_id, house, CAST(row_number() OVER (PARTITION BY house ORDER BY price DESC, lot_id) AS INT) AS round FROM sold")
def interleave_houses(s, d):
    return _sold(s, d).select("lot_id", "house", F.row_number().over(W.partitionBy("house").orderBy(F.desc("price"), "lot_id")).alias("round"))


@query("+g AS (SELECT lot_id, category, price - est_low AS delta FROM sold WHERE price > est_low), k AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, rank() OVER (PARTITION BY category ORDER BY delta) - 1 AS less, count(*) OVER (PARTITION BY category, delta) AS same FROM g) SELECT lot_id, CASE WHEN n >= 20 THEN CAST(floor(100 * (less + 0.5 * same) / n + 0.5) AS BIGINT) END AS percentile FROM k")
def mid_rank_percentile(s, d):
    rows = _sold(s, d).withColumn("delta", F.col("price") - F.col("est_low")).where("delta > 0")
    by = W.partitionBy("category")
    n, less, same = F.count("*").over(by), F.rank().over(by.orderBy("delta")) - 1, F.count("*").over(W.partitionBy("category", "delta"))
    return rows.select("lot_id", F.when(n >= 20, S.js_round(100 * (less + 0.5 * same) / n)).alias("percentile"))


@query("SELECT lot_id, maker, coalesce(price > max(price) OVER (PARTITION BY maker ORDER BY day, lot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_record FROM sold")
def new_record_flag(s, d):
    before = W.partitionBy("maker").orderBy("day", "lot_id").rowsBetween(W.unboundedPreceding, -1)
    return _sold(s, d).select("lot_id", "maker", F.coalesce(F.col("price") > F.max("price").over(before), F.lit(True)).alias("is_record"))


@query("+m AS (SELECT category, q, median(price) AS v FROM sold GROUP BY category, q) SELECT category, q, round(100 * v / first_value(v) OVER (PARTITION BY category ORDER BY q), 6) AS value FROM m")
def rebased_index(s, d):
    rows = _sold(s, d).groupBy("category", "q").agg(F.median("price").alias("value"))
    return Q.rebase(rows, ["category"], "value", "q").withColumn("value", r("value", 6))


@query("+m AS (SELECT category, q, median(price) AS v FROM sold GROUP BY category, q) SELECT category, q, round(avg(v) OVER (PARTITION BY category ORDER BY q ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value FROM m")
def smooth3(s, d):
    rows = _sold(s, d).groupBy("category", "q").agg(F.median("price").alias("value"))
    return Q.smooth(rows, ["category"], "value", "q").withColumn("value", r("value"))


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT a.event_id, b.value FROM (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts", with_lots=False)
def asof_last_serve(s, d):
    e = _events(s, d)
    serves = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value")).withColumn("tie", F.lit(0))
    sales = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return J.as_of_last(sales, serves, ["user_id"], "ts", "ts", "value", "tie").select("event_id", "value")


@query("+fx(y, rate) AS (VALUES (1992, 1.1), (1994, 1.2), (1997, 1.4)), c AS (SELECT lot_id, price, year(day) AS yr FROM sold), k AS (SELECT lot_id, price, rate, row_number() OVER (PARTITION BY lot_id ORDER BY abs(y - yr), y DESC) AS n FROM c, fx) SELECT lot_id, round(price * CAST(rate AS DOUBLE), 6) AS usd FROM k WHERE n = 1")
def nearest_year_fx(s, d):
    rates = s.createDataFrame([(1992, 1.1), (1994, 1.2), (1997, 1.4)], "y int, rate double")
    return J.nearest(_sold(s, d).select("lot_id", "price", F.year("day").alias("yr")), rates, F.col("yr"), "y", "rate").select("lot_id", r(F.col("price") * F.col("rate")).alias("usd"))


@query("+cal AS (SELECT maker, unnest(generate_series(min(q), max(q))) AS q FROM lots2 GROUP BY maker), v AS (SELECT maker, q, median(price) AS v FROM sold GROUP BY maker, q) SELECT c.maker, c.q, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY c.maker ORDER BY c.q ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY c.maker ORDER BY c.q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS level FROM cal c LEFT JOIN v ON c.maker = v.maker AND c.q = v.q".replace("+cal", "+lots2 AS (SELECT maker, CAST(year(day) * 4 + quarter(day) - 1 AS INT) AS q FROM lots), cal"))
def nearest_earlier_index(s, d):
    every = _lots(s, d).withColumn("q", S.quarter_ordinal(F.col("day")))
    values = _sold(s, d).groupBy("maker", "q").agg(F.median("price").alias("level"))
    return J.fill_forward(Q.quarter_calendar(every, ["maker"]), values, ["maker"], "q", "level").withColumn("level", r("level"))


@query("+e AS (SELECT *, price / est_high AS ratio FROM sold), a AS (SELECT house, category, median(ratio) AS v FROM e GROUP BY house, category HAVING count(*) >= 30), b AS (SELECT house, median(ratio) AS v FROM e GROUP BY house HAVING count(*) >= 30), c AS (SELECT median(ratio) AS v FROM e) SELECT lot_id, round(coalesce(a.v, b.v, c.v), 6) AS factor FROM lots l LEFT JOIN a ON l.house = a.house AND l.category = a.category LEFT JOIN b ON l.house = b.house CROSS JOIN c")
def hierarchical_fallback(s, d):
    e = _sold(s, d).withColumn("ratio", F.col("price") / F.col("est_high"))
    cells = lambda keys: e.groupBy(*keys).agg(F.median("ratio").alias("factor"), F.count("*").alias("n")).where("n >= 30").drop("n")
    levels = [(["house", "category"], cells(["house", "category"])), (["house"], cells(["house"])), ([], e.agg(F.median("ratio").alias("factor")))]
    return J.fallback(_lots(s, d).select("lot_id", "house", "category"), levels, "factor").select("lot_id", r("factor", 6).alias("factor"))


@query("+b AS (SELECT *, CAST(floor(least(ln(greatest(price / est_high, 0.01)), 2) * 4) AS INT) AS bin FROM sold), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT lot_id, b.bin, c.n FROM b JOIN c ON b.bin = c.bin")
def bin_join(s, d):
    rows = _sold(s, d).withColumn("bin", F.floor(F.least(F.ln(F.greatest(F.col("price") / F.col("est_high"), F.lit(0.01))), F.lit(2)) * 4).cast("int"))
    return rows.join(rows.groupBy("bin").agg(F.count("*").alias("n")), "bin").select("lot_id", "bin", "n")


@query("SELECT a.lot_id AS snapshot, b.lot_id AS outcome FROM lots a JOIN lots b ON a.object = b.object AND a.maker = b.maker AND a.lot_id <> b.lot_id AND abs(date_diff('day', a.day, b.day)) <= 2")
def tolerance_join(s, d):
    rows = _lots(s, d).select("lot_id", "object", "maker", "day")
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.object") == F.col("b.object")) & (F.col("a.maker") == F.col("b.maker")) & (F.col("a.lot_id") != F.col("b.lot_id")) & (F.abs(F.datediff("a.day", "b.day")) <= 2)
    return a.join(b, on).select(F.col("a.lot_id").alias("snapshot"), F.col("b.lot_id").alias("outcome"))


@query("+k AS (SELECT maker, object, min(lot_id) AS lot_id FROM lots WHERE day >= DATE '1997-01-01' GROUP BY maker, object) SELECT maker, object, lot_id FROM k WHERE NOT EXISTS (SELECT 1 FROM lots o WHERE o.maker = k.maker AND o.object = k.object AND o.day < DATE '1997-01-01')")
def anti_new_ledger(s, d):
    rows = _lots(s, d).select("maker", "object", "lot_id", "day")
    fresh = rows.where("day >= date '1997-01-01'").groupBy("maker", "object").agg(F.min("lot_id").alias("lot_id"))
    return fresh.join(rows.where("day < date '1997-01-01'"), ["maker", "object"], "left_anti").select("maker", "object", "lot_id")


@query(f"+m AS (SELECT category, object, median(CASE WHEN q > {LAST_Q - 4} THEN price END) AS a, median(CASE WHEN q <= {LAST_Q - 4} THEN price END) AS b FROM sold WHERE q > {LAST_Q - 8} AND q <= {LAST_Q} GROUP BY category, object) SELECT category, round(median(a / b - 1), 6) AS yoy, count(*) AS n_pairs FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY category")
def matched_yoy(s, d):
    return Q.matched_yoy(_sold(s, d), ["category"], "object", "price", LAST_Q).withColumn("yoy", r("yoy", 6))


@query("+p AS (SELECT object, q AS q1, lag(q) OVER o AS q0, ln(price / lag(price) OVER o) AS ratio FROM sold WINDOW o AS (PARTITION BY object ORDER BY day, lot_id)) SELECT object, q0, q1, round(ratio, 6) AS ratio FROM p WHERE q0 < q1 AND abs(ratio) <= 3")
def consecutive_pairs(s, d):
    return Q.consecutive_pairs(_sold(s, d), "object", "day", "price", "lot_id").withColumn("ratio", r("ratio", 6))


@query("+o AS (SELECT house, category, median(price) AS own FROM sold GROUP BY house, category), c AS (SELECT house, category, q, median(price) AS m, count(*) AS n FROM sold GROUP BY house, category, q HAVING count(*) >= 3), l AS (SELECT c.house, q, exp(avg(ln(m / own))) AS v, count(*) AS n_cohorts, CAST(sum(n) AS BIGINT) AS n FROM c JOIN o ON c.house = o.house AND c.category = o.category GROUP BY c.house, q HAVING count(*) >= 3), z AS (SELECT house, q, n_cohorts, n, avg(v) OVER (PARTITION BY house ORDER BY q ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM l) SELECT house, q, round(100 * v / first_value(v) OVER (PARTITION BY house ORDER BY q), 6) AS value, n_cohorts, n FROM z")
def cohort_index(s, d):
    return Q.cohort_index(_sold(s, d), ["house"], ["category"], "price").withColumn("value", r("value", 6))


@query("+e AS (SELECT house, category, ln(price / est_high) AS e FROM sold), g AS (SELECT avg(e) AS m FROM e), h AS (SELECT house, (sum(e) + 45 * any_value(m)) / (count(*) + 45) AS m FROM e, g GROUP BY house), c AS (SELECT e.house, category, (sum(e) + 45 * any_value(m)) / (count(*) + 45) AS m FROM e JOIN h ON e.house = h.house GROUP BY e.house, category) SELECT house, category, round(exp(m), 6) AS factor FROM c")
def house_bias(s, d):
    e = _sold(s, d).select("house", "category", F.ln(F.col("price") / F.col("est_high")).alias("e"))
    top = e.agg(F.avg("e").alias("m0"))
    h = e.groupBy("house").agg(F.avg("e").alias("x"), F.count("*").alias("n")).crossJoin(F.broadcast(top)).select("house", A.shrunk(F.col("x"), F.col("n"), F.col("m0"), 45).alias("m1"))
    c = e.groupBy("house", "category").agg(F.avg("e").alias("x"), F.count("*").alias("n")).join(h, "house")
    return c.select("house", "category", r(F.exp(A.shrunk(F.col("x"), F.col("n"), F.col("m1"), 45)), 6).alias("factor"))


@query("SELECT a.lot_id, count(b.price) AS n_prior, round(median(b.price), 6) AS median_prior FROM sold a LEFT JOIN sold b ON a.object = b.object AND b.day < a.day GROUP BY a.lot_id")
def point_in_time_prior(s, d):
    return J.prior_median(_sold(s, d), ["object"], "day", "price").select("lot_id", "n_prior", r("median_prior").alias("median_prior"))


_TEXTS = "SELECT doc_id AS id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[''\"]', '', 'g'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS tokens FROM documents"


def _texts(s, d):
    """Distinct tokens of whole texts."""
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), S.tokens(F.col("text")).alias("tokens"))


@query(f"WITH t AS ({_TEXTS}), x AS (SELECT id, unnest(tokens) AS token FROM t), f AS (SELECT token, count(*) AS df FROM x GROUP BY token) SELECT token, df, round(ln((SELECT count(*) FROM t) / df), 6) AS idf FROM f", with_lots=False)
def idf(s, d):
    t = _texts(s, d)
    total = t.agg(F.count("*").alias("total"))
    return t.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("token", "df", r(F.ln(F.col("total") / F.col("df")), 6).alias("idf"))


@query(f"WITH t AS ({_TEXTS}), x AS (SELECT id, unnest(tokens) AS token FROM t), f AS (SELECT token, ln((SELECT count(*) FROM t) / count(*)) AS w FROM x GROUP BY token HAVING count(*) < (SELECT count(*) FROM t)), v AS (SELECT id, x.token, w FROM x JOIN f ON x.token = f.token), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY id) SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w) / any_value(p.norm * q.norm), 6) AS cosine FROM v a JOIN v b ON a.token = b.token AND a.id < b.id JOIN n p ON a.id = p.id JOIN n q ON b.id = q.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) / any_value(p.norm * q.norm) >= 0.7", with_lots=False)
def token_dot_similarity(s, d):
    """Over all tokens of whole texts; one that every document holds has weight 0 and adds to no norm or product."""
    return text_similarity(_texts(s, d), "id", "tokens", 0.7).withColumn("cosine", r("cosine", 6))


@query("WITH c AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '[^a-z]+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^a-z]+'), lambda x: x <> '')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM c WHERE len(list_concat(x, y)) > 0", with_lots=False)
def jaccard(s, d):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))
    rows = table(s, d, "conversations").select("conv_id", "turn", words.alias("w"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return rows.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", r(S.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard")).where("jaccard is not null")


@query(f"WITH t AS ({_TEXTS}), x AS (SELECT id, unnest(tokens) AS token FROM t) SELECT token, id // 65536 AS chunk, count(*) AS n, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS postings FROM x GROUP BY token, id // 65536", with_lots=False)
def inverted_index(s, d):
    """Every token of whole texts, its postings in chunks of neighbouring ids."""
    return R.posting_chunks(_texts(s, d), "id", F.col("tokens")).select("token", "chunk", "n", F.array_join(F.transform("postings", lambda x: x.cast("string")), " ").alias("postings"))


@query(f"WITH t AS ({_TEXTS}) SELECT id FROM t WHERE list_contains(tokens, 'the') AND len(list_filter(tokens, lambda x: starts_with(x, 'th'))) > 0", with_lots=False)
def inverted_index_search(s, d):
    return R.index_search(R.posting_chunks(_texts(s, d), "id", F.col("tokens")), ["the", "th"], True)


@query("+p AS (SELECT category, form, size, count(*) AS n, median(price) AS m, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM sold GROUP BY ALL) SELECT category, form, size, n, round(m, 6) AS median, CASE WHEN iqr / m > 2.5 THEN 'wide' WHEN n >= 8 THEN 'high' ELSE 'low' END AS confidence FROM p WHERE n >= 3")
def edition_pool_median(s, d):
    p = _sold(s, d).groupBy("category", "form", "size").agg(F.count("*").alias("n"), F.median("price").alias("m"), (A.quantile("price", 0.75) - A.quantile("price", 0.25)).alias("iqr")).where("n >= 3")
    return p.select("category", "form", "size", "n", r("m").alias("median"), F.when(F.col("iqr") / F.col("m") > 2.5, "wide").when(F.col("n") >= 8, "high").otherwise("low").alias("confidence"))


@query("+o AS (SELECT object, house, CAST(least(floor(quantity / 10), 4) AS INT) AS cell, ln(price / (est_low * 0.8)) AS g FROM sold), l AS (SELECT object, house, cell, avg(g) AS g FROM o GROUP BY ALL), c AS (SELECT cell, count(*) AS n, median(g) AS m FROM l GROUP BY cell) SELECT cell, n, round(exp(max((n * m + 20 * 0.3) / (n + 20)) OVER (ORDER BY cell)), 6) AS k FROM c")
def close_multiple(s, d):
    o = _sold(s, d).select("object", "house", F.least(F.floor(F.col("quantity") / 10), F.lit(4)).cast("int").alias("cell"), F.ln(F.col("price") / (F.col("est_low") * 0.8)).alias("g"))
    c = o.groupBy("object", "house", "cell").agg(F.avg("g").alias("g")).groupBy("cell").agg(F.count("*").alias("n"), F.median("g").alias("m"))
    # five cells from here on
    blended = A.shrunk(F.col("m"), F.col("n"), F.lit(0.3), 20)
    return c.withColumn("k", r(F.exp(F.max(blended).over(W.orderBy("cell"))), 6)).select("cell", "n", "k")


@query("WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value, max(value) OVER (PARTITION BY user_id) AS top, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last FROM events WHERE value > 0) SELECT CAST(least(date_diff('day', day, last), 30) AS INT) AS days_out, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(median(top / value), 6) END AS growth FROM e GROUP BY 1", with_lots=False)
def growth_curve(s, d):
    by = W.partitionBy("user_id")
    e = _events(s, d).where("value > 0").select(F.to_date("ts").alias("day"), "value", F.max("value").over(by).alias("top"), F.max(F.to_date("ts")).over(by).alias("last"))
    return e.groupBy(F.least(F.datediff("last", "day"), F.lit(30)).alias("days_out")).agg(F.count("*").alias("n"), A.at_least(F.count("*"), 5, r(F.median(F.col("top") / F.col("value")), 6)).alias("growth"))


@query("+p AS (SELECT object, count(*) AS n, max(day) AS last_day, quantile_cont(price, 0.15) AS lo, median(price) AS m, quantile_cont(price, 0.85) AS hi, (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / median(price) AS spread FROM sold GROUP BY object) SELECT object, n, CASE WHEN n < 3 THEN 'thin' WHEN last_day < DATE '1994-01-01' THEN 'stale' WHEN spread > 1 THEN 'wide' ELSE 'ok' END AS reason, CASE WHEN n >= 3 AND last_day >= DATE '1994-01-01' AND spread <= 1 THEN round(m, 6) END AS value, round(lo, 6) AS lo, round(hi, 6) AS hi FROM p")
def value_book(s, d):
    p = _sold(s, d).groupBy("object").agg(F.count("*").alias("n"), F.max("day").alias("last_day"), A.quantile("price", 0.15).alias("lo"), F.median("price").alias("m"), A.quantile("price", 0.85).alias("hi"), ((A.quantile("price", 0.75) - A.quantile("price", 0.25)) / F.median("price")).alias("spread"))
    reason = F.coalesce(R.first_reason([(F.col("n") < 3, "thin"), (F.col("last_day") < F.lit("1994-01-01").cast("date"), "stale"), (F.col("spread") > 1, "wide")]), F.lit("ok"))
    return p.withColumn("reason", reason).select("object", "n", "reason", F.when(F.col("reason") == "ok", r("m")).alias("value"), r("lo").alias("lo"), r("hi").alias("hi"))


@query("+b AS (SELECT category, CAST(floor(least(price / est_high, 2.99) * 2) AS INT) AS bucket, CASE WHEN price > est_high THEN 1.0 ELSE 0.0 END AS beat FROM sold), p AS (SELECT bucket, avg(beat) AS p FROM b GROUP BY bucket), c AS (SELECT category, b.bucket, count(*) AS n, (sum(beat) + 45 * any_value(p)) / (count(*) + 45) AS rate FROM b JOIN p ON b.bucket = p.bucket GROUP BY category, b.bucket) SELECT category, bucket, n, round(least(greatest(max(rate) OVER (PARTITION BY category ORDER BY bucket), 0.03), 0.97), 6) AS rate FROM c")
def calibration_rates(s, d):
    b = _sold(s, d).select("category", F.floor(F.least(F.col("price") / F.col("est_high"), F.lit(2.99)) * 2).cast("int").alias("bucket"), (F.col("price") > F.col("est_high")).cast("double").alias("beat"))
    p = b.groupBy("bucket").agg(F.avg("beat").alias("p"))
    c = b.groupBy("category", "bucket").agg(F.count("*").alias("n"), F.avg("beat").alias("x")).join(p, "bucket").withColumn("rate", A.shrunk(F.col("x"), F.col("n"), F.col("p"), 45))
    running = F.max("rate").over(W.partitionBy("category").orderBy("bucket"))
    return c.select("category", "bucket", "n", r(S.clamp(running, 0.03, 0.97), 6).alias("rate"))


@query("+t AS (SELECT a.lot_id, a.price, a.est_high, median(b.price) AS prior FROM sold a JOIN sold b ON a.object = b.object AND b.day < a.day GROUP BY a.lot_id, a.price, a.est_high) SELECT prior > 1.2 * est_high AS flagged, count(*) AS n, round(median(price / est_high - 1), 6) AS median_perf, round(avg(CASE WHEN price > est_high THEN 1.0 ELSE 0.0 END), 6) AS beat FROM t GROUP BY 1")
def backtest_summary(s, d):
    t = J.prior_median(_sold(s, d), ["object"], "day", "price").where("n_prior > 0")
    return t.groupBy((F.col("median_prior") > 1.2 * F.col("est_high")).alias("flagged")).agg(F.count("*").alias("n"), r(F.median(F.col("price") / F.col("est_high") - 1), 6).alias("median_perf"), r(F.avg((F.col("price") > F.col("est_high")).cast("double")), 6).alias("beat"))


@query("WITH k AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_type, event_id, value FROM k WHERE n = 1", with_lots=False)
def ledger_first_call(s, d):
    return R.keep_first(_events(s, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("+o AS (SELECT object, arg_max(price, lot_id) AS price, arg_max(form, lot_id) AS form, min(day) AS first_seen FROM lots WHERE day < DATE '1995-06-01' GROUP BY object), n AS (SELECT object, arg_max(price, lot_id) AS price, CASE WHEN object % 2 = 0 THEN arg_max(form, lot_id) END AS form, min(day) AS first_seen FROM lots WHERE day >= DATE '1995-06-01' GROUP BY object) SELECT coalesce(n.object, o.object) AS object, CASE WHEN n.object IS NOT NULL THEN n.price ELSE o.price END AS price, coalesce(n.form, o.form) AS form, coalesce(o.first_seen, n.first_seen) AS first_seen FROM o FULL JOIN n ON o.object = n.object")
def upsert_merge(s, d):
    side = lambda c: _lots(s, d).where(c).groupBy("object").agg(F.max_by("price", "lot_id").alias("price"), F.max_by("form", "lot_id").alias("form"), F.min("day").alias("first_seen"))
    new = side("day >= date '1995-06-01'").withColumn("form", F.when(F.col("object") % 2 == 0, F.col("form")))
    return R.upsert(side("day < date '1995-06-01'"), new, "object", ["form"], ["first_seen"])


@query("SELECT object, day, min(lot_id) AS lot_id FROM lots GROUP BY object, day")
def dedupe_keep_min(s, d):
    return R.keep_first(_lots(s, d), ["object", "day"], ["lot_id"]).select("object", "day", "lot_id")


@query("+k AS (SELECT object, maker, lot_id, status, row_number() OVER (PARTITION BY object, maker ORDER BY CASE status WHEN 'sold' THEN 0 WHEN 'bought_in' THEN 1 ELSE 2 END, lot_id) AS n FROM lots) SELECT object, maker, lot_id, status FROM k WHERE n = 1")
def status_rank_dedupe(s, d):
    return R.keep_first(_lots(s, d), ["object", "maker"], [R.status_rank("status", ["sold", "bought_in", "upcoming"]), "lot_id"]).select("object", "maker", "lot_id", "status")


@query("+k AS (SELECT lot_id, status, day, lead(day) OVER o AS nd, lead(lot_id) OVER o AS relisted_as FROM lots WINDOW o AS (PARTITION BY object ORDER BY day, lot_id)) SELECT lot_id, relisted_as FROM k WHERE status = 'sold' AND date_diff('day', day, nd) <= 30")
def relist_gap(s, d):
    return R.relist(_lots(s, d).select("lot_id", "object", "day", "status"), "object", "day", "lot_id", 30).select("lot_id", "relisted_as")


@query("SELECT lot_id, round(35 * least(ln(1 + est_high) / ln(1 + 200000.0), 1) + 30 * (1 - discount) + 0.8 * (20 * tax / 0.08 + 20 * pow(0.5, date_diff('day', DATE '1995-06-17', day) / 60.0)), 4) AS score FROM lots WHERE status = 'upcoming' AND day >= DATE '1995-06-17'")
def priority_score(s, d):
    rows = _lots(s, d).where("status = 'upcoming' and day >= date '1995-06-17'")
    urgency = S.half_life(F.datediff("day", F.lit("1995-06-17").cast("date")), 60.0)
    score = 35 * F.least(F.ln(1 + F.col("est_high")) / F.ln(F.lit(200001.0)), F.lit(1)) + 30 * (1 - F.col("discount")) + 0.8 * (20 * F.col("tax") / 0.08 + 20 * urgency)
    return rows.select("lot_id", r(score, 4).alias("score"))


@query("SELECT category, count(*) FILTER (price < 50000) AS n_other_filters, count(*) FILTER (price < 50000 AND house = 1) AS n_house FROM lots GROUP BY category")
def facet_counts(s, d):
    return _lots(s, d).groupBy("category").agg(F.count_if(F.col("price") < 50000).alias("n_other_filters"), F.count_if((F.col("price") < 50000) & (F.col("house") == 1)).alias("n_house"))


_SAVED = [(1, "Brand#11", None, 0.0, 20000.0), (2, None, 2, 60000.0, 1e9), (3, "Brand#23", 0, 0.0, 1e9)]


@query("+s(query_id, c, h, lo, hi) AS (VALUES (1, 'Brand#11', NULL, 0.0, 20000.0), (2, NULL, 2, 60000.0, 1e9), (3, 'Brand#23', 0, 0.0, 1e9)) SELECT query_id, lot_id FROM lots JOIN s ON (c IS NULL OR c = category) AND (h IS NULL OR h = house) AND price BETWEEN lo AND hi")
def saved_query_match(s, d):
    saved = s.createDataFrame(_SAVED, "query_id int, c string, h int, lo double, hi double")  # one row a saved query
    on = (F.col("c").isNull() | (F.col("c") == F.col("category"))) & (F.col("h").isNull() | (F.col("h") == F.col("house"))) & F.col("price").between(F.col("lo"), F.col("hi"))
    return _lots(s, d).join(F.broadcast(saved), on).select("query_id", "lot_id")


@query("+f AS (SELECT price > 30000 AS a, house = 1 AS b, status = 'upcoming' AS c FROM lots) SELECT * FROM (SELECT 'price' AS filter, count(*) FILTER (b AND c AND NOT a) AS n FROM f UNION ALL SELECT 'house', count(*) FILTER (a AND c AND NOT b) FROM f UNION ALL SELECT 'status', count(*) FILTER (a AND b AND NOT c) FROM f) WHERE n > 0")
def relax_counts(s, d):
    return R.relaxations(_lots(s, d), {"price": F.col("price") > 30000, "house": F.col("house") == 1, "status": F.col("status") == "upcoming"})


@query("SELECT 'no_price' AS rule, count(*) FILTER (price IS NULL OR price <= 0) AS n FROM lots UNION ALL SELECT 'band_crossed', count(*) FILTER (est_low > est_high) FROM lots UNION ALL SELECT 'late_open', count(*) FILTER (status = 'upcoming' AND day < DATE '1995-06-18') FROM lots UNION ALL SELECT 'far_below', count(*) FILTER (price < est_low * 0.5) FROM lots")
def invariant_violations(s, d):
    return R.violations(_lots(s, d), {"no_price": F.col("price").isNull() | (F.col("price") <= 0), "band_crossed": F.col("est_low") > F.col("est_high"), "late_open": (F.col("status") == "upcoming") & (F.col("day") < F.lit("1995-06-18").cast("date")), "far_below": F.col("price") < F.col("est_low") * 0.5})


@query("+b AS (SELECT house, floor(price / 100) * 100 AS p, day, count(*) AS c FROM sold GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY house, p ORDER BY c DESC, day) AS n FROM b) SELECT house, p AS price, CAST(sum(c) AS BIGINT) AS n, max(c) AS top, max(CASE WHEN n = 1 THEN day END) AS top_day FROM k GROUP BY house, p HAVING sum(c) >= 3")
def sentinel_signature(s, d):
    return R.signature_scan(_sold(s, d).select("house", (F.floor(F.col("price") / 100) * 100.0).alias("price"), "day"), "house", "price", "day", 3)


@query("+a AS (SELECT house, count(*) AS n_before FROM lots WHERE day < DATE '1995-01-01' GROUP BY house), b AS (SELECT house, count(*) AS n_now FROM lots WHERE day >= DATE '1995-01-01' GROUP BY house) SELECT house, n_before, n_now, CASE WHEN n_now >= 0.5 * n_before THEN 'pass' ELSE 'refuse' END AS verdict FROM (SELECT coalesce(a.house, b.house) AS house, coalesce(n_before, 0) AS n_before, coalesce(n_now, 0) AS n_now FROM a FULL JOIN b ON a.house = b.house)")
def shrink_gate(s, d):
    rows = _lots(s, d)
    return R.shrink_gate(rows.where("day < date '1995-01-01'"), rows.where("day >= date '1995-01-01'"), "house", 0.5)


@query("SELECT lot_id, round(price + least(price, 10000) * 0.25 + greatest(least(price, 40000) - 10000, 0) * 0.2 + greatest(price - 40000, 0) * 0.12, 6) AS all_in, round(price, 6) AS hammer FROM sold")
def tiered_premium(s, d):
    total = S.marginal(F.col("price"), PREMIUM)
    return _sold(s, d).select("lot_id", r(total).alias("all_in"), r(S.marginal_inverse(total, PREMIUM)).alias("hammer"))


@query("SELECT lot_id, day + 1 AS known_day, CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS known_month, CAST(date_trunc('year', day) + INTERVAL 1 YEAR AS DATE) AS known_year FROM sold")
def known_on_dates(s, d):
    return _sold(s, d).select("lot_id", *[S.known_on(F.col("day"), F.lit(p)).alias(f"known_{p}") for p in ("day", "month", "year")])


@query("SELECT user_id, max(CAST(ts AS TIMESTAMP)) AS last_seen, arg_max(value, (ts, value)) AS last_bid, max(value) AS high_bid, count(*) AS n_bids FROM events GROUP BY user_id", with_lots=False)
def overlay_accept(s, d):
    from ..streaming.flows import overlay

    return overlay(_events(s, d), "user_id", "ts", "value").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("WITH k AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, event_id, event_type FROM k WHERE was IS NULL OR was <> event_type", with_lots=False)
def snapshot_compaction(s, d):
    was = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(s, d).withColumn("was", was).where("was is null or was <> event_type").select("user_id", "event_id", "event_type")


@query("WITH k AS (SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT a.user_id, round(a.value - b.value, 6) AS delta FROM k a JOIN k b ON a.user_id = b.user_id WHERE a.n = 1 AND b.n = 2 AND date_diff('second', b.ts, a.ts) <= 864000", with_lots=False)
def bid_velocity(s, d):
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = _events(s, d).withColumn("n", F.row_number().over(order)).withColumn("was", F.lead("value").over(order)).withColumn("then", F.lead("ts").over(order))
    fresh = F.unix_timestamp("ts") - F.unix_timestamp("then") <= 864000
    return rows.where((F.col("n") == 1) & F.col("was").isNotNull() & fresh).select("user_id", r(F.col("value") - F.col("was"), 6).alias("delta"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL", with_lots=False)
def json_extract(s, d):
    return _events(s, d).groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a\s')) AS n_links FROM pages", with_lots=False)
def html_extract(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"<a\s")).cast("long").alias("n_links"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", with_lots=False)
def tumbling_counts(s, d):
    from ..streaming.flows import tumbling

    return tumbling(_events(s, d), "ts", "1 hour", ["event_type"]).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", r("total", 4).alias("total"))


@query("WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL", with_lots=False)
def sliding_counts(s, d):
    from ..streaming.flows import sliding

    return sliding(_events(s, d), "ts", "2 hours", "1 hour", ["event_type"]).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", r("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, session", with_lots=False)
def session_counts(s, d):
    from ..streaming.flows import sessions

    return sessions(_events(s, d), "ts", "6 hours", ["user_id"]).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", r("total", 4).alias("total"))


@query("SELECT lot_id, CASE WHEN price % (CASE WHEN price < 1000 THEN 10 WHEN price < 10000 THEN 100 ELSE 1000 END) = 0 THEN true ELSE false END AS round_step FROM sold")
def round_increments(s, d):
    return _sold(s, d).select("lot_id", S.round_increment(F.col("price")).alias("round_step"))


@query("SELECT date_trunc('week', day)::DATE AS week, count(*) AS n, count(DISTINCT maker) AS makers, count(*) FILTER (price > est_high) AS beat FROM sold GROUP BY 1")
def weekly_view(s, d):
    return _sold(s, d).groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.count("*").alias("n"), F.countDistinct("maker").alias("makers"), F.count_if(F.col("price") > F.col("est_high")).alias("beat"))


@query("+k AS (SELECT maker, lot_id, row_number() OVER (PARTITION BY maker ORDER BY day DESC, lot_id) AS a, row_number() OVER (PARTITION BY maker ORDER BY price DESC, lot_id) AS b FROM sold) SELECT maker, lot_id FROM k WHERE a <= 5 OR b <= 5")
def newest_or_top_sample(s, d):
    by = W.partitionBy("maker")
    rows = _sold(s, d).withColumn("a", F.row_number().over(by.orderBy(F.desc("day"), "lot_id"))).withColumn("b", F.row_number().over(by.orderBy(F.desc("price"), "lot_id")))
    return rows.where("a <= 5 or b <= 5").select("maker", "lot_id")


@query("SELECT house, year(day) AS year, count(*) AS n, count(*) FILTER (status = 'sold') AS n_sold FROM lots GROUP BY house, year(day)")
def coverage_by_year(s, d):
    return _lots(s, d).groupBy("house", F.year("day").cast("long").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "sold").alias("n_sold"))


@query()
def repeat_sales_index(s, d):
    pairs = Q.consecutive_pairs(_sold(s, d), "object", "day", "price", "lot_id")
    return s.createDataFrame(Q.repeat_sales_index(pairs).round(6), "q int, value double")


@query()
def hedonic_index(s, d):
    return s.createDataFrame(Q.hedonic_index(_sold(s, d), ["category", "house"], "price").round(6), "q int, value double")


@query("+b AS (SELECT n, min(k) AS k FROM (SELECT n, unnest(range(n + 1)) AS k FROM (SELECT unnest(range(61)) AS n)) WHERE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) > 0.025 GROUP BY n), o AS (SELECT maker, category, price, row_number() OVER (PARTITION BY maker, category ORDER BY price) AS r, count(*) OVER (PARTITION BY maker, category) AS n FROM sold), j AS (SELECT o.*, coalesce(b.k, greatest(0, floor(o.n / 2 - 0.98 * sqrt(o.n)))) AS k FROM o LEFT JOIN b ON o.n = b.n) SELECT maker, category, n, round(median(price), 6) AS median, max(price) FILTER (r = k) AS low, max(price) FILTER (r = n + 1 - k) AS high FROM j GROUP BY maker, category, n")
def median_intervals(s, d):
    return A.median_interval(_sold(s, d), ["maker", "category"], "price").withColumn("median", r("median"))


@query()
def repeat_sale_groups(s, d):
    rows = _sold(s, d).select("lot_id", "object", "day", "price", "sale")
    a, b = rows.alias("a"), rows.alias("b")
    near = (F.col("a.object") == F.col("b.object")) & (F.col("a.lot_id") < F.col("b.lot_id")) & (F.col("a.sale") != F.col("b.sale")) & (F.abs(F.ln(F.col("a.price") / F.col("b.price"))) <= 0.2 + 0.1 * F.abs(F.datediff("a.day", "b.day")) / 365.25)
    edges = a.join(b, near).select(F.col("a.object").alias("component"), F.col("a.lot_id").alias("a"), F.col("b.lot_id").alias("b"), F.abs(F.datediff("a.day", "b.day")).alias("gap"))
    return Q.complete_linkage(edges, "component", "a", "b", "gap")


@query("RECURSIVE+o AS (SELECT house, lot_id, category, maker, round(-price, 2) AS rank, row_number() OVER (PARTITION BY house ORDER BY round(-price, 2) NULLS FIRST, lot_id) AS k FROM lots WHERE status = 'upcoming'), d AS (SELECT DISTINCT house, 0 AS n, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS categories, CAST([] AS BIGINT[]) AS makers FROM o UNION ALL SELECT d.house, any_value(d.n) + 1, min(o.k), list_append(any_value(d.categories), arg_min(o.category, o.k)), list_append(any_value(d.makers), arg_min(o.maker, o.k)) FROM d JOIN o ON o.house = d.house AND o.k > d.k WHERE d.n < 40 AND len(list_filter(d.categories, lambda x: x = o.category)) < 3 AND len(list_filter(d.makers, lambda x: x = o.maker)) < 2 GROUP BY d.house) SELECT o.house, lot_id, category, maker, rank FROM d JOIN o ON d.house = o.house AND d.k = o.k")
def shortlist_caps(s, d):
    rows = _lots(s, d).where("status = 'upcoming'").select("house", "lot_id", "category", "maker", F.round(-F.col("price"), 2).alias("rank"))
    return Q.greedy_caps(rows, "house", ["rank", "lot_id"], {"category": 3, "maker": 2}, 40)


@query("RECURSIVE+u AS (SELECT lot_id, object, maker, sale FROM lots WHERE status = 'upcoming'), e0 AS (SELECT min(lot_id) AS a, max(lot_id) AS b FROM u GROUP BY sale, object HAVING count(*) > 1 UNION SELECT min(lot_id), max(lot_id) FROM u GROUP BY maker, object HAVING count(*) > 1), e AS (SELECT a, b FROM e0 WHERE a < b UNION SELECT b, a FROM e0 WHERE a < b), c(id, reach) AS (SELECT a, a FROM e UNION SELECT c.id, e.b FROM c JOIN e ON c.reach = e.a) SELECT id, min(reach) AS component FROM c GROUP BY id")
def fold_variants(s, d):
    rows = _lots(s, d).where("status = 'upcoming'").select("lot_id", "object", "maker", "sale")
    by_sale = rows.groupBy("sale", "object").agg(F.min("lot_id").alias("a"), F.max("lot_id").alias("b")).where("a < b").select("a", "b")
    by_maker = rows.groupBy("maker", "object").agg(F.min("lot_id").alias("a"), F.max("lot_id").alias("b")).where("a < b").select("a", "b")
    return R.components(by_sale.union(by_maker))


from . import gates as _gates  # noqa: E402, F401  registers its queries
from . import market as _market  # noqa: E402, F401
from . import parsing as _parsing  # noqa: E402, F401
from . import valuation as _valuation  # noqa: E402, F401
