"""Indices on seeded markets, and streaming flows, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hammerline.operators import gates, indices, search, series, valuation
from hammerline.plans import catalogue
from hammerline.sources import segments
from hammerline.streaming import flows


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(3)
    rows, true = [], [0.03 * q for q in range(12)]
    for k in range(400):
        base = rng.gauss(8, 1)
        for q in sorted(rng.sample(range(12), rng.randint(2, 4))):
            h = rng.choice("abc")
            rows.append((k, q, f"2020-01-{q + 1:02d}", h, math.exp(base + true[q] + {"a": 0.0, "b": 0.3, "c": -0.2}[h] + rng.gauss(0, 0.1)), rng.randrange(10**9)))
    return spark.createDataFrame(rows, "k int, q int, day string, house string, price double, id int"), true


def test_repeat_sales_recover_the_market(market):
    df, true = market
    pairs = indices.sale_pairs(df, "k", "day", "price", "id", "house", "q", 3.0)
    fit = indices.repeat_sales_fit(pairs, 20, 2.0, 1e-4, 50, 20)
    assert np.abs(fit.levels - np.asarray(true)).max() < 0.06
    reference = {"a": 0.0, "b": 0.3, "c": -0.2}
    base = next(h for h in "abc" if h not in fit.houses)
    assert all(abs(v - (reference[h] - reference[base])) < 0.04 for h, v in fit.houses.items())
    assert indices.repeat_sales_fit(pairs, 20, 2.0, 1e-4, 10**6, 20) is None
    # the sandwich by hand, key by key, with the weights of the last stage left out of the comparison's tolerance
    rows = pairs.collect()
    at = {h: 11 + i for i, h in enumerate(fit.houses)}
    x = np.zeros((len(rows), 11 + len(at)))
    for i, r in enumerate(rows):
        for c, s in ((r.q1 - 1, 1), (r.q0 - 1, -1), (at.get(r.h1, -1), 1), (at.get(r.h0, -1), -1)):
            if c >= 0:
                x[i, c] += s
    y = np.asarray([r.ratio for r in rows])
    beta = np.concatenate((fit.levels[1:], list(fit.houses.values())))
    e, bread, keys = y - x @ beta, np.linalg.inv(x.T @ x), np.asarray([r.key for r in rows])
    meat = sum(np.outer(u, u) for k in set(keys.tolist()) if (u := x[keys == k].T @ e[keys == k]) is not None)
    plain = (bread @ meat @ bread)[:11, :11]
    assert np.sqrt(np.diag(fit.covariance)[1:]) == pytest.approx(np.sqrt(np.diag(plain)), rel=0.25)


def test_clustered_errors_by_hand(spark):
    rng = random.Random(5)
    rows = [(q, c, math.exp(1 + 0.1 * q + shock + rng.gauss(0, 0.05))) for c in range(30) for shock in [rng.gauss(0, 0.3)] for q in [c % 5] for _ in range(8)]
    fit = indices.clustered_errors(spark.createDataFrame(rows, "q int, c int, price double"), "price", "q", "c")
    y = np.asarray([math.log(r[2]) for r in rows])
    x = np.asarray([[float(r[0] == q) for q in range(5)] for r in rows])
    bread = np.linalg.inv(x.T @ x)
    e, c = y - x @ (bread @ x.T @ y), np.asarray([r[1] for r in rows])
    meat = sum(np.outer(u, u) for k in range(30) for u in [x[c == k].T @ e[c == k]])
    want = bread @ meat @ bread * 30 / 29 * (len(rows) - 1) / (len(rows) - 5)
    assert fit.covariance == pytest.approx(want, abs=1e-12)
    naive = e.std() / math.sqrt(48)
    assert fit.error(0, 1) > 2 * naive


def test_horizons_publish_or_say_why():
    rules = indices.Publication(100, 50, 0.2, 0.5)
    fit = indices.Fit(list(range(13)), np.asarray([0.05 * q for q in range(13)]), np.eye(13) * 1e-4, {}, 500, 200)
    whole = indices.horizon(fit, 12, 3, rules)
    assert whole["reason"] is None and whole["low"] < whole["move"] < whole["high"] and whole["move"] == pytest.approx(math.expm1(0.6))
    assert indices.horizon(fit, 12, 4, rules)["reason"] == "no-endpoint" and indices.horizon(None, 12, 1, rules)["reason"] == "few"
    jump = indices.Fit(fit.periods, np.where(np.arange(13) >= 6, 0.9, 0.0), fit.covariance, {}, 500, 200)
    assert indices.horizon(jump, 7, 1, rules)["reason"] == "implausible" and indices.horizon(jump, 12, 3, rules)["reason"] == "year:implausible"
    flat = indices.Fit(fit.periods, np.zeros(13), fit.covariance, {}, 500, 200)
    assert indices.horizon(flat, 12, 1, rules)["reason"] == "sign"
    wide = indices.Fit(fit.periods, fit.levels, np.eye(13), {}, 500, 200)
    assert indices.horizon(wide, 12, 1, rules)["reason"] == "wide"
    assert indices.end_sensitivity(fit, [11, 12], 1) == pytest.approx(0.0)


def test_invariants_raise(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, price double")
    with pytest.raises(gates.InvariantError, match="negative: 1 of 3"):
        gates.assert_invariants(df, {"negative": F.col("price") < 0}, {}, 0.5)
    assert gates.assert_invariants(df, {}, {"missing": F.col("price").isNull()}, 0.5) == {"missing": 1}
    with pytest.raises(gates.InvariantError):
        gates.assert_invariants(df, {}, {"missing": F.col("price").isNull()}, 0.1)


def test_upserts_keep_one_row_a_key(spark):
    old = spark.createDataFrame([(i, "o") for i in range(4)], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (9, "d")], "id int, v string")
    got = sorted((r.id, r.v) for r in segments.guarded_upsert(old, new, "id", 0.5, ["v"]).collect())
    assert got == [(1, "a"), (2, "c"), (9, "d")]
    with pytest.raises(ValueError):
        segments.guarded_upsert(old, new.limit(0), "id", 0.5, ["v"])


def test_published_versions_by_order_of_pointers(spark, tmp_path):
    base = f"file://{tmp_path}/p"
    for v in ("9", "10", "2"):
        segments.publish(spark.createDataFrame([(v,)], "v string"), base, 2, v)
    assert segments.published(spark, base).first()[0] == "2"
    assert sorted(p.name for p in (tmp_path / "p").glob("version=*")) == ["version=10", "version=2"]
    with pytest.raises(ValueError):
        segments.publish(spark.createDataFrame([("2",)], "v string"), base, 2, "2")


def test_leave_one_out_medians(spark):
    rng = random.Random(1)
    rows = [(k, i, float(rng.randint(1, 9))) for k in range(12) for i in range(k)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    for r in valuation.leave_one_out(df, ["k"], "v", "i", "m", 2).collect():
        others = [v for k, i, v in rows if k == r.k and i != r.i]
        assert r.m == (pytest.approx(float(np.median(others))) if len(others) >= 2 else None)


def test_spelling(spark):
    vocabulary = spark.createDataFrame([("the", 100), ("then", 30), ("apple", 50), ("apply", 40), ("adn", 1)], "token string, n long")
    words = spark.createDataFrame([("teh",), ("aplpe",), ("adn",), ("appel",), ("xyz",), ("apple",)], "word string")
    got = {r.word: r.replacement for r in search.spelled(words, vocabulary, 5.0).collect()}
    assert got == {"aplpe": "apple", "appel": "apple"}


def stream(spark, tmp_path, rows, batches):
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    schema = "user_id long, ts timestamp, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def run(df, spark, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_changed_snapshots_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(minutes=10 * i + u), float(rng.randint(1, 3))) for u in range(5) for i in range(60)]
    got = run(flows.changed_snapshots(stream(spark, tmp_path, rows, 1), "user_id", "ts", "value"), spark, tmp_path, "changed", "append")
    want = []
    for u in range(5):
        last = None
        for r in sorted(x for x in rows if x[0] == u):
            if r[2] != last:
                want.append(r)
                last = r[2]
    assert sorted((r.user_id, r.ts, r.value) for r in got) == want


def test_velocity_and_matches_of_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(hours=i), float(i * i + u)) for u in range(4) for i in range(8)]
    got = run(flows.velocity(stream(spark, tmp_path / "a", rows, 3), "user_id", "ts", "value", "2 hours"), spark, tmp_path, "velocity", "update")
    last = {r.user_id: (r.user_id, r.delta, r.fresh) for r in got}  # rows of a key are appended in order of the batches
    assert sorted(last.values()) == [(u, 13.0, True) for u in range(4)]
    left, right = stream(spark, tmp_path / "b", rows, 2), stream(spark, tmp_path / "c", [(u, t + dt.timedelta(minutes=5), v) for u, t, v in rows], 2)
    pairs = flows.matched_streams(left, right, "user_id", "ts", "ts", "10 minutes", "1 day").select(F.col("a.user_id").alias("u"), F.col("a.ts").alias("t"))
    assert sorted((r.u, r.t) for r in run(pairs, spark, tmp_path, "matched", "append")) == sorted((u, t) for u, t, _ in rows)


def test_valuation_rules_have_no_defaults():
    with pytest.raises(TypeError):
        valuation.Rules()
    assert "valuation" in catalogue.QUERIES


def test_hedonic_index_is_reweighted_least_squares(spark):
    rng, rows = random.Random(11), []
    for _ in range(600):
        y, room, q = rng.choice("aabbc"), rng.choice(["r", "s", None]), rng.randrange(40, 46)
        rows.append((y, room, q, math.exp(2 + 0.1 * (q - 40) + 0.4 * (y == "b") - 0.2 * (room == "s") + rng.gauss(0, 0.2) + 4 * (rng.random() < 0.04))))
    rows += [("a", "r", 39, -1.0), ("a", "r", 39, 0.0), ("a", "r", 41, None)]
    got = series.hedonic_index(spark.createDataFrame(rows, "y string, room string, q int, price double"), ["y", "room"], "price")
    kept = [x for x in rows if x[3] and x[3] > 0]
    columns = [lambda r: 1.0]
    for at in (0, 1):
        seen = sorted({r[at] for r in kept if r[at]}, key=lambda v, at=at: (-sum(r[at] == v for r in kept), v))
        columns += [lambda r, at=at, v=v: float(r[at] == v) for v in seen[1:]]
    columns += [lambda r, q=q: float(r[2] == q) for q in range(41, 46)]
    x, y, w = np.asarray([[c(r) for c in columns] for r in kept]), np.log([r[3] for r in kept]), np.ones(len(kept))
    for _ in range(5):
        beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        error = np.abs(y - x @ beta)
        w = np.minimum(1, 1.5 * np.median(error) / 0.6745 / np.maximum(error, 1e-12))
    assert got["q"].tolist() == list(range(40, 46))
    assert got["value"].tolist() == pytest.approx([100.0, *(100 * np.exp(beta[-5:]))], rel=2e-3)
    assert series.hedonic_index(spark.createDataFrame([], "y string, q int, price double"), ["y"], "price").empty
