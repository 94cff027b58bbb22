"""Operators on small rows with known answers."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hammerline.functions import scalars as S
from hammerline.operators import joins, records, series, stats
from hammerline.sources import segments


def test_weighted_median_drops_weightless_rows(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 2.0, 1.0), ("a", 3, 9.0, 5.0), ("b", 4, 3.0, 0.0), ("b", 5, 5.0, 0.0)], "k string, id int, v double, w double")
    assert {r.k: r.weighted_median for r in stats.weighted_median(rows, ["k"], "v", "w", "id").collect()} == {"a": 9.0, "b": 4.0}


def test_capped_weights_sum_to_one():
    w = stats.capped_weights([10.0, 1.0, 1.0, 1.0], 0.4)
    assert abs(sum(w) - 1) < 1e-9 and max(w) <= 0.4 + 1e-9


def test_osa_counts_a_transposition_once():
    assert S.osa("abcd", "abdc", 2) == 1 and S.osa("abc", "xyz", 2) is None


def test_known_on_is_after_the_period(spark):
    row = spark.createDataFrame([(dt.date(2020, 5, 3),)], "d date").select(*[S.known_on(F.col("d"), F.lit(p)) for p in ("day", "month", "year", "unknown")]).first()
    assert tuple(row) == (dt.date(2020, 5, 4), dt.date(2020, 6, 1), dt.date(2021, 1, 1), None)


def test_premium_inverse(spark):
    bands = [(0.0, 0.25), (100.0, 0.2), (400.0, 0.1)]
    rows = spark.createDataFrame([(x,) for x in (0.0, 50.0, 100.0, 250.0, 400.0, 9000.0)], "p double")
    for r in rows.select("p", S.marginal_inverse(S.marginal(F.col("p"), bands), bands).alias("q")).collect():
        assert abs(r.p - r.q) < 1e-9


def test_no_look_ahead(spark):
    rows = [("a", 1, dt.date(2020, 1, 1), 10.0), ("a", 2, dt.date(2020, 1, 2), 20.0), ("a", 3, dt.date(2020, 1, 2), 40.0)]
    first = {r.id: (r.n_prior, r.median_prior) for r in joins.prior_median(spark.createDataFrame(rows, "k string, id int, d date, v double"), ["k"], "d", "v").collect()}
    later = {r.id: (r.n_prior, r.median_prior) for r in joins.prior_median(spark.createDataFrame([*rows, ("a", 4, dt.date(2020, 1, 3), 1e9)], "k string, id int, d date, v double"), ["k"], "d", "v").collect()}
    assert first == {k: later[k] for k in first} and first[2] == (1, 10.0)


def test_indices_recover_a_known_drift(spark):
    rng, rows = random.Random(7), []
    for i in range(1500):
        level = rng.uniform(2, 6)
        for q in sorted(rng.sample(range(8000, 8012), 3)):
            rows.append((i, f"c{i % 5}", q, dt.date(2000 + (q - 8000) // 4, 1 + 3 * (q % 4), 1), float(np.exp(level + 0.03 * (q - 8000) + rng.gauss(0, 0.05))), len(rows)))
    df = spark.createDataFrame(rows, "object int, category string, q int, day date, price double, id int")
    index = series.repeat_sales_index(series.consecutive_pairs(df, "object", "day", "price", "id"))
    assert abs(np.log(index["value"].iloc[-1] / 100) - 0.33) < 0.02
    flat = df.withColumn("price", F.exp(F.lit(3.0) + 0.03 * (F.col("q") - 8000) + (F.col("id") % 7) * 0.001))
    assert abs(np.log(series.hedonic_index(flat, ["category"], "price")["value"].iloc[-1] / 100) - 0.33) < 0.02


def test_complete_linkage_is_not_closure(spark):
    edges = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 3, 2)], "c long, a long, b long, gap int")
    found = {r.id: r.cluster for r in series.complete_linkage(edges, "c", "a", "b", "gap").collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8)], "a long, b long")
    assert {r.id: r.component for r in records.components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_segments_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, house string, title string")
    segments.write_segments(df, str(tmp_path / "s"), "house")
    back = segments.read_segment(spark, str(tmp_path / "s" / "house=a"), df.drop("house").schema)
    assert [tuple(r) for r in back.collect()] == [(1, "x")]
    (tmp_path / "lines.json").write_text('[{"id": 1, "title": "p"}, {"id": 2, "title": "q"}]\n{"id": 3, "title": "r"}\n')
    assert segments.read_segment(spark, str(tmp_path / "lines.json"), df.drop("house").schema).count() == 3
    assert segments.read_segment(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_publish_and_lookup(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    segments.publish(df, str(tmp_path / "p"), 14, "1")
    segments.publish(df.where("id < 5"), str(tmp_path / "p"), 1, "2")
    assert segments.published(spark, str(tmp_path / "p")).count() == 5
    segments.write_keyed(df, str(tmp_path / "k"), "id", 8)
    assert segments.lookup(spark, str(tmp_path / "k"), "id", 42, 8).first()["v"] == 84


def test_streaming_overlay_and_changes(spark, tmp_path):
    from hammerline.streaming import flows

    path = "/root/testdata/sf0.001/events.parquet"
    for name, make, mode in (("overlay", lambda e: flows.overlay(e, "user_id", "ts", "value"), "complete"), ("changes", lambda e: flows.changed_snapshots(e, "user_id", "ts", "value"), "append")):
        q = make(flows.event_stream(spark, path)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0


def test_grade_ladder_recovers_multipliers(spark):
    from hammerline.operators import market

    steps = {1: 0.5, 2: 0.8, 3: 1.0, 4: 1.7}
    rows = [(k, g, 100.0 * (k + 1) * m) for k in range(12) for g, m in steps.items() if (k + g) % 4]
    df = spark.createDataFrame(rows, "k long, g int, v double")
    found = market.grade_ladder(df, "k", "g", "v", [1, 2, 3, 4, 5], 3, 1, 3)
    assert found[5] is None and all(found[g] == pytest.approx(m) for g, m in steps.items())
    falling = df.withColumn("g", 5 - df.g)
    assert set(market.grade_ladder(falling, "k", "g", "v", [1, 2, 3, 4], 2, 1, 3).values()) == {None}


def test_composite_caps_weights(spark):
    from hammerline.operators import market

    levels = spark.createDataFrame([(k, q, 1.0 + k * q / 10) for k in range(4) for q in (1, 2)] + [(0, 3, 2.0)], "k long, q int, level double")
    sizes = spark.createDataFrame([(0, 97.0), (1, 1.0), (2, 1.0), (3, 1.0)], "k long, size double")
    got = {r.q: (r.value, r.n) for r in market.composite(levels, sizes, "k", "q", "level", "size", 0.4, 3, 0.5).collect()}
    assert set(got) == {1, 2} and got[1][1] == 4
    assert got[1][0] == pytest.approx(math.exp(0.2 * sum(math.log(1 + k / 10) for k in (1, 2, 3))))


def test_neighbour_labels_need_agreement(spark):
    from hammerline.operators import market

    rows = [(1, 1, 10, "a"), (2, 1, 11, None), (3, 1, 12, "a"), (4, 1, 13, "b"), (5, 2, 11, None), (6, 1, 90, None), (7, 1, None, None)]
    df = spark.createDataFrame(rows, "id long, sale long, lot int, vote string")
    assert [tuple(r) for r in market.neighbour_labels(df, "sale", "lot", "vote", "id", 1, 2, 0.9).collect()] == [(2, "a", 2)]
    assert market.neighbour_labels(df, "sale", "lot", "vote", "id", 2, 3, 0.9).count() == 0


def test_greedy_caps_equal_one_pass(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), i, rng.choice([None, 1, 2, 3]), rng.choice(["p", "q", None])) for i in range(400)]
    rng.shuffle(rows)
    got = series.greedy_caps(spark.createDataFrame(rows, "g string, rank int, a int, b string"), "g", ["rank"], {"a": 3, "b": 4}, 9).collect()
    want, taken = [], {}
    for g, rank, a, b in sorted(rows, key=lambda r: r[1]):
        own = taken.setdefault(g, [])
        if len(own) < 9 and sum(x == a for x, _ in own) < 3 and sum(y == b for _, y in own) < 4:
            own.append((a, b)), want.append((g, rank, a, b))
    assert {(r.g, r.rank, r.a, r.b) for r in got} == set(want)
