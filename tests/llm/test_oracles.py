"""Training-data queries against their SQL on the smallest tables, and the SQL alone on awkward rows."""

import duckdb
import pytest

from hammerline.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(oracles.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_cutoffs_that_certify(spark, tmp_path):
    """Enough labels for the method to reject: query and SQL agree on the verdicts."""
    text = "one two three four five six seven eight nine ten alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [(i, text + (f"{i}" if i % 10 else "#### **** " * 8 + f"{i}"), "en", "a", 1) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(con.execute(f"select doc_id, kept from ({oracles.quality_rules()})").fetchall())
    got = {r.doc_id: r.kept for r in queries.op5_quality_rules(spark, f"file://{tmp_path}").select("doc_id", "kept").collect()}
    assert got == want and sum(not v for v in got.values()) == 600
