"""Lines without a part pass or fail the gates as those of any part do."""

from __future__ import annotations

import datetime

import duckdb

from perfloom.plans import catalog


def test_lines_without_a_part_equal_the_sql(spark, tmp_path):
    day = lambda m: datetime.datetime(2000, m, 1)
    rows = [(part, 100.0 + 10 * i, discount, day(m)) for part, discount in ((None, 0.1), (1, 0.1), (2, 0.0), (3, None)) for m in (1, 2, 3) for i in range(3)]
    spark.createDataFrame(rows, "l_partkey long, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalog.QUERIES["sigma_gate"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(catalog.ORACLES["sigma_gate"]).fetchall()}
    assert (None, 0, True) in want and (2, 3, False) in want
    assert got == want
