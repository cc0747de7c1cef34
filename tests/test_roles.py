"""Values of reasons as text, beside DuckDB's casts."""

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import roles


def test_decimals_are_those_of_sql(spark):
    got = spark.range(60_000).select(F.round(F.col("id") / 10_000.0, 4).alias("x")).select("x", roles.decimal(F.col("x"), 2).alias("two"), roles.decimal(F.col("x") * 100, 1).alias("one")).collect()
    want = duckdb.sql("SELECT cast(x AS decimal(20,2))::varchar, cast(x*100 AS decimal(10,1))::varchar FROM (SELECT round(i/10000.0::double,4)::double AS x FROM range(60000) t(i)) ORDER BY x").fetchall()
    assert [(r["two"], r["one"]) for r in got] == want
    assert spark.range(1).select(roles.decimal(F.lit(0.145), 2)).first()[0] == "0.14"
