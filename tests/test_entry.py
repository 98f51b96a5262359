import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def own():
    from fernglass import queries

    return sorted(queries.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", own())
def test_query_against_sql(spark, name):
    from fernglass import queries

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)


def test_parallel_map(spark):
    from fernglass.plans.parallel import parallel_map

    found = parallel_map(spark.range(1000), "id", lambda x: None if x % 10 == 0 else int(x) ** 2, "long", 2).orderBy("position").collect()
    assert [r.result for r in found] == [x * x for x in range(1000) if x % 10]
    assert parallel_map(spark.range(0), "id", lambda x: x, "long", 2).count() == 0
    with pytest.raises(Exception, match="division"):
        parallel_map(spark.range(5), "id", lambda x: 1 // 0, "long", 2).collect()
