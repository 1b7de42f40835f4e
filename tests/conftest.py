import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def sql_differences(spark, query, sql, sf_dir):
    """What only the query or only DuckDB gives, numbers to nine digits."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")

    def canon(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return [canon(x) for x in v]
        return None if v is None else str(v)

    got = query(spark, sf_dir)
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(got.columns)
    a = sorted(str([canon(r[c]) for c in sorted(cols)]) for r in got.collect())
    b = sorted(str([canon(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)]) for r in res.fetchall())
    return [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3], len(a) - len(b)
