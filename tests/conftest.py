"""One small session for all tests."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(table):
    """Rows with columns by name, nulls and numbers made comparable, as a sorted list."""

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        return float(v) if isinstance(v, (int, float)) else v

    names = sorted(table[0]) if table else []
    return sorted((tuple(plain(r[n]) for n in names) for r in table), key=repr)


@pytest.fixture(scope="session")
def matches(spark, duck):
    def check(query, sql):
        ours = [r.asDict() for r in query(spark, SF).collect()]
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        theirs = [dict(zip(names, r)) for r in cursor.fetchall()]
        assert rows(ours) == rows(theirs)
        assert not ours or set(ours[0]) == set(names)

    return check
