import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.append("/opt")  # the public tokenizers' vocabulary files

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """compare(queries, oracles, name, sf): the query's rows are those of its SQL."""
    import glob

    import duckdb

    def normal(v):
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, (list, tuple)):
            return [normal(x) for x in v]
        return str(v) if type(v).__name__ == "Decimal" else v

    def run(queries, oracles, name, sf="sf0.001"):
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/{sf}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
        cursor = con.execute(oracles[name])
        names = [c[0] for c in cursor.description]
        want = cursor.fetchall()
        found = queries[name](spark, f"{DATA}/{sf}")
        assert sorted(found.columns) == sorted(names)
        rows = [tuple(r[n] for n in names) for r in found.collect()]
        assert sorted(repr(normal(r)) for r in rows) == sorted(repr(normal(r)) for r in want)

    return run
