import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Rows of a query over the smallest tables, by column name in order."""
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            connection.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")

    def rows(sql: str) -> list[tuple]:
        result = connection.execute(sql)
        names = [d[0] for d in result.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)

    return rows


@pytest.fixture(scope="session")
def rows_of():
    def rows(df) -> list[tuple]:
        names = sorted(df.columns)
        return sorted((tuple(r[n] for n in names) for r in df.select(*[df[n] for n in names]).collect()), key=repr)

    return rows
