import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    """A value that Spark and DuckDB results can be compared by."""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def check(df, sql):
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cursor.fetchall())
        assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want

    return check
