import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """same(query, sql, sf): a query's rows against its SQL twin's in DuckDB."""
    sys.path.insert(0, str(ROOT / "tools"))
    import compare

    def check(spark, query, sql, sf="/root/testdata/sf0.001"):
        if not Path(sf).exists():
            pytest.skip("no test tables here")
        got, want = query(spark, sf).toPandas(), compare.tables(sf).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert compare.norm(got) == compare.norm(want)

    return check
