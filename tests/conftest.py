import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from conceptloom.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark, tmp_path_factory):
    """Rows as a DataFrame over Parquet, as inputs are."""
    count = iter(range(1_000_000))

    def make(rows, schema):
        path = f"{tmp_path_factory.mktemp('frames')}/{next(count)}"
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        return spark.read.schema(spark.createDataFrame([], schema).schema).parquet(path)

    return make
