import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from valuescout.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("valuescout-tests", cpus=8, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a DataFrame and read one column back, in input order."""

    def evaluate(values, schema, expression):
        from pyspark.sql import functions as F

        names = [part.split()[0] for part in schema.split(",")]
        numbered = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(numbered, f"_i int, {schema}")
        assert names
        out = df.select("_i", expression.alias("out")).orderBy("_i")
        return [r["out"] for r in out.collect()]

    return evaluate
