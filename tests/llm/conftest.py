from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame from rows and a schema, over a few partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
