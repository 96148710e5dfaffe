"""Every operator's query on tables without rows."""

import pytest

from lodestone.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", [n for n in sorted(registry.QUERIES) if n.startswith("op")])
def test_query_on_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0
