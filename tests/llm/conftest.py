import pytest


@pytest.fixture(scope="session", autouse=True)
def small_blocks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
