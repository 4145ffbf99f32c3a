"""What state stores hold does not grow with the number of partitions."""

from quern.llm import click_dedup


def test_stores_share_a_bound():
    own = {k.removeprefix("spark.sql.streaming.stateStore."): v for k, v in click_dedup.SETTINGS.items()}
    assert own["rocksdb.boundedMemoryUsage"] == "true" and int(own["rocksdb.maxMemoryUsageMB"]) <= 256 and own["unloadOnCommit"] == "true"
