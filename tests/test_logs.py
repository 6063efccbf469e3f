import pytest
from pyspark.sql import functions as F

from posledger.sources import logs

A, B = "0xAb" + "0" * 38, "0xcd" + "0" * 38
T, U = "0x" + "1F" * 32, "0x" + "2e" * 32


def rows(spark):
    given = []
    for k in range(60):
        topics = [None, [], [T], [U.upper(), T]][k % 4]
        given.append((1 + k % 2, (A, B, A.lower())[k % 3], topics, "0x", k, None, "0x0", "0x1", 0, k % 5))
    return spark.createDataFrame(given, logs.RAW_LOG), given


@pytest.mark.parametrize("topic0", [[], [T.lower()], [T, U]])
def test_scan(spark, tmp_path, topic0):
    """The scan equals a plain filter, reads the folders of its range only, and all conditions reach the files."""
    df, given = rows(spark)
    path = str(tmp_path / "logs")
    logs.land_logs(df.where("block_number < 30"), path, 7)
    logs.land_logs(df.where("block_number >= 30").withColumn("blocks", F.lit("mine")), path, 7)
    found = logs.raw_logs(spark, path, 1, [A.upper().replace("0X", "0x")], topic0, 10, 40)
    wanted = [g for g in given if g[0] == 1 and g[1].lower() == A.lower() and 10 <= g[4] <= 40 and (not topic0 or (g[2] and g[2][0].lower() in [t.lower() for t in topic0]))]
    assert sorted(r.block_number for r in found.collect()) == [g[4] for g in wanted] and wanted
    assert found.columns == df.columns
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    partition, pushed = (next(x for x in plan.split("\n") if x.startswith(kind)) for kind in ("PartitionFilters", "PushedFilters"))
    assert "chain" in partition and "blocks" in partition and "(address" in pushed and "block_number" in pushed and bool(topic0) == ("(topic0" in pushed)
    read = {r.f for r in found.select(F.input_file_name().alias("f")).collect()}
    assert read and all("chain=1" in f and 1 <= int(f.split("blocks=")[1].split("/")[0]) <= 5 for f in read)


def test_nothing_landed_and_other_span(spark, tmp_path):
    path = str(tmp_path / "logs")
    assert logs.raw_logs(spark, path, 1, [A], [], 0, 10).count() == 0
    df, _ = rows(spark)
    logs.land_logs(df.limit(0), path, 7)
    assert logs.raw_logs(spark, path, 1, [A], [], 0, 10).count() == 0
    with pytest.raises(ValueError, match="span of 7"):
        logs.land_logs(df, path, 8)
    logs.land_logs(df, path, 7)
    assert logs.raw_logs(spark, path, 1, [], [], 0, 100).count() == 0
    assert logs.raw_logs(spark, path, 1, [B], [], 50, 40).count() == 0
