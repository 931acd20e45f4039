"""The streaming sink of the fact table: batches that fail or run again, and reads of a period."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trafficlens.functions.clock import at
from trafficlens.sources import usage_io
from trafficlens.streaming import jobs as S

COLUMNS = "usage_id bigint, virtual_key_id bigint, created_at timestamp_ntz"


@pytest.fixture()
def stream(spark, tmp_path):
    """Five files of 20 rows over several days, one file a micro-batch."""
    for k in range(5):
        spark.range(20 * k, 20 * k + 20, 1, 1).select(
            F.col("id").alias("usage_id"), (F.col("id") % 3).alias("virtual_key_id"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_at")
        ).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ids(spark, path):
    return sorted(r.usage_id for r in usage_io.read_batches(spark, str(path)).collect())


@pytest.mark.parametrize("after", [True, False])
def test_a_batch_that_fails_counts_once(spark, stream, tmp_path, monkeypatch, after):
    """The third batch dies before or after its rows are written; the next run begins with it."""
    put, calls = usage_io.write_batch, []

    def dying(rows, path, writer, batch):
        calls.append(batch)
        if after:
            put(rows, path, writer, batch)
        if len(calls) == 3:
            raise RuntimeError("killed")
        if not after:
            put(rows, path, writer, batch)

    monkeypatch.setattr(usage_io, "write_batch", dying)
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    with pytest.raises(StreamingQueryException):
        S.usage_sink(stream, table, "central", log)
    assert len(ids(spark, table)) == (60 if after else 40)
    S.usage_sink(stream, table, "central", log)
    assert calls == [0, 1, 2, 2, 3, 4]
    assert ids(spark, table) == list(range(100))
    S.usage_sink(stream, table, "central", log)
    assert ids(spark, table) == list(range(100))


def test_a_failing_table_holds_no_other_back(spark, stream, tmp_path, monkeypatch):
    put = usage_io.write_batch

    def half(rows, path, writer, batch):
        if writer == "central" and batch == 1:
            raise RuntimeError("down")
        put(rows, path, writer, batch)

    log, down = str(tmp_path / "log"), monkeypatch.context()
    with down as patch:
        patch.setattr(usage_io, "write_batch", half)
        with pytest.raises(StreamingQueryException):
            S.usage_sink(stream, str(tmp_path / "central"), "central", log)
        S.usage_sink(stream, str(tmp_path / "local"), "local", log)
    assert ids(spark, tmp_path / "local") == list(range(100)) and len(ids(spark, tmp_path / "central")) == 20
    S.usage_sink(stream, str(tmp_path / "central"), "central", log)
    assert ids(spark, tmp_path / "central") == list(range(100))


def test_a_period_reads_its_days_only(spark, stream, tmp_path):
    table = str(tmp_path / "table")
    S.usage_sink(stream, table, "central", str(tmp_path / "log"))
    rows = usage_io.read_batches(spark, table, at("2024-01-02 06:00:00"), at("2024-01-04 00:00:00"))
    assert sorted(r.usage_id for r in rows.collect()) == list(range(30, 72))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_on" in plan


def overlapping(path, column, value):
    """Files that a reader of one value cannot skip by their statistics, and all files."""
    files = glob.glob(f"{path}/created_on=*/*.parquet")
    kept = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        k = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        stats = [meta.row_group(g).column(k).statistics for g in range(meta.num_row_groups)]
        kept += any(s is not None and s.has_min_max and s.min <= value <= s.max for s in stats)
    return kept, len(files)


def test_clustered_files_prune_by_key_and_by_provider(spark, tmp_path):
    """Keys of very different size, one with a third of the rows; nulls stay."""
    n = F.col("id")
    rows = spark.range(0, 40_000, 1, 4).select(
        n.alias("usage_id"), F.when(n % 3 == 0, 5).when(n % 1_000 == 1, None).otherwise(F.pmod(F.xxhash64(n), F.lit(40))).cast("bigint").alias("virtual_key_id"),
        F.when(n % 17 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, ["cache", "harbor", "meadow", "north"])), (F.pmod(F.hash(n), F.lit(4)) + 1))).alias("provider"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(n * 2).cast("decimal(18,6)"))).alias("created_at"))
    plain, both = str(tmp_path / "plain"), str(tmp_path / "both")
    usage_io.write_usage(rows, plain, partitions=32)
    usage_io.write_usage_clustered(rows, both, partitions=32)
    assert spark.read.parquet(both).count() == 40_000
    assert spark.read.parquet(both).drop("created_on").exceptAll(rows).count() == 0
    key, of = overlapping(both, "virtual_key_id", 31)
    assert of >= 24 and key <= of / 2
    for provider in ("harbor", "north"):
        assert overlapping(both, "provider", provider)[0] <= of / 2
        assert overlapping(plain, "provider", provider)[0] == overlapping(plain, "provider", provider)[1]
    usage_io.write_usage_clustered(rows.limit(0), str(tmp_path / "none"))
    usage_io.write_usage_clustered(rows.withColumn("provider", F.lit(None).cast("string")), str(tmp_path / "null"))
    assert spark.read.parquet(str(tmp_path / "null")).count() == 40_000
