"""Stream queries over tables of several part files and several micro-batches, against the whole table in one go."""

import functools

import pytest
from compare import connect, rows_of
from pyspark.sql import functions as F

from trafficlens.operators.scan import Fold
from trafficlens.plans import oracle
from trafficlens.plans.queries import QUERIES
from trafficlens.streaming import jobs as S

SF = "/root/testdata/sf0.001"
STREAMS = ["ingest_usage_stream", "rate_limit_stream", "budget_stream", "breaker_stream", "cache_stream", "usage_rollup_stream", "assemble_chunks_stream"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables as folders of files in time order."""
    folder = tmp_path_factory.mktemp("parts")
    for name, order in (("events", ["ts", "event_id"]), ("conversations", ["conv_id", "turn"])):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").orderBy(*order).toPandas()
        size = -(-len(rows) // 4)
        for k in range(4):
            part = spark.createDataFrame(rows[k * size : (k + 1) * size], spark.read.parquet(f"{SF}/{name}.parquet").schema)
            part.coalesce(1).write.mode("append").parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_part_files_and_batches(spark, parts, monkeypatch, name):
    monkeypatch.setattr(S, "read_table_stream", functools.partial(S.read_table_stream, files_per_trigger=1))
    got = QUERIES[name](spark, parts)
    rel = connect(SF).execute(oracle.SQL[name])
    theirs = rows_of([c[0] for c in rel.description], rel.fetchall())
    assert theirs and rows_of(got.columns, [tuple(r) for r in got.collect()]) == theirs


def test_missing_table_fails(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_table_stream(spark, SF, "no_such_table")


def _files(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_unfinished_completion_times_out(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    batches = [[(1, 0, "a", None, 0, "2024-01-01 00:00:00")], [(2, 0, "b", "stop", 1, "2024-01-01 02:00:00")],
               [(3, 0, "c", "stop", 1, "2024-01-01 04:00:00")], [(1, 1, "z", "stop", 1, "2024-01-01 04:00:00")]]
    stream = _files(spark, str(tmp_path / "in"), batches, "completion_id bigint, position int, delta string, finish_reason string, prompt_tokens int, ts string")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("completion_tokens", F.lit(1))
    got = S.run_to_table(S.assemble_chunks_stream(stream), "timeout").collect()
    # the first completion's state went before its end came
    assert {r.completion_id for r in got} == {2, 3} and at is not None


def test_late_rows_are_left_out_of_the_rollup(spark, tmp_path):
    row = lambda i, ts: (i, ts, "p", 1.0, False, 5)
    batches = [[row(1, "2024-01-01 10:00:00")], [row(2, "2024-01-05 10:00:00")], [row(3, "2024-01-05 11:00:00")], [row(4, "2024-01-01 11:00:00"), row(5, "2024-01-05 10:30:00")]]
    stream = _files(spark, str(tmp_path / "in"), batches, "usage_id bigint, created_at string, provider string, cost_usd double, fallback_used boolean, latency_ms bigint")
    stream = stream.withColumns({"created_at": F.col("created_at").cast("timestamp_ntz"), "cost_usd": F.col("cost_usd").cast("decimal(18,6)")})
    got = S.run_to_latest(S.usage_rollup_stream(stream), "late", ["window_start", "provider"]).collect()
    assert sorted((str(r.window_start)[:10], r.request_count) for r in got) == [("2024-01-01", 1), ("2024-01-05", 3)]


@pytest.fixture(scope="module")
def shuffled_parts(spark, tmp_path_factory):
    """The tables as folders of six files, newest and oldest first."""
    folder = tmp_path_factory.mktemp("shuffled")
    for name, order in (("events", ["ts", "event_id"]), ("conversations", ["turn", "conv_id"])):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        rows = table.orderBy(*order).toPandas()
        size = -(-len(rows) // 6)
        for k in (5, 0, 3, 1, 4, 2):
            spark.createDataFrame(rows[k * size : (k + 1) * size], table.schema).coalesce(1).write.mode("append").parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["usage_rollup_stream", "assemble_chunks_stream", "cache_stream"])
def test_files_out_of_time_order_lose_no_rows(spark, shuffled_parts, monkeypatch, name):
    monkeypatch.setattr(S, "read_table_stream", functools.partial(S.read_table_stream, files_per_trigger=1))
    got = QUERIES[name](spark, shuffled_parts)
    rel = connect(SF).execute(oracle.SQL[name])
    theirs = rows_of([c[0] for c in rel.description], rel.fetchall())
    ours = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if name == "cache_stream":  # hits depend on the order in which batches arrive, the rows do not
        assert len(ours) == len(theirs)
    else:
        assert theirs and ours == theirs


def test_a_busy_key_is_folded_in_steps(spark, tmp_path, monkeypatch):
    """No more rows of a key at once than a step has, and the state goes from step to step."""
    class Count(Fold):
        columns = ["us"]
        output = {"seen": ("bigint", None), "step": ("bigint", None)}

        def run(self, state, rows):
            n = len(rows["us"])
            return {"seen": [(state or 0) + i + 1 for i in range(n)], "step": [n] * n}, (state or 0) + n

    monkeypatch.setattr(S, "STEP_ROWS", 3)
    spark.sql("select 'k' as key, id as us from range(20) union all select 'other', 7").write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema("key string, us bigint").parquet(str(tmp_path / "rows"))
    got = S.run_to_table(S._fold_stream(rows, "key", ["us"], Count()), "steps").collect()
    assert sorted((r.key, r.us, r.seen) for r in got) == [*(("k", i, i + 1) for i in range(20)), ("other", 7, 1)]
    assert max(r.step for r in got) == 3
