"""Golden rows and edge cases of the column and join operators."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trafficlens.functions.clock import at, epoch_us, instant, wall_time
from trafficlens.functions.text import estimate_tokens, extract_credential
from trafficlens.operators import messages as M
from trafficlens.operators import metering as B
from trafficlens.operators import reports as R
from trafficlens.operators import routing as G
from trafficlens.sources import dims, usage_io
from trafficlens.sources import fixtures as X

SCORES = [0.695625, 0.411916667, 0.751, 0.446829545, 0.420855769, 0.000125, 0.00075, 0.00675, 0.018794118, 0.109384615,
          0.040488636]


def test_difficulty_of_the_labelled_prompts(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(X.LABELLED_PROMPTS)],
                               "n int, prompt string, expected_tier string, trap string")
    rows = M.score_prompts(df).orderBy("n").collect()
    assert [round(r.score, 9) for r in rows] == SCORES
    assert all(r.tier == r.expected_tier for r in rows)
    assert sum(r.baseline_tier == r.expected_tier for r in rows) == 4
    assert R.routing_accuracy(M.score_prompts(df)).agg(F.sum(F.col("n") * F.col("accuracy"))).first()[0] == 11


def test_word_count_edges(spark):
    from trafficlens.functions.text import word_count
    df = spark.createDataFrame([("",), ("   ",), (" a",), ("a b ",), ("a\t\nb",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [1, 1, 2, 2, 2]


@pytest.mark.parametrize("pt,ct,cost", [(1000, 500, "0.000500"), (0, 0, "0.000000")])
def test_cost(spark, pt, ct, cost):
    df = spark.createDataFrame([("one", pt, ct), ("other", pt, ct)], "resolved_model string, prompt_tokens int, completion_tokens int")
    # requests of a model that is listed twice stay single
    sheet = spark.sql("select * from values ('one', 'p', 9.0BD, 9.0BD), ('two', 'p', 1.0BD, 1.0BD), ('one', 'q', 0.0002BD, 0.0006BD) as t(model, provider, price_in, price_out)")
    found = B.price_usage(df, sheet).collect()
    rows = {r.resolved_model: r for r in found}
    assert len(found) == 2 and rows["one"].model_provider == "q"
    assert rows["one"].cost_usd == Decimal(cost) and rows["one"].total_tokens == pt + ct
    assert rows["other"].price_error == "UNKNOWN_MODEL_ALIAS" and rows["other"].cost_usd is None


def test_tokens_are_a_quarter_of_the_length_and_at_least_one(spark):
    df = spark.createDataFrame([("",), ("abc",), ("a" * 9,)], "t string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("t"))).collect()] == [1, 1, 2]


def test_credentials(spark):
    df = spark.createDataFrame([("Bearer  k1 ", None), ("bEaReR k2", "x"), (None, " k3 "), ("Basic k4", "k5"), (None, None)],
                               "a string, k string")
    assert [r[0] for r in df.select(extract_credential(F.col("a"), F.col("k"))).collect()] == ["k1", "k2", "k3", "k5", ""]


def test_allowlist_is_case_sensitive_and_empty_means_all(spark):
    df = spark.createDataFrame([("FAST", ["fast"]), ("fast", ["fast"]), ("FAST", []), ("x", None)], "model string, allowed array<string>")
    assert [r.allow_error for r in G.check_allowlist(df).collect()] == ["MODEL_NOT_ALLOWED", None, None, None]


def test_exhausted_and_fallback_routes(spark):
    aliases, pricing = dims.load_aliases(spark), dims.load_pricing(spark)
    routed = spark.createDataFrame([("swift-s", ["delta-s", "field-m"]), ("swift-s", []), ("delta-s", [])],
                                   "primary_model string, chain array<string>")
    health = spark.createDataFrame([("north", False), ("harbor", True)], "provider string, healthy boolean")
    rows = G.route_around_outage(routed, aliases, pricing, health).collect()
    assert [(r.served_model, r.fallback_used, r.dispatch_error) for r in rows] == [
        ("delta-s", True, None), (None, None, "ALL_PROVIDERS_EXHAUSTED"), ("delta-s", False, None)]


def test_validation_messages(spark):
    df = spark.createDataFrame(
        [(1, "m", [("user", "hi")], 2.0), (2, None, [], -0.1), (3, "m", [("user", "x"), (None, " ")], 0.0), (4, "m", None, None)],
        "request_id int, model string, messages array<struct<role: string, content: string>>, temperature double")
    got = {r.request_id: r.violations for r in G.validate_requests(df).collect()}
    assert got == {
        1: "", 2: "model: needs a name; messages: needs a message; temperature: below 0",
        3: "messages[1].role: needs a role; messages[1].content: needs some text",
        4: "messages: needs a message"}


def test_percentile_index_on_whole_multiples(spark):
    df = spark.createDataFrame([(i, i) for i in range(100)], "usage_id long, latency_ms long")
    row = R.latency_percentiles(df, []).first()
    assert (row.p50, row.p95, row.p99, row.mean) == (50, 95, 99, 49.5)
    big = df.withColumn("latency_ms", F.col("latency_ms") * 5000)
    row = R.latency_percentiles(big, []).first()
    assert (row.p50, row.p95, row.p99) == (250_000, 475_000, 495_000)


def test_chunks_round_trip(spark):
    df = spark.createDataFrame([(1, "a b  c "), (2, ""), (3, "   "), (4, " x"), (5, "one")], "completion_id long, content string").withColumns({
        "prompt_tokens": F.lit(3), "completion_tokens": F.lit(4)})
    chunks = M.chunk_completion(df)
    assert {r.completion_id: r.content for r in M.assemble_chunks(chunks).collect()} == {1: "a b  c", 2: "", 3: "", 4: " x", 5: "one"}
    assert chunks.filter("finish_reason = 'stop'").count() == 5


def test_strict_ingest_raises(spark):
    df = spark.createDataFrame([('{"costUsd": "abc"}',)], "wire string")
    assert usage_io.ingest_usage(df, at("2024-01-01 00:00:00"))[1].count() == 1
    with pytest.raises(Exception, match="bad usage event"):
        usage_io.ingest_usage(df, at("2024-01-01 00:00:00"), strict=True)[0].collect()


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00.123456",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = set()
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.add(df.select(epoch_us(F.col("t")), F.unix_micros(instant(F.col("t"))), wall_time(instant(F.col("t"))).cast("string")).first())
        assert {tuple(s) for s in seen} == {(1710037800123456, 1710037800123456, "2024-03-10 02:30:00.123456")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dimensions_from_json(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"model": "m", "provider": "p", "inputPricePer1k": 0.0002, "outputPricePer1k": 0.015}]')
    (tmp_path / "a.json").write_text('{"aliases": {"fast": {"primary": "m", "fallbackChain": ["n"]}}, "other": 1}')
    (tmp_path / "k.json").write_text('[{"keyValue": "k", "alias": "t", "allowedModels": ["m", "m"], "requestsPerMinute": 5, "monthlyBudgetUsd": 0.01}]')
    assert tuple(dims.load_pricing(spark, str(tmp_path / "p.json")).first()) == ("m", "p", Decimal("0.000200"), Decimal("0.015000"))
    assert tuple(dims.load_aliases(spark, str(tmp_path / "a.json")).first()) == ("fast", "m", ["n"])
    key = dims.load_keys(spark, str(tmp_path / "k.json")).first()
    assert (key.tenant, key.allowed, key.rpm, key.budget) == ("t", ["m"], 5, Decimal("0.010000"))


def test_shared_folder_is_needed_off_local_masters(monkeypatch, spark):
    from trafficlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    session.shared_dir(Session())
    assert "trafficlens-" in Session.sparkContext.path


def test_a_page_too_large_is_an_error(spark):
    with pytest.raises(ValueError, match="100"):
        R.recent_requests(spark.range(1), 0, 101)


def test_a_body_is_judged_without_its_messages_being_written(spark):
    bodies = X.raw_bodies(spark, "/root/testdata/sf0.001")
    judged = G.validate_requests(bodies)
    assert "array_join" not in judged.select("body_error")._jdf.queryExecution().optimizedPlan().toString()
    odd = spark.sql("""select * from values (1, 'm', null, 0.5d), (2, 'm', array(named_struct('role', 'u', 'content', 'x')), double('NaN')),
        (3, null, array(named_struct('role', 'u', 'content', 'x')), null), (4, 'm', array(named_struct('role', 'u', 'content', null)), 0d),
        (5, 'm', array(null), -1d), (6, 'm', array(named_struct('role', 'u', 'content', 'x')), null) as t(request_id, model, messages, temperature)""")
    for rows in (judged, G.validate_requests(odd)):
        assert rows.filter("(violations != '') != (body_error is not null)").count() == 0
    assert rows.filter("body_error is null").collect()[0].request_id == 6


def test_code_is_found_as_by_the_whole_pattern(spark):
    from trafficlens.functions import text as T

    texts = ["a sum of", "sums", "resum", "sqrt2", "the sqrt", "integral", "``", "```", "O(n)", "O n", "x=1", "a;b", "", None, "no code",
             "intergral sum", "sum.", "[", "a)b", "sqrt_sum"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.rlike("t", F.lit(T.CODE_OR_MATH))
    assert df.filter(~T.has_code(F.col("t")).eqNullSafe(whole)).count() == 0


def test_trailing_blanks_end_where_the_text_ends(spark):
    """A pattern's end mark also matches before a last line separator, which is no blank."""
    from trafficlens.functions.text import word_count

    df = spark.createDataFrame([("key \u0085",), ("\x00key\t ",), ("a b \r\n",), (" \t ",), ("",)], "t string")
    assert [r[0] for r in df.select(extract_credential(F.lit(None).cast("string"), F.col("t"))).collect()] == [
        "key \u0085", "key", "a b", "", ""]
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [2, 1, 2, 1, 1]
