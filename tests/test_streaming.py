import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallybrook.config import WINDOW_MS, Settings, jdbc_config, read_dotenv
from tallybrook.operators import rules
from tallybrook.schemas import TRANSACTION
from tallybrook.sources.database import Database
from tallybrook.sources.transactions import parse_messages, split_rejects, stream, to_messages, transactions
from tallybrook.streaming import jobs, sinks
from tallybrook.streaming.stateful import RecentTimes, stream_detect, use_rocksdb

SF = "/root/testdata/sf0.001"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def rows_of(df):
    return sorted(map(str, df.select(*TRANSACTION.fieldNames(), "triggered_rules", "velocity_count_5min", "velocity_ratio_to_baseline", "amount_ratio_to_avg", "implied_speed_kmh").collect()))


@pytest.mark.parametrize("job", [jobs.stateful_detect, jobs.replay_events])
def test_several_batches_and_a_restart_equal_one_batch(spark, job):
    assert rows_of(job(spark, SF)) == rows_of(rules.detect(transactions(spark, SF)))


def test_both_tables_are_written(spark):
    detected = rules.detect(transactions(spark, SF))
    sent = {(r.sink, r.n) for r in jobs.fan_out(spark, SF).groupBy("sink").agg(F.count("*").alias("n")).collect()}
    assert sent == {("processed", detected.count()), ("flagged", detected.where("is_flagged").count())}


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    batch, write = rules.detect(transactions(spark, SF)), sinks.write_parquet(str(tmp_path))
    write(batch.limit(0), 0)
    write(batch, 1)
    write(batch, 1)
    processed, flagged = sinks.read_tables(spark, str(tmp_path))
    assert processed.count() == batch.count() and flagged.count() == batch.where("is_flagged").count()


def event(i, seconds, amount, place, account="a"):
    return (f"{i:03d}", account, amount, "m", place, T0 + timedelta(seconds=seconds), None)


def drained(spark, folder, batches):
    """Batches one after another through the stream, each in a run of its own."""
    for events in batches:
        spark.createDataFrame(events, TRANSACTION).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = stream(spark, "parquet", schema=TRANSACTION, path=f"{folder}/in")
        sinks.start(stream_detect(source), sinks.write_parquet(folder), f"{folder}/checkpoint", available_now=True).awaitTermination()
    return {r.transaction_id: r for r in sinks.read_tables(spark, folder)[0].collect()}


def test_a_late_event_counts_when_it_arrives(spark, tmp_path):
    batches = [[event(0, 1000, 10.0, "US"), event(1, 1100, 10.0, "US")], [event(2, 900, 10.0, "GB"), event(3, 1150, 40.0, "GB")]]
    found = drained(spark, str(tmp_path), batches)
    assert [found[k].velocity_count_5min for k in ("000", "001", "002", "003")] == [1, 2, 3, 4]
    assert found["002"].implied_speed_kmh == pytest.approx(6919.428 / 1e-6, rel=1e-4) and found["002"].flag_geo  # no time has passed
    assert found["003"].implied_speed_kmh == 0 and found["003"].amount_ratio_to_avg == 4.0


def test_state_can_expire(spark, tmp_path):
    """With a limit of a millisecond an account is new in each batch. Such a stream looks for expired state without end, so it is stopped."""
    folder = str(tmp_path)
    (tmp_path / "in").mkdir()
    source = stream(spark, "parquet", schema=TRANSACTION, path=f"{folder}/in")
    found = {}
    query = sinks.start(stream_detect(source, ttl_ms=1), lambda batch, _: found.update({r.transaction_id: r for r in batch.collect()}), f"{folder}/checkpoint")
    try:
        for events in ([event(i, i, 100.0, "US") for i in range(4)], [event(9, 100, 900.0, "US"), event(10, 100, 5.0, "US", "b")]):
            wanted = len(found) + len(events)
            spark.createDataFrame(events, TRANSACTION).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            until = time.monotonic() + 60
            while len(found) < wanted and time.monotonic() < until:
                time.sleep(0.2)
    finally:
        query.stop()
    assert len(found) == 6 and found["003"].velocity_count_5min == 4
    assert found["009"].velocity_count_5min == 1 and not found["009"].flag_amount


def test_recent_times_against_a_filtered_list():
    times, plain = RecentTimes([]), []
    for k, ms in enumerate([0, 5, 5, WINDOW_MS, WINDOW_MS + 1, 3, 10 * WINDOW_MS, 9 * WINDOW_MS, 10 * WINDOW_MS - 1, 11 * WINDOW_MS]):
        plain = [t for t in plain if ms - t <= WINDOW_MS] + [ms]
        assert times.add(ms) == len(plain), k
        times = RecentTimes(times.left()) if k % 3 == 0 else times
    assert sorted(plain) == times.left()


def test_the_job_keeps_rejects(spark, tmp_path):
    messages = to_messages(transactions(spark, SF)).withColumn("value", F.when(F.col("key") == "acct_00003", F.lit("{")).otherwise(F.col("value")))
    messages.write.parquet(f"{tmp_path}/in")
    source = stream(spark, "parquet", schema=messages.schema, path=f"{tmp_path}/in")
    for query in jobs.run(spark, str(tmp_path), messages=source, write=sinks.write_parquet(f"{tmp_path}/out"), available_now=True):
        query.awaitTermination()
    good, bad = split_rejects(parse_messages(spark.read.parquet(f"{tmp_path}/in")))
    assert spark.read.parquet(f"{tmp_path}/{jobs.REJECTS}").count() == bad.count() > 0
    assert sinks.read_tables(spark, f"{tmp_path}/out")[0].count() == good.count()


def derby(spark, name, *tables):
    """An embedded database with the tables, whose ids are VARCHAR so that they can be compared."""
    url = f"jdbc:derby:memory:{name};create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    link = spark._jvm.java.sql.DriverManager.getConnection(url)
    for table in tables:
        link.createStatement().execute(table)
    link.close()
    return url


RESULT_COLUMNS = """"transaction_id" VARCHAR(64), "account_id" VARCHAR(64), "amount" DOUBLE, "merchant" VARCHAR(64), "location" VARCHAR(8), "event_timestamp" TIMESTAMP,
"injected_label" CLOB, "flag_velocity" BOOLEAN, "flag_amount" BOOLEAN, "flag_geo" BOOLEAN, "is_flagged" BOOLEAN, "triggered_rules" VARCHAR(64), "velocity_count_5min" INT,
"velocity_ratio_to_baseline" DOUBLE, "amount_ratio_to_avg" DOUBLE, "implied_speed_kmh" DOUBLE"""
RESULT_TABLES = [f"CREATE TABLE {t} ({RESULT_COLUMNS})" for t in ("processed_transactions", "flagged_transactions")]
OTHER_TABLES = [
    'CREATE TABLE written_batches ("batch_id" BIGINT, "state" VARCHAR(8))',
    'CREATE TABLE transaction_explanations ("transaction_id" VARCHAR(64), "explanation" VARCHAR(2000), "explained_at" TIMESTAMP)',
]


def test_a_database_has_each_row_once(spark):
    url = derby(spark, "once", *RESULT_TABLES)
    database, write = Database(spark, url), sinks.write_jdbc(url)
    batch = rules.detect(transactions(spark, SF))
    assert not database.has("written_batches") and database.explanations().isEmpty()
    assert database.explained().columns[-2:] == ["explanation", "explained_at"]
    write(batch, 0)
    write(batch, 0)  # it had ended: nothing is written
    assert database.processed().count() == batch.count() and database.flagged().count() == batch.where("is_flagged").count()


def test_a_batch_that_broke_off_is_completed(spark):
    url = derby(spark, "broken", *RESULT_TABLES, *OTHER_TABLES)
    database = Database(spark, url)
    batch = rules.detect(transactions(spark, SF))
    database.append(spark.createDataFrame([(7, "begun")], "batch_id long, state string"), "written_batches")
    database.append(batch.where("cast(transaction_id as long) % 3 = 0"), "processed_transactions")
    sinks.write_jdbc(url)(batch, 7)
    assert database.processed().count() == batch.count() == database.processed().select("transaction_id").distinct().count()
    assert database.flagged().count() == batch.where("is_flagged").count()


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# comment\nexport KAFKA_BROKER='one:1'\nPOSTGRES_URL=postgresql://u:p@h/db # there\nNVIDIA_API_KEY=\"k=1\"\nnothing\n")
    assert read_dotenv(str(tmp_path / ".env")) == {"KAFKA_BROKER": "one:1", "POSTGRES_URL": "postgresql://u:p@h/db", "NVIDIA_API_KEY": "k=1"}
    monkeypatch.setenv("KAFKA_BROKER", "two:2")
    monkeypatch.delenv("POSTGRES_URL", raising=False)
    found = Settings.from_environment(str(tmp_path / ".env"))
    assert (found.broker, found.postgres_url, found.api_key, found.topic) == ("two:2", "postgresql://u:p@h/db", "k=1", "transactions")
    assert read_dotenv(str(tmp_path / "none")) == {}
    assert jdbc_config("postgresql://u:p@h:99/db") == ("jdbc:postgresql://h:99/db", {"user": "u", "password": "p", "driver": "org.postgresql.Driver"})
    assert jdbc_config("postgresql://h/db")[0] == "jdbc:postgresql://h:5432/db" and jdbc_config("jdbc:x:y") == ("jdbc:x:y", {})


def test_options_of_the_broker(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, kind):
            seen["format"] = kind
            return self

        def options(self, **given):
            seen.update(given)
            return self

        def load(self):
            return "loaded"

    class Session:
        readStream, conf = Reader(), spark.conf  # noqa: N815

    assert stream(Session(), "kafka", startingOffsets="earliest") == "loaded"
    assert (seen["format"], seen["startingOffsets"], seen["maxOffsetsPerTrigger"], seen["subscribe"]) == ("kafka", "earliest", "200", "transactions")
    assert spark.conf.get("spark.sql.streaming.kafka.useDeprecatedOffsetFetching") == "true"
    use_rocksdb(spark)
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
