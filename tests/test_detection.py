from datetime import datetime, timedelta, timezone

import duckdb
import pytest

from tallybrook.operators import explain, risk, rules
from tallybrook.plans import registry
from tallybrook.schemas import TRANSACTION
from tallybrook.sources import generator
from tallybrook.sources.transactions import parse_messages, split_rejects

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
SF = "/root/testdata/sf0.001"


def detect(spark, events):
    """events: (seconds, amount, location), of one account."""
    rows = [(f"{i:03d}", "a", amount, "m", place, T0 + timedelta(seconds=s), None) for i, (s, amount, place) in enumerate(events)]
    return rules.detect(spark.createDataFrame(rows, TRANSACTION)).orderBy("transaction_id").collect()


def test_golden_trace(spark):
    found = detect(spark, [(0, 100.0, "US"), (60, 110.0, "US"), (120, 90.0, "US"), (180, 600.0, "US"), (300, 100.0, "US"), (301, 100.0, "GB"), (302, 100.0, "GB"), (303, 100.0, "GB")])
    assert [r.velocity_count_5min for r in found] == [1, 2, 3, 4, 5, 5, 6, 7]
    assert [r.velocity_ratio_to_baseline for r in found] == [0, 0, 0, 0, 1.25, 1.25, 1.5, 1.75]
    assert [r.amount_ratio_to_avg for r in found] == [0.0, 1.1, 0.857, 6.0, 0.444, 0.5, 0.545, 0.583]
    assert [r.triggered_rules for r in found] == ["", "", "", "amount", "", "geo", "", "velocity"]
    assert found[5].implied_speed_kmh == pytest.approx(24909941.4, abs=0.1)


@pytest.mark.parametrize(("gap", "count", "ratio"), [(299.999, 2, 0.0), (300.0, 2, 2.0), (300.001, 1, 1.0)])
def test_window_boundaries(spark, gap, count, ratio):
    last = detect(spark, [(0, 1.0, "US"), (gap, 1.0, "US")])[-1]
    assert (last.velocity_count_5min, last.velocity_ratio_to_baseline) == (count, ratio)


@pytest.mark.parametrize(("amount", "flagged"), [(500.0, False), (500.01, True)])
def test_amount_boundary(spark, amount, flagged):
    assert detect(spark, [(i * 1000, 100.0, "US") for i in range(3)] + [(9000, amount, "US")])[-1].flag_amount is flagged


@pytest.mark.parametrize(("hours", "flagged"), [(7.68, True), (7.70, False)])
def test_speed_boundary(spark, hours, flagged):
    assert detect(spark, [(0, 1.0, "US"), (hours * 3600, 1.0, "GB")])[-1].flag_geo is flagged


def test_unknown_places_and_bad_amounts(spark):
    found = detect(spark, [(0, 100.0, "US"), (1, None, "XX"), (2, float("nan"), "US"), (3, 100.0, None), (4, 100.0, "US")])
    assert all(r.implied_speed_kmh == 0 and not r.is_flagged for r in found)
    assert [r.amount_ratio_to_avg for r in found] == [0.0, 0.0, 0.0, 1.0, 1.0]


def test_order_of_input_does_not_matter(spark):
    tx = generator.transactions(spark, 400, n_accounts=10)
    assert sorted(map(str, rules.detect(tx).collect())) == sorted(map(str, rules.detect(tx.orderBy("amount").repartition(3)).collect()))


def test_rejects(spark):
    raw = spark.createDataFrame([("{",), ('{"account_id":"a","timestamp":"soon"}',), ('{"account_id":"a","amount":"x","timestamp":"2026-01-01T00:00:00+00:00"}',)], "value string")
    good, bad = split_rejects(parse_messages(raw))
    assert (good.count(), bad.count()) == (1, 2)


def test_unknown_account(spark):
    empty = rules.detect(spark.createDataFrame([], TRANSACTION))
    found = risk.account_status(empty, "nobody")
    assert (found["risk_score"], found["risk_level"], found["recent_flags"], found["last_explanation"]) == (0.0, "none", [], None)
    assert found["flags_by_rule"] == {"amount": 0, "geo": 0, "velocity": 0}


def test_retries():
    waits, calls = [], []

    def call(message):
        calls.append(message)
        if len(calls) < 3:
            raise explain.Retryable("busy")
        return " done "

    assert explain.with_retries(call, "x", waits.append) == "done"
    assert [int(w) for w in waits] == [2, 4]
    waits.clear()

    def never(message):
        raise explain.Retryable("busy")

    with pytest.raises(explain.Retryable):
        explain.with_retries(never, "x", waits.append)
    assert len(waits) == explain.ATTEMPTS - 1 and max(waits) <= explain.LONGEST_WAIT + 1


@pytest.mark.parametrize(("mode", "low", "high"), [("borderline", 1000, 3000), ("straddle", 700, 1100)])
def test_timed_travel(spark, mode, low, high):
    tx = generator.transactions(spark, 3000, mode=mode, n_accounts=300, rate=50.0)
    from tallybrook.operators.features import features

    speeds = [r.speed for r in rules.with_rules(features(tx)).where("injected_label = 'impossible_travel'").select("speed").collect()]
    assert len(speeds) > 20 and max(speeds) <= high + 1 and sorted(speeds)[len(speeds) // 2] > 0.8 * low


def test_no_python_in_the_batch_plan(spark):
    plan = registry.QUERIES["r07_detect"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_events_are_read_and_shuffled_once(spark):
    for name in ("r07_detect", "e01_rule_quality", "a05_risk_score"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("FileScan"), plan.count("hashpartitioning(account_id")) == (1, 1), name


@pytest.mark.parametrize("name", ["r07_detect", "w04_anchored_windows", "g01_account_risk_status", "e03_velocity_sweep", "l02_prompt_text", "k06_latest_explanation"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{SF}/events.parquet'")
    expected = db.sql(registry.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    norm = lambda rows: sorted(tuple("None" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert norm(registry.QUERIES[name](spark, SF).select(*columns).collect()) == norm(db.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall())
