"""Named queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook import config as C
from tallybrook.functions import geo, labels
from tallybrook.operators import evaluate, explain, features, risk, rules
from tallybrook.plans import sql as S
from tallybrook.schemas import TRANSACTION
from tallybrook.sources import generator
from tallybrook.sources.transactions import parse_messages, split_rejects, to_messages, transactions
from tallybrook.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ONE_ACCOUNT = "acct_00007"


def add(name: str, run: Callable[[DataFrame], DataFrame], ctes: str | None = None, select: str = "", of: Callable = transactions) -> None:
    QUERIES[name] = lambda spark, sf_dir: ntz(run(of(spark, sf_dir)))
    if ctes:
        ORACLE_SQL[name] = S.query(ctes, select)


def ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


def _detected(tx: DataFrame) -> DataFrame:
    return rules.with_rules(features.features(tx))


def _some_explained(d: DataFrame) -> DataFrame:
    """A side table in which every third flagged transaction has an explanation."""
    third = risk.flagged(d).where(F.col("transaction_id").cast("long") % 3 == 0)
    return third.select("transaction_id", F.concat(F.lit("explained "), "transaction_id").alias("explanation"), F.lit("2026-01-01").cast("timestamp").alias("explained_at"))


def _spoilt(tx: DataFrame) -> DataFrame:
    """Messages of which every tenth is not JSON and every eleventh has no usable time."""
    n = F.substring_index("key", "_", -1).cast("long")
    value = F.when(n % 10 == 0, F.lit("{broken")).when(n % 11 == 0, F.regexp_replace("value", '"timestamp":"', '"timestamp":"x')).otherwise(F.col("value"))
    return to_messages(tx).select(value.cast("binary").alias("value"))


names = TRANSACTION.fieldNames()
plain = ", ".join(names)
add("s01_scan_transactions", lambda t: t.select(*names), S.TX, f"SELECT {plain} FROM tx")
add("p02_parse_json", lambda t: parse_messages(to_messages(t)).select(*names), S.TX, f"SELECT {plain} FROM tx")
add("p04_parse_timestamp", lambda t: parse_messages(to_messages(t)).select("transaction_id", F.unix_millis("event_timestamp").alias("ms")), S.TX, "SELECT transaction_id, (epoch_us(event_timestamp) // 1000) AS ms FROM tx")
add("p04_rejects", lambda t: split_rejects(parse_messages(_spoilt(t)))[1].agg(F.count("*").alias("n"), F.count("account_id").alias("with_account")), S.TX,
    "SELECT count(*) AS n, count(*) FILTER (WHERE CAST(substr(account_id, 6) AS BIGINT) % 10 <> 0) AS with_account FROM tx WHERE CAST(substr(account_id, 6) AS BIGINT) % 10 = 0 OR CAST(substr(account_id, 6) AS BIGINT) % 11 = 0")
add("p10_output_projection", rules.detect, S.RULES, f"SELECT {S.RESULT} FROM d")
add("r07_detect", rules.detect, S.RULES, f"SELECT {S.RESULT} FROM d")
add("p05_flagged_filter", lambda t: risk.flagged(rules.detect(t)), S.RULES, f"SELECT {S.RESULT} FROM d WHERE is_flagged")
add("k03_processed_rows", lambda t: rules.detect(t).groupBy("is_flagged").agg(F.count("*").alias("n")), S.RULES, "SELECT is_flagged, count(*) AS n FROM d GROUP BY 1")
add("p06_account_filter", lambda t: rules.detect(t).where(F.col("account_id") == F.lit(ONE_ACCOUNT)), S.RULES, f"SELECT {S.RESULT} FROM d WHERE account_id = '{ONE_ACCOUNT}'")
add("p08_ids_filter", lambda t: explain.backlog(rules.detect(t), t.select("transaction_id", F.lit("x").alias("explanation")), ids=explain.parse_ids("254, 292,293 , ,  100,54,7")), S.RULES,
    f"SELECT {', '.join(explain.FACTS)} FROM d WHERE is_flagged AND transaction_id IN ('254', '292', '293', '100', '54', '7')")
QUERIES["f01_haversine_pairs"] = lambda spark, sf_dir: geo.pairs(spark).withColumn("km", F.round("km", 3))
ORACLE_SQL["f01_haversine_pairs"] = S.query(S.PAIRS, "SELECT from_code, to_code, round(km, 3) AS km FROM pair")
add("f12_country_label", lambda t: t.select("location").distinct().union(t.sparkSession.createDataFrame([("XX",)], "location string")).withColumn("label", labels.country_label(F.col("location"))),
    f"{S.TX}, {S.COUNTRY}", "SELECT location, coalesce(code || ' (' || name || ')', location) AS label FROM (SELECT DISTINCT location FROM tx UNION ALL SELECT 'XX') LEFT JOIN country ON code = location")
add("f13_formats", lambda t: t.select("transaction_id", labels.decimals(F.col("amount"), 2).alias("two"), F.format_number(F.floor("amount"), 0).alias("grouped"), F.lpad("transaction_id", 5, "0").alias("padded"), F.rpad("merchant", 20, " ").alias("wide"), F.substring("transaction_id", 1, 8).alias("short")),
    S.TX, "SELECT transaction_id, printf('%.2f', amount) AS two, format('{:,}', CAST(floor(amount) AS BIGINT)) AS grouped, CASE WHEN length(transaction_id) > 5 THEN left(transaction_id, 5) ELSE lpad(transaction_id, 5, '0') END AS padded, rpad(merchant, 20, ' ') AS wide, left(transaction_id, 8) AS short FROM tx")
add("f03_clamp", lambda t: t.select("transaction_id", F.greatest(F.col("amount") - 150, F.lit(1.0)).alias("low"), F.least(F.pow(F.lit(2.0), F.length("merchant")) * 2, F.lit(60.0)).alias("high")),
    S.TX, "SELECT transaction_id, greatest(amount - 150, 1.0) AS low, least(pow(2.0, length(merchant)) * 2, 60.0) AS high FROM tx")
add("f04_rounding", lambda t: t.select("transaction_id", F.round(F.col("amount") / 7 + 0.00013, 1).alias("one"), F.round(F.col("amount") / 7 + 0.00013, 2).alias("two"), F.round(F.col("amount") / 7 + 0.00013, 3).alias("three")),
    S.TX, "SELECT transaction_id, round(amount / 7 + 0.00013, 1) AS one, round(amount / 7 + 0.00013, 2) AS two, round(amount / 7 + 0.00013, 3) AS three FROM tx")
add("f11_iso_timestamp", lambda t: t.select("transaction_id", labels.iso(F.col("event_timestamp")).alias("iso")), S.TX, "SELECT transaction_id, strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM tx")
add("j01_centroid_lookup", lambda t: geo.with_distance(features.with_previous(features.with_order(t)), "prev_location", "location").select("transaction_id", "prev_location", "location", F.round("km", 3).alias("km")),
    S.FEATURES, "SELECT transaction_id, prev_location, location, round(coalesce(km, 0), 3) AS km FROM f LEFT JOIN pair ON from_code = prev_location AND to_code = location")
add("j03_precision_lookup", lambda t: risk.rule_hits(rules.detect(t)).select("transaction_id", "rule", (labels.precision_hundredths(F.col("rule")) / 100.0).alias("precision")),
    S.HITS, "SELECT transaction_id, rule, CASE rule WHEN 'amount' THEN 1.0 WHEN 'geo' THEN 0.5 ELSE 0.26 END::DOUBLE AS precision FROM hits")
for key, columns in {
    "w01_lag_features": ["prev_location", "prev_ms"], "w02_amount_history": ["prior_count", "prior_mean"], "w03_sliding_count": ["velocity_count"],
    "w04_anchored_windows": ["window_no", "window_start"], "w05_velocity_baseline": ["baseline_count", "baseline_mean"],
}.items():
    add(
        key,
        lambda t, columns=columns: features.features(t).select("transaction_id", *(F.round(c, 9).alias(c) if c.endswith("mean") else F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) if c != "prev_location" else F.col(c) for c in columns)),
        S.FEATURES,
        "SELECT transaction_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" if c.endswith("mean") else c if c == "prev_location" else f"coalesce(CAST({c} AS BIGINT), -1) AS {c}" for c in columns) + " FROM f",
    )
for key, columns in {
    "r01_velocity_rule": "velocity_count_5min, velocity_ratio_to_baseline, flag_velocity", "r02_amount_rule": "amount_ratio_to_avg, flag_amount",
    "r03_geo_rule": "implied_speed_kmh, flag_geo", "r04_triggered_rules": "triggered_rules", "r05_is_flagged": "is_flagged",
    "r06_rounding": "velocity_ratio_to_baseline, amount_ratio_to_avg, implied_speed_kmh",
}.items():
    add(key, lambda t, columns=columns: rules.detect(t).select("transaction_id", *columns.split(", ")), S.RULES, f"SELECT transaction_id, {columns} FROM d")
add("a02_processed_count", lambda t: t.groupBy("account_id").agg(F.count("*").alias("n")), S.TX, "SELECT account_id, count(*) AS n FROM tx GROUP BY 1")
add("a03_total_flags", lambda t: risk.scores(rules.detect(t)).select("account_id", "total_flags"), S.SCORES, "SELECT account_id, total_flags FROM scores")
add("a04_flags_by_rule", lambda t: risk.scores(rules.detect(t)).select("account_id", "amount_flags", "geo_flags", "velocity_flags"), S.SCORES, "SELECT account_id, amount_flags, geo_flags, velocity_flags FROM scores")
add("a05_risk_score", lambda t: risk.scores(rules.detect(t)).select("account_id", "risk_score"), S.SCORES, "SELECT account_id, risk_score FROM scores")
add("f14_risk_level", lambda t: risk.scores(rules.detect(t)).select("account_id", "risk_level"), S.SCORES, "SELECT account_id, risk_level FROM levels")
add("a09_label_counts", generator.label_counts, S.TX, "SELECT coalesce(injected_label, 'none') AS label, count(*) AS n FROM tx GROUP BY 1")
_rank = "row_number() OVER (PARTITION BY account_id ORDER BY event_timestamp DESC, transaction_id DESC)"
add("a10_last_explanation", lambda t: (lambda d: risk.status(d, _some_explained(d)).select("account_id", "last_explanation"))(rules.detect(t)), f"{S.RULES}, {S.EXPLAINED}",
    f"SELECT a.account_id, e.explanation AS last_explanation FROM (SELECT DISTINCT account_id FROM tx) a LEFT JOIN (SELECT account_id, transaction_id, {_rank} AS place FROM d WHERE is_flagged) r ON r.account_id = a.account_id AND place = 1 LEFT JOIN explained e ON e.transaction_id = r.transaction_id")
add("o02_explain_backlog", lambda t: (lambda d: explain.backlog(d, _some_explained(d), 50))(rules.detect(t)), f"{S.RULES}, {S.EXPLAINED}",
    f"SELECT {', '.join(explain.FACTS)} FROM d WHERE is_flagged AND transaction_id NOT IN (SELECT transaction_id FROM explained) ORDER BY event_timestamp, transaction_id LIMIT 50")
add("o03_recent_flags", lambda t: risk.recent(rules.detect(t)).select("account_id", "place", "transaction_id", "event_timestamp", "triggered_rules"), S.RULES,
    f"SELECT * FROM (SELECT account_id, CAST({_rank} AS INTEGER) AS place, transaction_id, event_timestamp, triggered_rules FROM d WHERE is_flagged) WHERE place <= {C.RECENT_FLAGS}")
add("p07_unexplained", lambda t: (lambda d: risk.flagged(d).join(_some_explained(d), "transaction_id", "left_anti").select("transaction_id"))(rules.detect(t)), f"{S.RULES}, {S.EXPLAINED}",
    "SELECT transaction_id FROM d WHERE is_flagged AND transaction_id NOT IN (SELECT transaction_id FROM explained)")


def _flat(status: DataFrame) -> DataFrame:
    """The document with its nested parts as text, so that engines can be compared."""
    flags = [F.concat(F.lit(f"{r}="), F.col("flags_by_rule")[r].cast("string")) for r in sorted(C.RULES)]
    return status.select(
        "account_id", "risk_score", "risk_level", "total_flags", "total_processed_transactions", F.concat_ws(",", *flags).alias("flags_by_rule"), "last_explanation",
        F.array_join(F.transform("recent_flags", lambda x: F.concat_ws("|", x["transaction_id"], x["event_timestamp"], F.array_join(x["triggered_rules"], "+"))), ";").alias("recent_flags"),
    )


_recent = f"(SELECT account_id, transaction_id, event_timestamp, triggered_rules, {_rank} AS place FROM d WHERE is_flagged)"
_status = f"""SELECT l.account_id, risk_score, risk_level, total_flags, total_processed_transactions,
  'amount=' || amount_flags || ',geo=' || geo_flags || ',velocity=' || velocity_flags AS flags_by_rule,
  (SELECT e.explanation FROM {_recent} r JOIN explained e USING (transaction_id) WHERE r.account_id = l.account_id AND place = 1) AS last_explanation,
  coalesce((SELECT string_agg(transaction_id || '|' || strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '|' || replace(triggered_rules, ',', '+'), ';' ORDER BY place) FROM {_recent} r WHERE r.account_id = l.account_id AND place <= {C.RECENT_FLAGS}), '') AS recent_flags FROM levels l"""
add("g01_account_risk_status", lambda t: (lambda d: _flat(risk.status(d, _some_explained(d))))(rules.detect(t)), f"{S.SCORES}, {S.EXPLAINED}", _status)
add("g02_unknown_account", lambda t: _flat(risk.status(rules.detect(t).where("account_id = 'nobody'"), None, t.sparkSession.createDataFrame([("nobody",)], "account_id string"))), "one AS (SELECT 1)",
    "SELECT 'nobody' AS account_id, 0.0::DOUBLE AS risk_score, 'none' AS risk_level, 0::BIGINT AS total_flags, 0::BIGINT AS total_processed_transactions, 'amount=0,geo=0,velocity=0' AS flags_by_rule, NULL::VARCHAR AS last_explanation, '' AS recent_flags")
_facts = "concat_ws(chr(10), CASE WHEN flag_velocity THEN '- velocity (precision in testing: 26%): ' || velocity_text END, CASE WHEN flag_amount THEN '- amount (precision in testing: 100%): ' || amount_text END, CASE WHEN flag_geo THEN '- geo (precision in testing: 50%): ' || geo_text END)"
add("l02_prompt_text", lambda t: risk.flagged(rules.detect(t)).select("transaction_id", explain.prompt().alias("prompt")), S.TEXT,
    f"SELECT transaction_id, 'Transaction: account ' || account_id || ', $' || printf('%.2f', amount) || ' at ' || merchant || ' in ' || label || ' on ' || strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') || '.' || chr(10) || chr(10) || 'Rule(s) triggered:' || chr(10) || {_facts} || chr(10) || chr(10) || 'Write the one-sentence explanation. Use the country names given, not the raw two-letter codes, and do not reinterpret them as anything else (e.g. US states).' AS prompt FROM t")
add("l07_template_explanations", lambda t: explain.explain(risk.flagged(rules.detect(t))).select("transaction_id", "explanation"), S.TEXT,
    "SELECT transaction_id, 'Flagged because ' || concat_ws('; ', CASE WHEN flag_amount THEN amount_text END, CASE WHEN flag_geo THEN 'it may be relevant that the ' || geo_text END, CASE WHEN flag_velocity THEN 'there were ' || velocity_text || ', though this signal is more often than not a false positive' END) || '.' AS explanation FROM t")


def _twice(t: DataFrame) -> DataFrame:
    d = rules.detect(t)
    again = _some_explained(d).where(F.col("transaction_id").cast("long") % 2 == 0)
    again = again.withColumns({"explanation": F.concat(F.lit("again "), "explanation"), "explained_at": F.lit("2026-01-02").cast("timestamp")})
    return explain.with_explanations(risk.flagged(d), _some_explained(d).union(again)).select("transaction_id", "explanation")


add("k06_latest_explanation", _twice, f"{S.RULES}, {S.EXPLAINED}",
    "SELECT d.transaction_id, CASE WHEN CAST(d.transaction_id AS BIGINT) % 2 = 0 THEN 'again ' || explanation ELSE explanation END AS explanation FROM d LEFT JOIN explained e ON e.transaction_id = d.transaction_id WHERE is_flagged")


def _quality(flag: str, truth: str, rule: str | None = None) -> str:
    named = f", '{rule}' AS rule" if rule else ""
    return f"SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END, 4) AS recall{named} FROM (SELECT count(*) FILTER (WHERE {flag} AND {truth}) AS tp, count(*) FILTER (WHERE {flag} AND NOT {truth}) AS fp, count(*) FILTER (WHERE NOT {flag} AND {truth}) AS fn FROM d)"


_true = {r: f"coalesce(injected_label = '{label}', false)" for r, label in C.LABEL_OF_RULE.items()}
add("e01_rule_quality", lambda t: evaluate.by_rule(_detected(t)), S.RULES, " UNION ALL ".join(_quality(f"flag_{r}", _true[r], r) for r in C.LABEL_OF_RULE))
add("e02_overall_quality", lambda t: evaluate.overall(_detected(t)), S.RULES, _quality("is_flagged", "injected_label IS NOT NULL"))
add("e03_velocity_sweep", lambda t: evaluate.velocity_sweep(_detected(t)), S.RULES, " UNION ALL ".join(
    f"SELECT {k}::DOUBLE AS factor, count(*) FILTER (WHERE baseline_count >= 1 AND velocity_count > CAST(baseline_mean AS DOUBLE) * {k}) AS flagged, count(*) FILTER (WHERE baseline_count >= 1 AND velocity_count > CAST(baseline_mean AS DOUBLE) * {k} AND {_true['velocity']}) AS tp FROM d" for k in C.SWEEP))
add("e04_straddle_confusion", lambda t: evaluate.straddle(_detected(t)), S.RULES, f"SELECT speed > 900 AS above, flag_geo, count(*) AS n FROM d WHERE {_true['geo']} AND speed > 0 GROUP BY 1, 2")
add("e05_label_only", lambda t: evaluate.quality(_detected(t), F.col("flag_geo"), F.coalesce(F.col("injected_label") == "impossible_travel", F.lit(False))), S.RULES, _quality("flag_geo", _true["geo"]))
add("e06_echo_flags", lambda t: evaluate.echoes(_detected(t)), S.RULES,
    "SELECT label_before, coalesce(injected_label, 'none') AS label, count(*) AS n FROM (SELECT *, coalesce(lag(injected_label) OVER (PARTITION BY account_id ORDER BY ms, transaction_id), 'none') AS label_before FROM d) WHERE flag_geo GROUP BY 1, 2")
add("e07_speed_distribution", lambda t: evaluate.speeds(_detected(t)), S.RULES, f"SELECT count(*) AS n, round(quantile_cont(round(speed, 1), 0.5), 1) AS median_speed, round(min(speed), 1) AS min_speed FROM d WHERE {_true['geo']} AND prev_ms IS NOT NULL AND speed > 0")
add("e08_window_ratio", lambda t: evaluate.window_ratios(_detected(t)), S.RULES,
    "SELECT coalesce(injected_label, 'none') AS label, count(*) AS n, round(avg(velocity_count / CAST(baseline_mean AS DOUBLE)), 6) AS mean_ratio, round(max(velocity_count / CAST(baseline_mean AS DOUBLE)), 6) AS max_ratio FROM d WHERE baseline_count >= 1 GROUP BY 1")
for key, job in (("t01_stateful_detect", jobs.stateful_detect), ("t08_replay", jobs.replay_events)):
    QUERIES[key] = lambda spark, sf_dir, job=job: ntz(job(spark, sf_dir))
    ORACLE_SQL[key] = ORACLE_SQL["r07_detect"]
QUERIES["t05_foreach_batch"] = jobs.fan_out
ORACLE_SQL["t05_foreach_batch"] = S.query(S.RULES, "SELECT transaction_id, is_flagged, triggered_rules, 'processed' AS sink FROM d UNION ALL SELECT transaction_id, is_flagged, triggered_rules, 'flagged' FROM d WHERE is_flagged")


# The generated stream's draws are hashes that SQL engines do not share, so what holds of every event is counted: how many break it.
def _home_of(tx: DataFrame, n_accounts: int) -> DataFrame:
    return tx.join(F.broadcast(generator.accounts(tx.sparkSession, n_accounts)).drop("id"), "account_id")


def _generated(key: str, mode: str, label: str | None, breaks: Callable[[], Column], turns: int = 5000, n_accounts: int = 100) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _home_of(_detected(generator.transactions(spark, turns, mode=mode, n_accounts=n_accounts)), n_accounts)
        wanted = rows.where(F.col("injected_label").isNull() if label is None else F.col("injected_label") == label).withColumn("breaks", breaks())
        wrong = F.coalesce("breaks", F.lit(True)) | ~F.col("location").isin(C.CODES) | ~F.col("merchant").isin(C.MERCHANTS) | (F.col("amount") < 1)
        return wanted.agg((F.count("*") > 50).alias("found"), F.count_if(wrong).alias("broken"), (F.count("*") - F.count_distinct("transaction_id")).alias("repeated"))

    QUERIES[key] = run
    ORACLE_SQL[key] = "SELECT true AS found, 0::BIGINT AS broken, 0::BIGINT AS repeated"


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = generator.accounts(spark).drop("id")
    named = F.col("account_id").rlike("^acct_[0-9]{5}$") & F.col("home").isin(C.CODES) & F.col("historical_avg").between(30, 300)
    return known.agg(F.count("*").alias("n"), F.count_distinct("account_id").alias("ids"), F.count_distinct("home").alias("homes"), F.count_if(~named).alias("broken"))


QUERIES["n01_accounts"] = _accounts
ORACLE_SQL["n01_accounts"] = f"SELECT 500::BIGINT AS n, 500::BIGINT AS ids, {len(C.CODES)}::BIGINT AS homes, 0::BIGINT AS broken"
_ratio = lambda: F.col("amount") / F.col("historical_avg")
_at_home = lambda: F.col("location") != F.col("home")
# a speed is rounded by the clock's milliseconds; travel that takes none would be no travel
_timed = lambda low, high: lambda: (F.col("prev_ms").isNull()) | ~F.col("speed").between(low - 1, high + 1)
_generated("n04_normal_events", "random", None, lambda: _at_home() | (_ratio() > 3))
_generated("n05_random_travel", "random", "impossible_travel", lambda: ~_at_home())
_generated("n06_borderline", "borderline", "impossible_travel", _timed(*generator.SPEEDS["borderline"]))
_generated("n07_straddle", "straddle", "impossible_travel", _timed(*generator.SPEEDS["straddle"]))
_generated("n08_amount_spike", "random", "amount_spike", lambda: _at_home() | ~_ratio().between(generator.SPIKE[0] - 0.01, generator.SPIKE[1] + 0.01))
_generated("n09_velocity_burst", "random", "velocity_burst", lambda: _at_home() | (F.count("*").over(Window.partitionBy(F.substring("transaction_id", 1, 12))).between(*generator.BURST) == F.lit(False)))
