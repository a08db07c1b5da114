import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import explain, risk, rules
from tallybrook.programs import detect, publish, serve
from tallybrook.programs import explain as explainer
from tallybrook.sources import generator
from tallybrook.sources.database import Database
from tallybrook.sources.transactions import transactions
from tests.test_streaming import OTHER_TABLES, RESULT_TABLES, SF, derby


@pytest.fixture(scope="module")
def database(spark):
    url = derby(spark, "programs", *RESULT_TABLES, *OTHER_TABLES)
    found = rules.detect(transactions(spark, SF))
    made = Database(spark, url)
    made.append(found, "processed_transactions")
    made.append(found.where("is_flagged"), "flagged_transactions")
    return made


def test_explanations_of_the_oldest_and_of_named_ones(spark, database):
    said, calls = [], []
    given = explainer.arguments(["--limit", "3", "--postgres-url", database.url, "--template"])
    assert explainer.run(spark, given, say=said.append) == 3
    oldest = [r.transaction_id for r in database.flagged().orderBy("event_timestamp", "transaction_id").limit(4).collect()]
    assert sorted(r.transaction_id for r in database.explanations().collect()) == sorted(oldest[:3])
    assert said[0] == "explained 3 transactions" and len(said) == 4
    again = explainer.arguments(["--transaction-ids", f" {oldest[3]},, {oldest[0]} ", "--postgres-url", database.url])
    assert explainer.run(spark, again, call=lambda m: "because " + m.split("account ")[1][:10], per_minute=60_000, say=calls.append) == 2
    newest = {r.transaction_id: r.explanation for r in explain.latest_explanations(database.explanations()).collect()}
    assert len(newest) == 4 and newest[oldest[0]].startswith("because acct_") and newest[oldest[1]].startswith("Flagged because")
    shown = database.explained()
    assert shown.count() == database.flagged().count() and {r.transaction_id for r in shown.where("explanation is not null").collect()} == set(newest)
    with pytest.raises(SystemExit):
        explainer.run(spark, explainer.arguments(["--postgres-url", database.url]))


def test_the_tool_answers(database):
    account = database.flagged().first().account_id
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    call = lambda i, a: ask(i, "tools/call", name=serve.TOOL["name"], arguments={"account_id": a})
    lines = [
        ask(1, "initialize", protocolVersion="2024-11-05"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "", ask(2, "tools/list"), call(3, account), call(4, "nobody"),
        ask(5, "tools/call", name="other"), ask(6, "prompts/list"), "{", "[]", ask(7, "ping"),
    ]
    said = []
    serve.serve(lines, lambda x: said.append(json.loads(x)), serve.status_of(database))
    by_id = {r["id"]: r for r in said if r["id"]}
    assert by_id[1]["result"]["protocolVersion"] == "2024-11-05" and by_id[2]["result"]["tools"][0]["name"] == "get_account_risk_status"
    own = database.account(account)
    found = by_id[3]["result"]["structuredContent"]
    assert found["total_processed_transactions"] == own.count() and found["total_flags"] == own.where("is_flagged").count() == len(found["recent_flags"][:20])
    assert json.loads(by_id[3]["result"]["content"][0]["text"]) == found and found["risk_score"] == risk.scores(own).first().risk_score
    assert by_id[4]["result"]["structuredContent"]["risk_level"] == "none"
    assert (by_id[5]["error"]["code"], by_id[6]["error"]["code"], by_id[7]["result"]) == (-32602, -32601, {})
    assert [r["error"]["code"] for r in said if r["id"] is None] == [-32700, -32600]
    broken = []
    serve.serve([call(1, "a")], lambda x: broken.append(json.loads(x)), lambda a: 1 / 0)
    assert broken[0]["result"]["isError"]


def test_publishing_keeps_to_the_rate_and_the_duration(spark):
    given = generator.arguments(["--rate", "20", "--accounts", "30", "--duration", "12", "--anomaly-rate", "0.3"])
    clock, sent, said = [1_767_225_600.0], [], []
    sent_rows = publish.run(spark, given, sent.append, now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s), say=said.append)
    assert len(sent) == 3 and clock[0] - 1_767_225_600.0 == 10.0 and sum(sent_rows.values()) == generator.transactions(spark, 240, 20.0, 30, 0.3, start="2026-01-01 00:00:00").count()
    assert set(sent_rows) == {"none", *generator.ANOMALIES} and said[-1].startswith(f"sent={sum(sent_rows.values())} ")


def test_publishing_stops(spark):
    given = generator.arguments(["--rate", "20", "--accounts", "30"])

    def interrupted(tx):
        raise KeyboardInterrupt

    def unreachable(tx):
        raise OSError("refused")

    said = []
    assert not publish.run(spark, given, interrupted, sleep=lambda s: None, say=said.append) and said[-1] == "stopped"
    with pytest.raises(SystemExit, match="no broker"):
        publish.run(spark, given, unreachable, sleep=lambda s: None, say=said.append)
    with pytest.raises(SystemExit):
        publish.run(spark, generator.arguments(["--rate", "0"]), unreachable)
    assert detect.arguments(["--checkpoint", "x", "--ttl-hours", "2"]).ttl_hours == 2


def test_the_chat_client():
    seen = []

    def post(request, timeout):
        seen.append((request.full_url, json.loads(request.data), request.get_header("Authorization"), timeout))
        return json.dumps({"choices": [{"message": {"content": " one sentence \n"}}]})

    client = explain.ChatClient("http://there/v1/", "small", "key", post=post)
    assert explain.with_retries(client, "facts") == "one sentence"
    url, body, key, timeout = seen[0]
    assert (url, key, timeout, body["temperature"], body["max_tokens"]) == ("http://there/v1/chat/completions", "Bearer key", 30.0, 0.3, 150)
    assert [m["content"] for m in body["messages"]] == [explain.INSTRUCTION, "facts"]


def test_the_chat_client_waits_as_it_is_asked():
    waits, answers = [], [urllib.error.HTTPError("u", 429, "slow down", {"retry-after": "7"}, io.BytesIO()), urllib.error.URLError("gone"), TimeoutError()]

    def post(request, timeout):
        if answers:
            raise answers.pop(0)
        return json.dumps({"choices": [{"message": {"content": "done"}}]})

    client = explain.ChatClient("http://there/v1", "small", "key", post=post)
    assert explain.with_retries(client, "x", waits.append) == "done"
    assert [int(w) for w in waits] == [7, 4, 8]
    with pytest.raises(KeyError):  # not the service's fault: no second try
        explain.with_retries(explain.ChatClient("http://u", "m", "k", post=lambda r, t: '{"other": 1}'), "x", waits.append)
    assert len(waits) == 3
    assert [int(p) for p in explain.pauses(lambda: 0.5)] == [2, 4, 8, 16, 32]


def test_generated_accounts_are_the_same_in_every_run(spark):
    a, b = generator.accounts(spark, 40).collect(), generator.accounts(spark, 60).where("id < 40").collect()
    assert a == b and len({r.account_id for r in a}) == 40 and generator.accounts(spark, 40).where(F.col("historical_avg").between(30, 300)).count() == 40
