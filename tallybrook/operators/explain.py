"""Explanations of flagged transactions through a pluggable back-end."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.config import PRECISION_HUNDREDTHS, RULES
from tallybrook.functions.labels import country_label, decimals
from tallybrook.operators.risk import flagged
from tallybrook.schemas import EXPLANATION

FACTS = ["transaction_id", "account_id", "amount", "merchant", "location", "event_timestamp", "triggered_rules", "velocity_count_5min", "velocity_ratio_to_baseline", "amount_ratio_to_avg", "implied_speed_kmh"]

#: Instruction for a model back-end.
INSTRUCTION = (
    "Explain in one plain English sentence why the rule engine flagged this transaction. Use only the rules and numbers below, and the country names "
    "as they are written. State rules with a precision of 0.9 or more directly, hedge those between 0.4 and 0.7, and say of those below 0.4 that "
    "they are often false alarms. Cover each rule. Answer with the sentence alone."
)
CALLS_PER_MINUTE, ATTEMPTS, LONGEST_WAIT = 35, 6, 60.0


def rule_detail(rule: str) -> Column:
    """Fixed wording of a rule's facts."""
    ratio = lambda c: decimals(F.col(c), 1)
    return {
        "amount": F.concat(F.lit("amount $"), decimals(F.col("amount"), 2), F.lit(" is "), ratio("amount_ratio_to_avg"), F.lit("x this account's historical average transaction amount")),
        "geo": F.concat(F.lit("implied travel speed from this account's previous transaction location to "), country_label(F.col("location")), F.lit(" was "), F.format_number(F.round("implied_speed_kmh", 0), 0), F.lit(" km/h")),
        "velocity": F.concat(F.col("velocity_count_5min").cast("string"), F.lit(" transactions in the trailing 5 minutes for this account, "), ratio("velocity_ratio_to_baseline"), F.lit("x its own average count per completed 5-minute window")),
    }[rule]


def prompt() -> Column:
    """Fixed wording of the message that gives a back-end its facts."""
    rules = F.split("triggered_rules", ",")
    fact = lambda r: F.when(F.array_contains(rules, r), F.concat(F.lit(f"- {r} (precision in testing: {PRECISION_HUNDREDTHS[r]}%): "), rule_detail(r)))
    return F.concat(
        F.lit("Transaction: account "), F.col("account_id"), F.lit(", $"), decimals(F.col("amount"), 2), F.lit(" at "), F.col("merchant"), F.lit(" in "), country_label(F.col("location")),
        F.lit(" on "), F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(".\n\nRule(s) triggered:\n"), F.concat_ws("\n", *(fact(r) for r in RULES)),
        F.lit("\n\nWrite the one-sentence explanation. Use the country names given, not the raw two-letter codes, and do not reinterpret them as anything else (e.g. US states)."),
    )


def template_explanation() -> Column:
    """A deterministic back-end: one sentence, its confidence graded by each rule's precision."""
    rules = F.split("triggered_rules", ",")

    def part(rule: str) -> Column:
        p = PRECISION_HUNDREDTHS[rule]
        before, after = ("", "") if p >= 90 else ("it may be relevant that the ", "") if p >= 40 else ("there were ", ", though this signal is more often than not a false positive")
        return F.when(F.array_contains(rules, rule), F.concat(F.lit(before), rule_detail(rule), F.lit(after)))

    return F.concat(F.lit("Flagged because "), F.concat_ws("; ", *(part(r) for r in ("amount", "geo", "velocity"))), F.lit("."))


def latest_explanations(explanations: DataFrame) -> DataFrame:
    """The newest row of each transaction: explanations are appended, never updated."""
    newest = Window.partitionBy("transaction_id").orderBy(F.desc("explained_at"), F.desc("explanation"))
    return explanations.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def with_explanations(flags: DataFrame, explanations: DataFrame) -> DataFrame:
    """Flagged rows with explanation and explained_at, null where there is none."""
    return flags.join(latest_explanations(explanations), "transaction_id", "left")


def backlog(processed: DataFrame, explanations: DataFrame, limit: int = 50, ids: list[str] | None = None) -> DataFrame:
    """The oldest flagged rows without an explanation; or the rows of `ids`, explained or not."""
    rows = flagged(processed).select(*FACTS)
    if ids:
        return rows.where(F.col("transaction_id").isin(ids))
    open_ = rows.join(explanations.where("explanation is not null").select("transaction_id"), "transaction_id", "left_anti")
    return open_.orderBy("event_timestamp", "transaction_id").limit(limit)


def parse_ids(text: str | None) -> list[str] | None:
    """Ids between commas; empty items are no ids, and without any there is no list."""
    return [x for x in map(str.strip, (text or "").split(",")) if x] or None


class Retryable(Exception):
    """A failure of the service that may pass; `after` is the pause it asked for, in seconds."""

    def __init__(self, reason: str, after: float | None = None):
        super().__init__(reason)
        self.after = after


def pauses(draw: Callable[[], float] = random.random) -> Iterator[float]:
    """The pauses between tries: twice as long from try to try up to LONGEST_WAIT, each with up to a second more, so that
    callers that failed together do not come back together."""
    length = 2.0
    for _ in range(ATTEMPTS - 1):
        yield min(length, LONGEST_WAIT) + draw()
        length *= 2


def with_retries(call: Callable[[str], str], message: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """The trimmed answer. A call that is Retryable is tried again as long as there is a pause left; other errors are the caller's."""
    waits = pauses()
    while True:
        try:
            return call(message).strip()
        except Retryable as failure:
            pause = next(waits, None)
            if pause is None:
                raise
            sleep(pause if failure.after is None else failure.after + pause % 1)


@dataclass(frozen=True)
class ChatClient:
    """A chat-completion service over HTTP, as a call for explain(). `post` sends a request and gives the answer's text."""

    url: str
    model: str
    key: str
    temperature: float = 0.3
    max_tokens: int = 150
    timeout: float = 30.0
    post: Callable[[urllib.request.Request, float], str] | None = None

    def request(self, message: str) -> urllib.request.Request:
        said = [{"role": "system", "content": INSTRUCTION}, {"role": "user", "content": message}]
        body = {"model": self.model, "messages": said, "temperature": self.temperature, "max_tokens": self.max_tokens}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        return urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)

    def __call__(self, message: str) -> str:
        try:
            answer = (self.post or _post)(self.request(message), self.timeout)
        except urllib.error.HTTPError as error:
            asked = error.headers.get("retry-after") if error.headers else None
            raise Retryable(str(error), float(asked) if asked and asked.replace(".", "", 1).isdigit() else None) from error
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            raise Retryable(str(error)) from error
        return json.loads(answer)["choices"][0]["message"]["content"]


def _post(request: urllib.request.Request, timeout: float) -> str:
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode()


def explain(rows: DataFrame, call: Callable[[str], str] | None = None, per_minute: float = CALLS_PER_MINUTE) -> DataFrame:
    """transaction_id, explanation and explained_at. Without a call, by the template; with one, paced in one task, since
    the limit is the service's."""
    if call is None:
        return rows.select("transaction_id", template_explanation().alias("explanation"), F.current_timestamp().alias("explained_at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            for i, message in zip(batch.transaction_id, batch.message, strict=True):
                time.sleep(max(0.0, 60.0 / per_minute - (time.monotonic() - last)) if last else 0)
                answer, last = with_retries(call, message), time.monotonic()
                yield pd.DataFrame({"transaction_id": [i], "explanation": [answer], "explained_at": [pd.Timestamp.now("UTC")]})

    return rows.select("transaction_id", prompt().alias("message")).coalesce(1).mapInPandas(run, EXPLANATION)
