"""Explains flagged transactions that have no explanation yet, oldest first, or the ones that are named."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession

from tallybrook.config import Settings
from tallybrook.operators import explain
from tallybrook.programs import session
from tallybrook.sources.database import EXPLANATIONS, Database


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--limit", type=int, default=50)
    parser.add_argument("--postgres-url", default=None)
    parser.add_argument("--transaction-ids", default=None, help="ids between commas; explained again, whatever the limit")
    parser.add_argument("--template", action="store_true", help="write fixed sentences, without a model")
    return parser.parse_args(args)


def run(
    spark: SparkSession, given: argparse.Namespace, call: Callable[[str], str] | None = None, per_minute: float = explain.CALLS_PER_MINUTE, say: Callable[[str], None] = print
) -> int:
    """Appends the explanations to their table, and says and returns how many."""
    database, settings = Database(spark, given.postgres_url), Settings.from_environment()
    if call is None and not given.template:
        if not settings.api_key:
            raise SystemExit("no API key is set; see the environment or .env, or use --template")
        call = explain.ChatClient(settings.explainer_url, settings.explainer_model, settings.api_key)
    rows = explain.backlog(database.flagged(), database.explanations(), given.limit, explain.parse_ids(given.transaction_ids))
    made = explain.explain(rows, call, per_minute).persist()  # each call is paid for once
    n = made.count()
    say(f"explained {n} transactions")
    if n:
        database.append(made, EXPLANATIONS)
        for r in made.orderBy("transaction_id").limit(n).toLocalIterator():
            say(f"{r.transaction_id}  {r.explanation}")
    made.unpersist()
    return n


def main(args: list[str] | None = None) -> None:
    run(session("explain"), arguments(args))


if __name__ == "__main__":
    main()
