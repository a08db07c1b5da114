"""Runs the detection stream from the broker to the database."""

from __future__ import annotations

import argparse

from tallybrook.programs import session
from tallybrook.streaming import jobs


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--checkpoint", required=True, help="shared folder of state and rejects")
    parser.add_argument("--postgres-url", default=None)
    parser.add_argument("--ttl-hours", type=float, default=None, help="forget an account that was not seen for so long")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    given = arguments(args)
    spark = session("detect")
    spark.streams.addListener(jobs.Progress())
    ttl = None if given.ttl_hours is None else int(given.ttl_hours * 3_600_000)
    jobs.run(spark, given.checkpoint, given.postgres_url, ttl_ms=ttl)
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
