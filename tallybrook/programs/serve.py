"""Serves an account's risk status as a tool, by the Model Context Protocol over standard input and output: a JSON message a line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import functions as F

from tallybrook.operators import explain, risk
from tallybrook.programs import session
from tallybrook.sources.database import Database

PROTOCOL = "2025-06-18"
TOOL = {
    "name": "get_account_risk_status",
    "description": "An account's risk score and level, its flags by rule, and its newest flagged transactions with their rules and explanations.",
    "inputSchema": {"type": "object", "properties": {"account_id": {"type": "string"}}, "required": ["account_id"]},
}


class Failure(Exception):
    def __init__(self, code: int, reason: str):
        super().__init__(reason)
        self.code = code


def answer(request: dict, status: Callable[[str], dict]) -> dict:
    """The result of one request."""
    method, given = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return {"protocolVersion": given.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "risk-status", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [TOOL]}
    if method != "tools/call":
        raise Failure(-32601, f"no method {method}")
    account = (given.get("arguments") or {}).get("account_id")
    if given.get("name") != TOOL["name"] or not isinstance(account, str):
        raise Failure(-32602, f"{TOOL['name']} with an account_id is all there is")
    try:
        found = status(account)
    except Exception as error:  # a tool's failure is its result
        return {"content": [{"type": "text", "text": f"{type(error).__name__}: {error}"}], "isError": True}
    return {"content": [{"type": "text", "text": json.dumps(found)}], "structuredContent": found, "isError": False}


def serve(lines: Iterable[str], say: Callable[[str], None], status: Callable[[str], dict]) -> None:
    """Answers each request; notifications, which have no id, get no answer."""
    for line in filter(str.strip, lines):
        reply: dict = {"jsonrpc": "2.0", "id": None}
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise Failure(-32600, "a request is an object")
            if "id" not in request:
                continue
            reply["id"] = request["id"]
            reply["result"] = answer(request, status)
        except json.JSONDecodeError as error:
            reply["error"] = {"code": -32700, "message": str(error)}
        except Failure as error:
            reply["error"] = {"code": error.code, "message": str(error)}
        say(json.dumps(reply))


def status_of(database: Database) -> Callable[[str], dict]:
    """Reads the one account's rows, and the explanations of its flagged ones."""

    def status(account_id: str) -> dict:
        rows = database.account(account_id)
        own = rows.where("is_flagged").select("transaction_id")
        explained = explain.latest_explanations(database.explanations().join(own, "transaction_id", "left_semi"))
        return risk.account_status(rows.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp")), account_id, explained)

    return status


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--postgres-url", default=None)
    given = parser.parse_args(args)
    serve(sys.stdin, lambda line: print(line, flush=True), status_of(Database(session("risk-status"), given.postgres_url)))


if __name__ == "__main__":
    main()
