"""Front ends: ``python -m annalist --folder F <tool> [--name value ...]``, ``ingest``, and ``serve`` for calls in JSON lines."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from typing import TextIO

from annalist import api


def serve(store: api.History, lines: TextIO, out: TextIO) -> None:
    """Answer calls, one JSON object a line: {"id", "tool", "arguments"} gives {"id", "result"} or {"id", "error"}."""
    for line in lines:
        if not line.strip():
            continue
        key = None
        try:
            asked = json.loads(line)
            if not isinstance(asked, dict):
                raise ValueError("a call is an object")
            key = asked.get("id")
            if asked.get("tool") == "list":
                answer = {"id": key, "result": {k: list(v) for k, v in api.TOOLS.items()}}
            else:
                answer = {"id": key, "result": api.call(store, asked.get("tool"), asked.get("arguments") or {})}
        except Exception as e:  # one bad call must not end the server
            answer = {"id": key, "error": f"{type(e).__name__}: {e}".split("\n")[0]}
        print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="annalist")
    parser.add_argument("--folder", required=True, help="of the stored tables")
    commands = parser.add_subparsers(dest="command", required=True)
    add = commands.add_parser("ingest", help="add what is new of a repository")
    add.add_argument("path")
    add.add_argument("repo_id", nargs="?", help="owner/name; without it the remote's")
    add.add_argument("--window", default="full")
    add.add_argument("--pulls", help="JSON export")
    add.add_argument("--issues", help="JSON export")
    commands.add_parser("serve", help="answer calls in JSON lines")
    for tool, names in api.TOOLS.items():
        sub = commands.add_parser(tool.replace("_", "-"))
        sub.set_defaults(tool=tool)
        for name in names:
            sub.add_argument(f"--{name.replace('_', '-')}", type=_value, dest=f"arg_{name}")
    return parser


def main(argv: list[str] | None = None, spark=None) -> None:
    from pyspark.sql import SparkSession

    from annalist.sources import history

    given = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("annalist").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = api.History(spark, given.folder)
    if given.command == "ingest":
        pulls = history.read_pulls(spark, given.pulls) if given.pulls else None
        issues = history.read_issues(spark, given.issues) if given.issues else None
        store.ingest(given.path, given.repo_id, given.window, datetime.date.today(), pulls, issues)
    elif given.command == "serve":
        serve(store, sys.stdin, sys.stdout)
    else:
        arguments = {k[4:]: v for k, v in vars(given).items() if k.startswith("arg_") and v is not None}
        print(json.dumps(api.call(store, given.tool, arguments), ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()
