"""Command line: store, recall, search, inspect, consolidate, models, serve (HTTP), mcp (JSON-RPC over standard input and output)."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from mnestra import providers, serve
from mnestra.engine import MemoryEngine
from mnestra.sources.config import load


def split_tags(text: str | None) -> list[str]:
    return [t.strip() for t in text.split(",")] if text is not None else []


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="mnestra")
    parser.add_argument("--project")
    parser.add_argument("--directory", default=".")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, key in (("store", "content"), ("recall", "query"), ("search", "query"), ("consolidate", "session_id")):
        p = sub.add_parser(name)
        p.add_argument(key)
        p.add_argument("--tags")
        p.add_argument("--limit", type=int)
        p.add_argument("--importance", type=float)
        p.add_argument("--memory-type")
        p.add_argument("--since")
        p.add_argument("--source-session")
    for name in ("inspect", "models", "mcp"):
        sub.add_parser(name)
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=3000)
    args = vars(parser.parse_args(argv))
    if args["command"] == "models":
        text = json.dumps({"providers": sorted(providers.PROVIDERS), "embedders": sorted(providers.EMBEDDERS)}, indent=1)
        print(text)
        return text
    spark = spark or SparkSession.builder.appName("mnestra").getOrCreate()
    engine = MemoryEngine(spark, load(args.pop("project"), args.pop("directory")))
    command = args.pop("command")
    if command == "serve":
        with serve.http_server(engine, args["host"], args["port"]) as server:
            server.serve_forever()
        return ""
    if command == "mcp":
        serve.serve_stdio(engine)
        return ""
    given = {k: split_tags(v) if k == "tags" else v for k, v in args.items() if v is not None}
    out = engine.stats() if command == "inspect" else engine.call_tool(f"mem_{command}", given)
    text = json.dumps(out, default=str, ensure_ascii=False, indent=1)
    print(text)
    return text


if __name__ == "__main__":
    main()
