"""Command line: run, search, gen, test."""

from __future__ import annotations

import argparse
import sys
import threading
from dataclasses import fields

from pyspark.sql import SparkSession

from .config import Config
from .engine import PRUNING, Engine
from .http_api import server


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--config", default="tidemark.yml")
    parser.add_argument("--profile", metavar="FOLDER", help="write Spark's event log there, for its history server")
    for f in fields(Config):
        parser.add_argument("--" + f.name.replace("_", "-"), type=int if f.type == "int" else str, default=None)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="ingest again and again, and answer over HTTP if a port is given")
    run.add_argument("--port", type=int, default=0)
    run.add_argument("--host", default="127.0.0.1")
    commands.add_parser("gen", help="print the settings")
    commands.add_parser("test", help="try the settings on one file")
    find = commands.add_parser("search", help="print matching messages")
    find.add_argument("query")
    find.add_argument("--date-from")
    find.add_argument("--date-to")
    find.add_argument("--pruning", choices=PRUNING, default="prefix", help="how the index rules out segments; exact and none find literals amid terms too")
    said = parser.parse_args(args)
    try:
        with open(said.config) as file:
            text = file.read()
    except FileNotFoundError:
        text = ""
    config = Config.from_yaml(text, **{f.name: getattr(said, f.name) for f in fields(Config)})
    if said.command == "gen":
        print(config.to_yaml(), end="")
        return 0
    builder = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC")
    if said.profile:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", said.profile)
    spark = builder.getOrCreate()
    try:
        engine = Engine(spark, config)
        if said.command == "test":
            print("OK:", engine.test_config())
        elif said.command == "run":
            if said.port:
                threading.Thread(target=server(engine, said.port, said.host).serve_forever, daemon=True).start()
            engine.run()
        else:
            for row in engine.bodies(engine.search(said.query, said.date_from, said.date_to, said.pruning)).toLocalIterator():
                print(row.text, end="")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
