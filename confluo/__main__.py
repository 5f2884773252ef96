"""Command line: ``python -m confluo init|validate|ingest|federate|run|export [NAME] [--root FOLDER]``.

An instance's own callables come from ``plugins.py`` in its folder: a dictionary ``PLUGINS`` with any of
``fetchers``, ``cleaners``, ``transforms``, ``links`` and ``exporters``.
"""

from __future__ import annotations

import argparse
import os
import runpy
import sys

from pyspark.sql import DataFrame, SparkSession

from confluo import config
from confluo.plans.engine import Pipeline
from confluo.plans.storage import join


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="confluo")
    parser.add_argument("command", nargs="?", default="run", choices=["init", "validate", "ingest", "federate", "run", "export"])
    parser.add_argument("name", nargs="?", help="exporter, for export")
    parser.add_argument("--root", default=os.getcwd())
    given = parser.parse_args(arguments)
    if given.command == "init":
        try:
            config.scaffold(given.root)
        except FileExistsError as e:
            print(e, file=sys.stderr)
            return 1
        print(f"wrote {config.CONFIG_FILE} and two sources - edit them, then run")
        return 0
    spark = SparkSession.builder.appName("confluo").getOrCreate()
    plugins = os.path.join(given.root, "plugins.py")
    own = runpy.run_path(plugins)["PLUGINS"] if os.path.exists(plugins) else {}
    pipeline = Pipeline(spark, given.root, **own)
    faults = pipeline.validate()
    if faults:
        print("\n".join(faults), file=sys.stderr)
        return 1
    if given.command == "validate":
        print("instance valid")
    elif given.command == "ingest":
        pipeline.lift()
    elif given.command == "federate":
        pipeline.publish(pipeline.federate())
    elif given.command == "run":
        pipeline.run(graphs=True)
    else:
        try:
            out = pipeline.export(given.name)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        if isinstance(out, DataFrame):
            out.write.mode("overwrite").json(join(pipeline.state, "exports", given.name))
        else:
            sys.stdout.buffer.write(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
