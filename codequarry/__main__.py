"""python -m codequarry index|analyze|report|info|plugins PATH"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codequarry", description="Analyse a code base with Spark.")
    parser.add_argument("command", choices=["index", "analyze", "report", "info", "plugins"])
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("--output-dir", default="")
    parser.add_argument("--plugin", action="append", default=[], help="a built-in profile")
    parser.add_argument("--plugin-module", action="append", default=[])
    parser.add_argument("--policy-file", action="append", default=[])
    parser.add_argument("--tools", action="append", default=[])
    parser.add_argument("--min-confidence")
    parser.add_argument("--category", action="append", default=[])
    parser.add_argument("--reset", action="store_true")
    a = parser.parse_args(argv)
    if a.command == "plugins":
        from codequarry.policy import PROFILES

        print("\n".join(PROFILES))
        return 0
    from codequarry.plans.project import Project

    spark = SparkSession.builder.appName("codequarry").getOrCreate()
    project = Project(spark, a.path, a.output_dir, a.plugin, a.plugin_module, a.policy_file)
    if a.command == "index":
        print(json.dumps(project.index(a.reset)))
    elif a.command == "info":
        print(json.dumps({t: project.store.read(t).count() for t in ("files", "symbols", "dependencies", "envelopes")}))
    else:
        data = project.analyze(a.reset, a.tools, a.min_confidence, set(a.category), reindex=a.command == "analyze")
        print(json.dumps({"health": data["health"], **data["metrics"], "artifacts": data["artifacts"]}, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
