"""python -m ledgerloom list | run NAME DIR | plan DIR | replay DIR | report DIR | record DIR DATE"""

from __future__ import annotations

import sys

USAGE = __doc__


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import catalog
    from .report import render

    if args == ["list"]:
        print("\n".join(sorted(catalog.queries())))
        return 0
    if len(args) < 2 or args[0] not in ("run", "plan", "replay", "report", "record"):
        print(USAGE)
        return 2
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    if args[0] == "report":
        print(render.report(spark, args[1]))
        return 0
    if args[0] == "record":
        print(render.record(spark, args[1], args[2] if len(args) > 2 else ""))
        return 0
    name, sf_dir = (args[1], args[2]) if args[0] == "run" else ({"plan": "plan_table", "replay": "mixed_table"}[args[0]], args[1])
    print(render.markdown(catalog.queries()[name](spark, sf_dir)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
