"""python -m tallyframe.cli FILE1 FILE2 (--config FILE | --template FILE | --auto KEY...)"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallyframe.config import ReconConfig, name_mapping
from tallyframe.operators.reconcile import reconcile
from tallyframe.sinks import summary_lines, write_csv, write_json
from tallyframe.sources import open_source
from tallyframe.templates import read_template


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Reconcile two tables.")
    parser.add_argument("file1", help="the source of truth")
    parser.add_argument("file2")
    how = parser.add_mutually_exclusive_group(required=True)
    how.add_argument("--config", help="a JSON configuration")
    how.add_argument("--template", help="a filled-in template")
    how.add_argument("--auto", nargs="+", metavar="KEY", help="map columns of the same name, with these keys")
    parser.add_argument("--profile", choices=("typed", "text"), default="typed")
    parser.add_argument("--output", default="output", help="the folder of the reports")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    df1, df2 = open_source(given.file1).load(spark), open_source(given.file2).load(spark)
    if given.config:
        config = ReconConfig.load(given.config)
    elif given.template:
        config = read_template(given.template)
    else:
        config = name_mapping(df1.columns, df2.columns, given.auto)
    result = reconcile(df1, df2, config, given.profile).persist()
    write_json(result, f"{given.output}/validation_report.json")
    write_csv(result, given.output)
    print("\n".join(summary_lines(result)))
    result.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
