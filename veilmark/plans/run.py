"""Runs from the command line: ``python -m veilmark.plans.run redact|tag|evaluate SETTINGS INPUT OUTPUT``.

SETTINGS is a JSON file (see ``RunConfig``), INPUT notes as JSON lines, OUTPUT a folder.  Settings that mean nothing here are named and left aside."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark.plans.pipeline import deidentify
from veilmark.plans.tagger import Tagger
from veilmark.sources.notes import RunConfig, load_json, non_empty, write_json, write_metrics


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="veilmark")
    p.add_argument("what", choices=["redact", "tag", "evaluate"])
    p.add_argument("settings")
    p.add_argument("input")
    p.add_argument("output")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("veilmark").getOrCreate()
    config, ignored = RunConfig.read(a.settings)
    if ignored:
        print("settings left aside:", ", ".join(ignored))
    notes = non_empty(load_json(spark, a.input)).select(F.col("meta.note_id").alias("note_id"), "text", "spans")
    if a.what == "redact":
        write_json(deidentify(notes, ["note_id"], config), a.output)
        return
    tagger = Tagger(config).load({"all": notes})
    if a.what == "tag":
        write_json(tagger.set_predict("all").predict(), a.output)
    else:
        write_metrics(tagger.set_eval("all", seed=None).evaluate(), a.output)


if __name__ == "__main__":
    main()
