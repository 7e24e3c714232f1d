"""Command line: the sources of one candidate to JSON files.

    python -m fusewright.plans.cli --ats ats.json --resume resume.docx --config config.json --output out/profile.json
"""
from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fusewright.plans.pipeline import Inputs, run
from fusewright.settings import load_settings
from fusewright.sources.files import load_config, read_resumes, read_texts
from fusewright.sources.recruiter_csv import first_row, read_csv

KEY = "candidate"
log = logging.getLogger("fusewright")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Fuses the sources of one candidate into one record")
    parser.add_argument("--ats", default="data/ats.json", help="ATS export, JSON")
    parser.add_argument("--resume", default="data/resume.docx", help="resume: docx, pdf, txt, json or md")
    parser.add_argument("--csv", help="recruiter export, CSV")
    parser.add_argument("--notes", help="recruiter notes, text")
    parser.add_argument("--github", help="address of a GitHub profile")
    parser.add_argument("--linkedin", help="address of a LinkedIn profile")
    parser.add_argument("--config", default="configs/default.json", help="projection configuration, JSON")
    parser.add_argument("--settings", default="configs/settings.json", help="confidences and bonus, JSON")
    parser.add_argument("--log", help="file that the log goes to as well, such as logs/pipeline.log")
    parser.add_argument("--output", default="output/candidate_profile.json", help="where the projected record goes")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, began = arguments(argv), time.time()
    layout = "%(asctime)s %(levelname)s %(message)s"
    logging.basicConfig(level=logging.INFO, format=layout)
    kept = None
    if args.log:
        os.makedirs(os.path.dirname(args.log) or ".", exist_ok=True)
        kept = logging.FileHandler(args.log, encoding="utf-8")
        kept.setFormatter(logging.Formatter(layout))
        log.addHandler(kept)
    try:
        return _run(args, began, spark)
    finally:
        if kept:
            log.removeHandler(kept)
            kept.close()


def _run(args: argparse.Namespace, began: float, spark: SparkSession | None) -> int:
    there = {k: v for k in ("ats", "resume", "csv", "notes") if (v := getattr(args, k)) and os.path.exists(v)}
    if not there and not (args.github or args.linkedin):
        log.error("No valid candidate sources; nothing is written")
        return 1
    try:
        config = load_config(args.config, strict=True)
    except FileNotFoundError as fault:
        log.error("%s", fault)
        return 1
    spark = spark or SparkSession.builder.appName("fusewright").getOrCreate()
    keyed = lambda frame: frame.withColumn("candidate_key", F.lit(KEY))
    inputs = Inputs(
        ats=keyed(read_texts(spark, there["ats"], "raw")) if "ats" in there else None,
        resumes=keyed(read_resumes(spark, there["resume"])) if "resume" in there else None,
        csv=keyed(first_row(read_csv(spark, there["csv"], position=True))) if "csv" in there else None,
        notes=keyed(read_texts(spark, there["notes"])) if "notes" in there else None,
        urls=spark.createDataFrame([(KEY, args.github, args.linkedin)], "candidate_key string, github string, linkedin string") if args.github or args.linkedin else None,
    )
    got = run(inputs, config, load_settings(args.settings))
    for row in got.quarantined.collect():  # the sources of one candidate
        log.warning("%s is left out: %s", row["source"], row["error"])
    record = got.validated.select("validation", "projection_errors", F.to_json(F.struct(*[c for c in got.fused.columns if not c.startswith(("candidate_key", "sources_"))]), {"ignoreNullFields": "false"}).alias("canonical")).first()
    if record is None:
        log.error("No valid candidate sources; nothing is written")
        return 1
    report = record["validation"].asDict(recursive=True)
    for error in [*report["errors"], *record["projection_errors"]]:
        log.warning("%s", error)
    projected = got.projected_json.first()
    if projected is None or projected["projected"] is None:
        log.error("Required fields are missing; nothing is written")
        return 1
    folder = os.path.dirname(args.output) or "."
    os.makedirs(folder, exist_ok=True)
    for path, value in (
        (args.output, json.loads(projected["projected"])),
        (os.path.join(folder, "canonical_profile.json"), json.loads(record["canonical"])),
        (os.path.join(folder, "validation_report.json"), report),
    ):
        with open(path, "w", encoding="utf-8") as file:
            json.dump(value, file, indent=2, ensure_ascii=False)
        log.info("wrote %s", path)
    log.info("%.3f seconds", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
