"""spark-submit entry points: the two jobs of the service.

    spark-submit dockcast/jobs.py train --tables <dir> --models <dir> [--unit 3600]
    spark-submit dockcast/jobs.py train --csv <dir> --models <dir> --rejected <dir>
    spark-submit dockcast/jobs.py serve --landing <dir> --history <dir> --models <dir>
                                        --outbox <dir> --checkpoint <dir> [--snapshot <dir>]

No master is set here (the submit command or the cluster decides), and the
session settings the plans rely on are applied to whatever session exists.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

from dockcast.config import CITY_RULES, HOUR, RunParams
from dockcast.operators import features as feat
from dockcast.operators.requests import write_letters
from dockcast.plans.models import CurrentModels, ModelStore
from dockcast.plans.training import preview, train_city
from dockcast.session import apply_plan_conf
from dockcast.sources.files import BAD_ROW, TRAINING_FILES, judged_training_csv
from dockcast.sources.history import read_history
from dockcast.sources.tables import history_from_events, read_table
from dockcast.streaming.stream import start_prediction_stream


def training_tables(spark: SparkSession, tables_dir: str, unit: int = HOUR) -> dict[str, DataFrame]:
    """D1/D2 tables of every city from the driver-style tables folder."""
    hist = history_from_events(read_table(spark, tables_dir, "events"))
    profile = feat.station_profile(hist)
    out = {}
    for city, rule in CITY_RULES.items():
        if city == "Malaga":
            out[city] = feat.malaga_training_table(read_table(spark, tables_dir, "lineitem"))
        elif city == "Barcelona":
            out[city] = feat.with_trend(feat.lag_training_table(hist, rule, unit), profile)
        else:
            out[city] = feat.lag_training_table(hist, rule, unit)
    return out


def csv_tables(spark: SparkSession, csv_dir: str, rejected_dir: str) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]]]:
    """The sound rows of each city's training file, and the counts by reason; bad
    rows are kept as text in ``rejected_dir``/<city>/letter=bad."""
    tables, counts = {}, {}
    for city, name in TRAINING_FILES.items():
        path = f"{rejected_dir.rstrip('/')}/{city.lower()}-{uuid.uuid4().hex}"
        judged = judged_training_csv(spark, f"{csv_dir.rstrip('/')}/{name}", city)
        counts[city] = write_letters(judged, path, reasons=(BAD_ROW,))
        tables[city] = spark.read.schema(judged.schema).parquet(f"{path}/letter=good").drop("raw", "reason") if counts[city]["good"] else judged.limit(0)
    return tables, counts


def train_all(
    spark: SparkSession, tables: dict[str, DataFrame], model_dir: str, previews: dict[str, DataFrame] | None = None
) -> DataFrame:
    """M5-M8 + S8 for every city; returns the hold-out metrics of all cities.  The first
    scored hold-out rows of each city (P12) go to ``previews``."""
    metrics, store = None, ModelStore(spark, model_dir)
    for city, table in tables.items():
        rule = CITY_RULES[city]
        trained = train_city(table, rule)
        store.publish(city, trained.model)
        if previews is not None:
            previews[city] = preview(trained.test_predictions, rule)
        metrics = trained.metrics if metrics is None else metrics.unionByName(trained.metrics)
    return metrics


def load_all(spark: SparkSession, model_dir: str) -> dict:
    """The current model of every city; a missing one is an error here."""
    store = ModelStore(spark, model_dir)
    return {city: store.load(city) for city in CITY_RULES}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="dockcast")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    source = t.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables")
    source.add_argument("--csv")
    t.add_argument("--rejected")
    t.add_argument("--models", required=True)
    t.add_argument("--unit", type=int, default=HOUR)
    s = sub.add_parser("serve")
    for a in ("--landing", "--history", "--models", "--outbox", "--checkpoint"):
        s.add_argument(a, required=True)
    s.add_argument("--snapshot")
    s.add_argument("--unit", type=int, default=HOUR)
    s.add_argument("--interval", default="1 second")
    s.add_argument("--outbox-format", choices=("parquet", "text"), default="parquet")
    s.add_argument("--max-files-per-trigger", type=int)
    s.add_argument("--max-bytes-per-trigger")
    s.add_argument("--archive")
    s.add_argument("--rejected")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"dockcast-{args.cmd}").getOrCreate()
    apply_plan_conf(spark)
    if args.cmd == "train":
        if args.csv:
            if not args.rejected:
                ap.error("--csv needs --rejected")
            tables, counts = csv_tables(spark, args.csv, args.rejected)
            print(counts)
        else:
            tables = training_tables(spark, args.tables, args.unit)
        previews = {}
        metrics = train_all(spark, tables, args.models, previews)
        for rows in previews.values():
            rows.show(truncate=False)
        metrics.show(truncate=False)
        return 0
    query = start_prediction_stream(
        spark,
        args.landing,
        lambda since, until: read_history(spark, args.history, since, until),
        args.outbox,
        args.checkpoint,
        snapshot_dir=args.snapshot,
        models=CurrentModels(ModelStore(spark, args.models), list(CITY_RULES)),
        params=RunParams(lag_unit=args.unit),
        interval=args.interval,
        outbox_format=args.outbox_format,
        max_files_per_trigger=args.max_files_per_trigger,
        max_bytes_per_trigger=args.max_bytes_per_trigger,
        archive_dir=args.archive,
        rejected_dir=args.rejected,
    )
    query.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
