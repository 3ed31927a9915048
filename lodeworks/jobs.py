"""Command line for spark-submit: inventory, run, grid, retrain and watch.

    spark-submit --conf spark.checkpoint.dir=<shared folder> -m lodeworks.jobs run ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodeworks.operators.files import category_rollup, layer_groups, storage_report
from lodeworks.models.store import Registry
from lodeworks.plans.intake import listed_with_headers, read_folder
from lodeworks.plans.prospect import retrain, run, run_report
from lodeworks.plans.surface import run_grid
from lodeworks.sources import sinks
from lodeworks.sources.listing import list_files
from lodeworks.streaming.watcher import Watcher


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodeworks")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("inventory", "storage", "run", "infer", "grid", "retrain", "watch", "reconcile"):
        command = commands.add_parser(name)
        command.add_argument("folder", help="folder with the input files")
        command.add_argument("--root", required=True, help="folder for results and models")
        command.add_argument("--deposit")
        command.add_argument("--zone", type=int, help="UTM zone of projected coordinates")
        command.add_argument("--north", action="store_true", help="northern hemisphere")
        command.add_argument("--force-retrain", action="store_true")
        command.add_argument("--teach", action="store_true")
        command.add_argument("--resolution", type=float, default=10.0, help="grid step in metres")
    return parser


def main(argv: list[str] | None = None) -> None:
    options = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lodeworks-{options.command}").getOrCreate()

    def read(folder: str):
        return read_folder(
            spark, folder, deposit=options.deposit, zone=options.zone, south=not options.north)

    def train(folder: str, deposit: str | None = None):
        intake = read(folder)
        result = run(
            spark, intake.inputs, deposit or intake.deposit, options.root,
            force_retrain=options.force_retrain, teach=options.teach, status=print)
        if result.status != "success":
            raise RuntimeError(result.status)
        return result

    if options.command == "inventory":
        files, _ = listed_with_headers(spark, [options.folder])
        sinks.write_parquet(category_rollup(files), f"{options.root}/inventory")
        category_rollup(files).show(200, truncate=False)
        layer_groups(read(options.folder).files).show(truncate=False)
    elif options.command == "storage":
        report = storage_report(
            list_files(spark, options.folder), Registry(spark, options.root).table())
        report.orderBy("deposit").show(200, truncate=False)
    elif options.command == "run":
        run_report(train(options.folder)).show(truncate=False)
    elif options.command == "infer":
        intake = read(options.folder)
        result = run(spark, intake.inputs, intake.deposit, options.root, mode="infer")
        print(result.status)
    elif options.command == "grid":
        intake = read(options.folder)
        result = run_grid(
            spark, intake.inputs, intake.deposit, options.root, resolution_m=options.resolution)
        if result.status != "success":
            raise RuntimeError(result.status)
        result.bands.orderBy("band").show()
    elif options.command == "retrain":
        intake = read(options.folder)
        print(retrain(spark, options.root, intake.deposit, intake.inputs).status)
    else:
        def job(deposit: str) -> dict:
            return train(watcher.folder_of(deposit), deposit).metrics

        watcher = Watcher(spark, options.folder, f"{options.root}/watch", job)
        if options.command == "reconcile":
            print(*watcher.reconcile(), sep="\n")
        else:
            watcher.watch(f"{options.root}/watch-checkpoint")


if __name__ == "__main__":
    main()
