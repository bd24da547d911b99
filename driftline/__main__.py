"""Command line: link a table of detections and save the run, or show a saved one.

Exit codes: 0 done, 1 failed, 2 wrong use, 3 nothing to do.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DONE, FAILED, MISUSED, NOTHING = 0, 1, 2, 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftline", description="Trajectories from detections")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("analyse", help="link detections and save tracks, summary, MSD and findings")
    run.add_argument("detections", help="CSV or Parquet with frame, label, x, y, area (and movie)")
    run.add_argument("-o", "--output", required=True)
    run.add_argument("--pixel-um", type=float)
    run.add_argument("--interval-min", type=float)
    run.add_argument("--max-gap", type=int, default=3)
    show = sub.add_parser("show", help="a saved run's manifest and tracks")
    show.add_argument("folder")
    return p


def analyse(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators import linking, pairs, quality, summary
    from .schema import Scale, TrackingSettings
    from .sinks.tables import save_run
    from .sources.results import read_table

    found = spark.read.parquet(args.detections) if args.detections.endswith(".parquet") else read_table(spark, args.detections)
    if not found.columns or found.limit(1).count() == 0:
        return NOTHING
    found = found if "movie" in found.columns else found.withColumn("movie", F.lit(0).cast("bigint"))
    scale = Scale.of(args.pixel_um, args.interval_min)
    settings = TrackingSettings(max_gap=args.max_gap)
    linked = linking.link_tracks(found, scale, linking.LinkSettings(max_gap=args.max_gap)).cache()
    # a track's name is unique in its movie only
    obs = linked.join(found.select("movie", "frame", "label", F.col("area").alias("area_px")), ["movie", "frame", "label"]).select(
        (F.col("movie") * 1_000_000 + F.col("track_id")).alias("track_id"), "frame", F.col("x").alias("x_px"), F.col("y").alias("y_px"), F.round(F.col("x") * 100).cast("bigint").alias("x_c"), "area_px", F.lit("primary").alias("source"), F.col("label").alias("det_label")
    )
    sums, link = summary.track_summary(obs, scale, settings), quality.links(obs)
    findings = quality.united([quality.run_findings(spark, scale), quality.gap_bridged(link), quality.likely_missed_detection(link), quality.size_jump(link, settings), quality.fast_track(sums, settings), quality.fragment(sums), quality.stationary(sums, settings), quality.no_tracks(sums)])
    tables = {"tracks": linked, "track_summary": sums, "track_msd": pairs.squared_displacements(obs, scale), "qc_issues": findings.select("severity", "code", "title", "frame", "track_id")}
    save_run(spark, args.output, tables, {"pixel_um": args.pixel_um, "interval_min": args.interval_min, "max_gap": args.max_gap, "n_tracks": linked.select("movie", "track_id").distinct().count()})
    return DONE


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return MISUSED if e.code else DONE
    spark = SparkSession.builder.appName("driftline").getOrCreate()
    try:
        if args.command == "analyse":
            return analyse(spark, args)
        from .sources.results import is_complete, load_run

        if not is_complete(spark, args.folder):
            return NOTHING
        run = load_run(spark, args.folder)
        print(run.manifest)
        run.track_ids().show()
        return DONE
    except Exception as e:  # the last stop before the shell
        print(f"failed: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
