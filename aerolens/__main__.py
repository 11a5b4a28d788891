"""python -m aerolens SOURCE OUT: a run over the tables in SOURCE, or its report again."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import run


def main(words: list[str] | None = None) -> None:
    known = run.Settings()
    parser = argparse.ArgumentParser(prog="aerolens", description=__doc__)
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--least-move", type=float, default=known.least_move_m, help="metres between keyframes")
    parser.add_argument("--least-sharpness", type=float, default=known.least_sharpness)
    parser.add_argument("--least-confidence", type=float, default=known.least_confidence)
    parser.add_argument("--target", type=float, default=known.target_m, help="metres of error that pass")
    parser.add_argument("--no-mask", action="store_true")
    parser.add_argument("--poses", action="store_true", help="use the table of registered poses")
    parser.add_argument("--verified", action="store_true", help="the telemetry was measured")
    parser.add_argument("--evaluate-only", action="store_true", help="write the report of a finished run anew")
    parser.add_argument("--target-fps", type=float, default=known.target_fps, help="frames a second taken from videos, where telemetry is in subtitles")
    parser.add_argument("--max-gap", type=float, default=known.max_gap_ms, help="milliseconds between records that are bridged")
    parser.add_argument("--cloud-budget", type=int, default=known.cloud_budget, help="points of a flight's cloud, about")
    a = parser.parse_args(words)
    settings = run.Settings(a.least_move, a.least_sharpness, a.least_confidence, a.target, not a.no_mask, a.poses, a.verified, a.target_fps, a.max_gap, a.cloud_budget)
    spark = SparkSession.builder.appName("aerolens").getOrCreate()
    if a.evaluate_only:
        run.report(spark, a.out, settings).write.mode("overwrite").parquet(f"{a.out}/report")
    else:
        run.run(spark, a.source, a.out, settings)


if __name__ == "__main__":
    main()
