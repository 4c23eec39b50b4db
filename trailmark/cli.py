"""Command line: ``python -m trailmark.cli etl`` makes samples of recordings, ``score`` computes metrics of predictions."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words for yes and no.
YES, NO = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def flag(text: str | bool) -> bool:
    if isinstance(text, bool):
        return text
    if text.lower() in YES:
        return True
    if text.lower() in NO:
        return False
    raise argparse.ArgumentTypeError("a word for yes or no is expected")


def _switch(parser: argparse.ArgumentParser, *names: str, default: bool, say: str) -> None:
    parser.add_argument(*names, type=flag, nargs="?", const=True, default=default, help=f"{say} (default: {default})")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="trailmark", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    etl = sub.add_parser("etl", help="recordings to samples")
    etl.add_argument("--path", "-p", default="../datasets", help="folder of the recordings")
    etl.add_argument("--config", "-c", default="rounD", help="name of a sampling, or of a YAML file below the working folder")
    etl.add_argument("--output-dir", "-o", default="data", help="folder of the samples")
    etl.add_argument("--add-name", "-an", default="", help="added to the output's name")
    _switch(etl, "--add-supp", default=False, say="polar features as well")
    _switch(etl, "--use-threads", "-ut", default=False, say="all cores instead of one")
    _switch(etl, "--debug", "-d", default=False, say="count samples instead of writing them")
    score = sub.add_parser("score", help="metrics of predictions")
    score.add_argument("--root", "-r", default="", help="folder of the tables truth, pred and prob")
    score.add_argument("--config", "-c", default="FDE", help="criterion of the best mode: FDE, ADE or ML")
    score.add_argument("--add-name", "-an", default="", help="added to the output's name")
    score.add_argument("--seed", type=int, default=42)
    _switch(score, "--overwrite", "-ow", default=False, say="replace an earlier result")
    _switch(score, "--dry-run", "-dr", default=True, say="print the metrics instead of writing them")
    _switch(score, "--small-ds", "-sd", default=False, say="the first hundred scenarios only")
    return out


def samples_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Samples of urban recordings by a named sampling: splits, windows of each, steps and masks."""
    from .functions import plugins
    from .operators import kinematics, sampling, splits
    from .sources import trajectories

    if args.config in sampling.SAMPLING:
        how = sampling.SAMPLING[args.config]
    else:
        c = plugins.configuration(args.config, os.getcwd())
        how = sampling.Sampling(c["sample_freq"], c["downsample"], c["input_len"], c["output_len"], c["skip_samples"])
    tracks, meta, _ = trajectories.urban(spark, args.path)
    features = ["x", "y", "vx", "vy", "ax", "ay", "psi"]
    if args.add_supp:
        tracks, features = kinematics.with_polar(tracks, 0.0, 0.0), [*features, "rho", "theta"]
    tracks = splits.with_split(tracks.join(meta.select("rec_id", "track_id", "agent_type"), ["rec_id", "track_id"]))
    spec, out = how.windows(), None
    for split in ("train", "val", "test"):
        starts = sampling.starts(splits.purge(tracks, split), spec)
        rows = sampling.agent_steps(sampling.agents(starts, tracks), tracks, spec, tuple(features))
        masked = sampling.with_masks(rows, spec, int(3 * how.rate), features=tuple(features), skip_static=True)
        each = sampling.nested(masked, spec, tuple(features)).withColumn("split", F.lit(split))
        out = each if out is None else out.unionByName(each)
    return out


def metrics_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """``metric, value`` of a folder's predictions."""
    from .operators import metrics as M

    truth, pred, prob = (spark.read.parquet(f"{args.root}/{name}") for name in ("truth", "pred", "prob"))
    if args.small_ds:
        first = truth.select("scenario_id").distinct().orderBy("scenario_id").limit(100)
        truth, pred, prob = (d.join(F.broadcast(first), "scenario_id", "left_semi") for d in (truth, pred, prob))  # a hundred rows
    found = {
        "min_ade": M.min_ade(pred, truth, args.config, prob), "min_fde": M.min_fde(pred, truth, args.config, prob), "min_apde": M.min_apde(pred, truth, args.config, prob),
        "miss_rate": M.miss_rate(pred, truth, args.config, prob), "min_brier": M.min_brier(pred, truth, prob, args.config), "collision_rate": M.collision_rate(pred, truth, args.config, prob),
        "exp_de": M.exp_de(pred, truth, prob),
    }
    out = None
    for name, value in found.items():
        each = value.select(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
        out = each if out is None else out.unionByName(each)
    return out


def main(argv: list[str] | None = None) -> int:
    from .session import session
    from .sources import sinks

    args = parser().parse_args(argv)
    spark = session("local[*]" if getattr(args, "use_threads", True) else "local[1]")
    if args.command == "etl":
        samples = samples_of(spark, args)
        if args.debug:
            samples.groupBy("split").count().show()
        else:
            sinks.write_samples(samples, f"{args.output_dir}/{args.config}{args.add_name}", resume=True)
    elif args.dry_run:
        metrics_of(spark, args).show()
    else:
        metrics_of(spark, args).coalesce(1).write.option("header", True).mode("overwrite" if args.overwrite else "errorifexists").csv(f"{args.root}/metrics{args.add_name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
