"""Command line: python -m spindle.plans.cli COMMAND ...; exit code 1 where a run finds faults."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from spindle.plans import ingest, runs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindle")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in flags.items():
            c.add_argument("--" + k.replace("_", "-"), **v)
        return c

    switch, many = {"action": "store_true"}, {"nargs": "+", "required": True}
    add("parse", "raw_root", "out", allow_errors=switch)
    add("ingest", "raw_root", "out")
    add("metadata", "config", "manifest", "out")
    add("features", "observations", "out")
    add("sample", "snapshots", "out", split={"required": True}, seed={"type": int, "required": True}, anchors_per_trajectory={"type": int, "required": True}, context_regime={"default": "main"}, sparse_regime={"default": "dense"}, epoch={"type": int}, full_remaining_lifecycle=switch)
    add("validate", "snapshots", "report", manifests=many, compare={})
    add("baseline", "snapshots", "train", "out", evaluations=many, seed={"type": int, "default": 0})
    add("explore", "observations", "metadata", "out", manifest={}, geometry={}, force=switch)
    add("prepare", "snapshots", "out", splits={"nargs": "+", "default": ["test"]}, regimes={"nargs": "+", "default": ["dense"]}, seed={"type": int, "default": 2026}, anchor_cap={"type": int})
    add("evaluate", "snapshots", "manifest", "out", predictions=many)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    bad = False
    if a.command == "parse":
        got = runs.parse(spark, a.raw_root, a.out)
        bad = bool(got["errors"]) and not a.allow_errors
    elif a.command == "ingest":
        got = ingest.ingest(spark, a.raw_root, a.out)
    elif a.command == "metadata":
        got = {"count_mismatches": runs.build_metadata(spark, a.config, a.manifest, a.out)}
    elif a.command == "features":
        got = runs.build_features(spark, a.observations, a.out)["summary"]
    elif a.command == "sample":
        got = runs.sample(spark, a.snapshots, a.out, split=a.split, seed=a.seed, anchors_per_trajectory=a.anchors_per_trajectory, context_regime=a.context_regime, sparse_regime=a.sparse_regime, epoch=a.epoch, full_remaining_lifecycle=a.full_remaining_lifecycle)
    elif a.command == "validate":
        got = runs.validate(spark, a.snapshots, a.manifests, a.report, a.compare)
        bad = got["status"] == "fail"
    elif a.command == "baseline":
        got = {"metric_rows": runs.run_baselines(spark, a.snapshots, a.train, a.evaluations, a.out, a.seed).count()}
    elif a.command == "explore":
        got = runs.explore(spark, a.observations, a.metadata, a.out, manifest=a.manifest, geometry=a.geometry, force=a.force)
    elif a.command == "prepare":
        got = {"rows": runs.prepare_sensitivity(spark, a.snapshots, a.out, splits=a.splits, regimes=a.regimes, seed=a.seed, anchor_cap=a.anchor_cap).count()}
    else:
        got = runs.evaluate_sensitivity(spark, a.snapshots, a.manifest, runs.prediction_specs(a.predictions), a.out)
    print(json.dumps(got, indent=2, default=str))
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())
