"""Command line: python -m barlake {version, config-show, data {ingest, summary}, features {build, audit, list}}.

Exit codes: 0 done, 1 an error of configuration or data, 2 features look ahead.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

import barlake
from barlake import config
from barlake.operators.asof import LeakageError
from barlake.plans import audit, engine, ingest
from barlake.sources import stores


def show(rows) -> None:
    for r in rows:
        print("\t".join(str(x) for x in r))


def data_ingest(spark: SparkSession, cfg: config.Config, args: argparse.Namespace) -> int:
    done = ingest.ingest(spark, cfg, persist=not args.no_persist)
    print(json.dumps(done.report, indent=2, default=str))
    show([x] for x in done.written)
    return 0


def data_summary(spark: SparkSession, cfg: config.Config, args: argparse.Namespace) -> int:
    for name in ("bars", "resampled"):
        show(stores.store_summary(spark, cfg.store(name)).orderBy("symbol", "tf").collect())
    return 0


def features_build(spark: SparkSession, cfg: config.Config, args: argparse.Namespace) -> int:
    """Builds, reports nulls and dead columns, audits unless told not to, and stores what passed."""
    bars, frames = ingest.stored(spark, cfg)
    matrix, made = engine.transform(bars, cfg, frames)
    show((r.feature, f"{r.null_share:.4f}") for r in engine.null_report(matrix).where("null_share > 0").limit(args.top).collect())
    show((r.feature, r.kind) for r in engine.dead_columns(matrix).collect())
    if not args.skip_audit:
        engine.replay_audit(bars, cfg, args.cutoffs)
    print(stores.write_features(matrix, made, cfg.store("features")))
    return 0


def features_audit(spark: SparkSession, cfg: config.Config, args: argparse.Namespace) -> int:
    """Calls in the sources that look ahead, plans that do, then the replay over stored bars."""
    bars = ingest.stored(spark, cfg)[0]
    found = [*audit.scan_source(Path(barlake.__file__).parent / "functions"), *audit.proof(bars, cfg)]
    show(found)
    engine.replay_audit(bars, cfg, args.cutoffs)
    return 2 if found else 0


def features_list(spark: SparkSession, cfg: config.Config, args: argparse.Namespace) -> int:
    show(stores.list_feature_sets(spark, cfg.store("features")).collect())
    return 0


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config", action="append", default=[], help="a YAML file; later ones win")
    common.add_argument("--set", action="append", default=[], dest="sets", metavar="a.b=value")
    out = argparse.ArgumentParser(prog="barlake")
    top = out.add_subparsers(required=True)
    top.add_parser("version").set_defaults(run="version")
    top.add_parser("config-show", parents=[common]).set_defaults(run="config")
    data = top.add_parser("data").add_subparsers(required=True)
    p = data.add_parser("ingest", parents=[common])
    p.add_argument("--no-persist", action="store_true", help="look only, write nothing")
    p.set_defaults(run=data_ingest)
    data.add_parser("summary", parents=[common]).set_defaults(run=data_summary)
    features = top.add_parser("features").add_subparsers(required=True)
    for name, run in (("build", features_build), ("audit", features_audit)):
        p = features.add_parser(name, parents=[common])
        p.add_argument("--cutoffs", type=int, default=6, help="times that the audit replays to")
        p.set_defaults(run=run)
        if name == "build":
            p.add_argument("--skip-audit", action="store_true")
            p.add_argument("--top", type=int, default=20, help="columns with nulls to show")
    features.add_parser("list", parents=[common]).set_defaults(run=features_list)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.run == "version":
        print(f"barlake {barlake.__version__}")
        return 0
    try:
        cfg = config.load(args.config, args.sets)
        if args.run == "config":
            print(json.dumps(config.plain(cfg), indent=2))
            print(f"fingerprint {config.fingerprint(cfg)}")
            return 0
        spark = spark or SparkSession.builder.appName("barlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR" if cfg.log_level == "INFO" else cfg.log_level)
        return args.run(spark, cfg, args)
    except LeakageError as e:
        print(f"LeakageError: {e}", file=sys.stderr)
        return 2
    except (ValueError, OSError, PySparkException) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
