"""Command line: ``python -m tickerloom <command> --root <workspace>``."""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt

from .plans import stages
from .session import build_session
from .settings import Settings, apply_profile, load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickerloom", description="News and price signal stages on Spark")
    p.add_argument("command", choices=(
        "ingest", "merge", "clean", "split-prices", "generate-data", "fit-second-language", "sentiment", "features", "fuse", "train", "train-epochs", "eval", "predict", "cases",
        "tier1", "tier2", "tier3", "run-all"))
    p.add_argument("--root", required=True, help="workspace folder on a shared file system")
    p.add_argument("--config", help="YAML or JSON settings")
    p.add_argument("--profile", choices=("4gb", "8gb", "full"))
    p.add_argument("--ticker", help="restrict to one ticker")
    p.add_argument("--force", action="store_true", help="ignore cached stages")
    p.add_argument("--split", default="test", choices=("train", "val", "test"))
    p.add_argument("--date", help="day of the tier1 log, YYYY-MM-DD")
    p.add_argument("--input", action="append", default=[], metavar="PATH|NAME=PATH",
                   help="cases: a JSON file; clean and split-prices: a CSV file; ingest: source=file, merge: layout=file (repeat)")
    p.add_argument("--output", help="where predict and clean write their CSV, instead of the workspace")
    p.add_argument("--body-limit", type=int, help="clean: cut bodies to so many characters")
    p.add_argument("--seed", type=int)
    p.add_argument("--master", help="Spark master, when not set by spark-submit")
    return p


def settings_of(args: argparse.Namespace) -> Settings:
    out = load(args.config, args.profile) if args.config else Settings()
    if args.profile and not args.config:
        out = apply_profile(out, args.profile)
    changes = {}
    if args.ticker:
        changes["tickers"] = (args.ticker.upper(),)
    if args.seed is not None:
        changes["seed"] = args.seed
    return dataclasses.replace(out, **changes)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(master=args.master, shared=f"{args.root.rstrip('/')}/work")
    named = dict(x.split("=", 1) for x in args.input if "=" in x)
    first = args.input[0] if args.input else None
    ws = stages.Workspace(spark, args.root, settings_of(args), args.force)
    run = {
        "ingest": lambda: stages.ingest(ws, named),
        "merge": lambda: stages.merge_master(ws, [(path, layout) for layout, path in (x.split("=", 1) for x in args.input)]),
        "clean": lambda: stages.clean(ws, first, args.output or ws.path("raw", "clean"), limit=args.body_limit),
        "split-prices": lambda: stages.split_prices(ws, first),
        "generate-data": lambda: stages.generate_data(ws), "sentiment": lambda: stages.sentiment(ws),
        "features": lambda: stages.features(ws), "fuse": lambda: stages.fuse(ws), "train": lambda: stages.train(ws),
        "fit-second-language": lambda: stages.second_language(ws), "train-epochs": lambda: stages.train_epochs(ws),
        "eval": lambda: stages.evaluate(ws, args.split)["overall"].show(truncate=False),
        "predict": lambda: stages.predict(ws, args.output).show(50, truncate=False),
        "cases": lambda: stages.run_cases(ws, first)[0].show(50, truncate=False),
        "tier1": lambda: stages.tier1(ws, args.date), "tier2": lambda: stages.tier2(ws),
        "tier3": lambda: stages.tier3(ws, dt.date.fromisoformat(args.date) if args.date else None),
        "run-all": lambda: stages.run_all(ws),
    }
    run[args.command]()


if __name__ == "__main__":
    main()
