"""Command line: python -m tobflow.cli STEP ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from tobflow import __version__
from tobflow import config as C


def _buckets(spark, args, paths, split) -> None:
    from tobflow.plans import ingest

    report = ingest.build_buckets(spark, [args.symbol], args.dates or split.in_sample, paths)
    for r in [] if report is None else report.orderBy("symbol", "day0").collect():
        print(f"{r.symbol} tick={r.tick} rows={r.rows} off_grid={r.off_grid_rows} dups={r.duplicate_rows} backwards={r.ts_backwards} crossed={r.crossed_or_locked} max_gap={r.max_gap_s:.1f}s")


def _windows(spark, args, paths, split) -> None:
    from tobflow.plans import study
    from tobflow.sources import market

    days = sorted(d for s, d in market.committed(spark, paths.buckets()) if s == args.symbol and d in split.in_sample)
    if not days:
        raise SystemExit(f"no grids of {args.symbol}: run buckets --symbol {args.symbol} first")
    missing = [d for d in split.in_sample if d not in days]
    print(study.windows_report(spark, args.symbol, days, paths, args.boot, paths.ledger(), missing))


def _frames(spark, args, paths, split) -> None:
    from tobflow.plans import ingest

    ingest.build_frames(spark, args.symbols, args.dates or split.in_sample, paths)


def _models(spark, args, paths, split) -> None:
    from tobflow.plans import study

    print(study.fit_and_freeze(spark, args.symbols, paths, split, args.boot, paths.ledger()))


def _final_test(spark, args, paths, split) -> None:
    from tobflow.plans import study

    print(study.final_test(spark, args.symbols, paths, split, ledger=paths.ledger()))


def _pilot(spark, args, paths, split) -> None:
    from tobflow.plans import study

    print(study.pilot(spark, paths, ledger=paths.ledger()))


def _select_symbol(spark, args, paths, split) -> None:
    from tobflow.plans import study

    print(study.select_symbol(spark, paths))


def _write(data: dict, out: str) -> None:
    from tobflow.sources import reports

    path = Path(out)
    path.parent.mkdir(parents=True, exist_ok=True)
    reports.write_explorer(data, path)
    print(f"wrote {path} ({path.stat().st_size / 1024:.0f} KB)")


def _site(spark, args, paths, split) -> None:
    from tobflow.plans import explorer

    _write(explorer.export(spark, args.symbols, paths, split), args.out or str(paths.project / "site" / "data.js"))


def _figures(spark, args, paths, split) -> None:
    from tobflow.plans import explorer

    _write(explorer.figures(spark, args.symbols, paths, split), args.out or str(paths.project / "site" / "figures.js"))


def _status(spark, args, paths, split) -> None:
    from tobflow.plans import study

    print(study.status_text(study.status(spark, args.symbols, paths)))


_SYMBOL, _SYMBOLS = {"default": "BTCUSDT"}, {"nargs": "+", "default": ["BTCUSDT", "ETHUSDT", "WLDUSDT"]}
_DATES, _BOOT, _OUT = {"nargs": "*", "default": None, "metavar": "YYYY-MM-DD"}, {"type": int, "default": C.BOOTSTRAP_DRAWS}, {"default": None}
#: Step, what it does, its function and its options.
STEPS: tuple[tuple[str, str, Callable, dict[str, dict]], ...] = (
    ("status", "what exists", _status, {"symbols": _SYMBOLS}),
    ("buckets", "fetch raw days; day grids and quality reports", _buckets, {"symbol": _SYMBOL, "dates": _DATES}),
    ("pilot", "a few days and two datasets, with placebos", _pilot, {}),
    ("windows", "window regressions, bootstrap and report of one symbol", _windows, {"symbol": _SYMBOL, "boot": _BOOT}),
    ("select-symbol", "the rule that chooses a third symbol", _select_symbol, {}),
    ("frames", "fetch raw days; prediction frames on the receive clock", _frames, {"symbols": _SYMBOLS, "dates": _DATES}),
    ("models", "fit, validate, walk forward and freeze", _models, {"symbols": _SYMBOLS, "boot": _BOOT}),
    ("final-test", "frozen models on the held-out days, once", _final_test, {"symbols": _SYMBOLS, "final": {"action": "store_true"}}),
    ("figures", "the data behind the figures", _figures, {"symbols": _SYMBOLS, "out": _OUT}),
    ("site", "the explorer's data file, from reports and window tables", _site, {"symbols": _SYMBOLS, "out": _OUT}),
)


def build_parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="tobflow", description="Order-flow study of top-of-book data on Spark.")
    ap.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    sub = ap.add_subparsers(dest="step")
    for name, text, function, options in STEPS:
        p = sub.add_parser(name, help=text, description=text)
        p.set_defaults(function=function)
        for flag, settings in options.items():
            p.add_argument(f"--{flag.replace('_', '-')}", **settings)
    return ap


def run(args: argparse.Namespace) -> None:
    from tobflow.session import session

    if args.step == "final-test" and not args.final:
        raise SystemExit("the held-out days are used once: add --final")
    for date in getattr(args, "dates", None) or []:
        C.check_date(date)
    args.function(session(), args, C.Paths(), C.Split())


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if args.step is None:
        parser.print_help()
        return 0
    try:
        run(args)
    except KeyboardInterrupt:
        return 130
    except ImportError as e:
        print(f"missing an optional package: {e}", file=sys.stderr)
        return 1
    except FileNotFoundError as e:
        raise SystemExit(f"{e}: run the step before this one") from e
    return 0


if __name__ == "__main__":
    sys.exit(main())
