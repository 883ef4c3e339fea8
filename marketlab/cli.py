"""Command line: ``python -m marketlab run|walkforward|validate|generate|strategies``."""

from __future__ import annotations

import argparse
import ast
import os
import sys

from pyspark.sql import SparkSession

from . import report
from .errors import MarketError, SettingError
from .inference import validation
from .operators import metrics, signals
from .plans import research, vector
from .sources import bars as B
from .sources import synthetic


def value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def pairs(items: list[str]) -> dict:
    """``key=value`` arguments."""
    out = {}
    for item in items or []:
        key, found, text = item.partition("=")
        if not found or not key:
            raise SettingError(f"expected key=value, not {item!r}")
        out[key] = value(text)
    return out


def grids(items: list[str]) -> dict[str, list]:
    """``key=a,b,c`` arguments."""
    out = {}
    for item in items or []:
        key, found, text = item.partition("=")
        if not found or not key or not text:
            raise SettingError(f"expected key=a,b,c, not {item!r}")
        out[key] = [value(t) for t in text.split(",")]
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marketlab")
    kinds = top.add_subparsers(dest="command", required=True)

    def data(p):
        p.add_argument("--csv", help="a file or folder of bars; without it, synthetic ones are made")
        p.add_argument("--symbols", type=int, default=5)
        p.add_argument("--years", type=float, default=10)
        p.add_argument("--seed", type=int, default=0)

    def trade(p):
        p.add_argument("--strategy", default="sma_crossover", choices=sorted(signals.STRATEGIES))
        p.add_argument("--cash", type=float, default=1e6)
        p.add_argument("--slippage-bps", type=float, default=2.0)
        p.add_argument("--commission-bps", type=float, default=1.0)
        p.add_argument("--rebalance")

    one = kinds.add_parser("run", help="one backtest")
    data(one), trade(one)
    one.add_argument("--param", action="append")
    one.add_argument("--html")
    walk = kinds.add_parser("walkforward", help="fit and test in rolling windows")
    data(walk), trade(walk)
    walk.add_argument("--grid", action="append")
    walk.add_argument("--train", type=int, default=504)
    walk.add_argument("--test", type=int, default=126)
    walk.add_argument("--anchored", action="store_true")
    check = kinds.add_parser("validate", help="how much of a grid's best result is luck")
    data(check), trade(check)
    check.add_argument("--grid", action="append")
    check.add_argument("--splits", type=int, default=16)
    check.add_argument("--samples", type=int, default=1000)
    make = kinds.add_parser("generate", help="synthetic bars as CSV")
    data(make)
    make.add_argument("--out", required=True)
    kinds.add_parser("strategies", help="names and schedules")
    return top


def _bars(spark, args):
    if args.csv:
        return B.validated(B.read_csv(spark, args.csv))
    return synthetic.ohlcv(spark, args.years, symbols=args.symbols, seed=args.seed)


def _settings(args):
    return vector.VectorSettings(args.cash, args.slippage_bps, args.commission_bps)


def command(args) -> int:
    if args.command == "strategies":
        print(report.table([(n, s) for n, (_, s, _) in sorted(signals.STRATEGIES.items())], ("strategy", "schedule")))
        return 0
    spark = SparkSession.builder.appName("marketlab").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    bars = _bars(spark, args)
    if args.command == "generate":
        B.write_csv(bars, args.out)
        return 0
    if args.command == "run":
        params = pairs(args.param)
        curve = research.run_grid(B.panel(bars), args.strategy, [params], _settings(args), rebalance=args.rebalance)
        print(report.summary(metrics.summary(curve).first().asDict()))
        if args.html:
            with open(args.html, "w", encoding="utf-8") as f:
                f.write(report.page(args.strategy, curve))
        return 0
    configs = grids(args.grid)
    if args.command == "walkforward":
        table, _ = research.walk_forward(bars, args.strategy, configs, args.train, args.test, _settings(args), args.rebalance, anchored=args.anchored)
        rows = table.orderBy("window").collect()
        print(report.table([(r.window, r.label, report.number(r.is_objective), report.number(r.oos_sharpe), report.percent(r.oos_return)) for r in rows], ("window", "chosen", "train Sharpe", "test Sharpe", "test return")))
        return 0
    runs = research.expand(configs)
    curves = research.run_grid(B.panel(bars), args.strategy, runs, _settings(args), rebalance=args.rebalance)
    print(report.table([(r.rank, r.label, report.number(r.sharpe), report.percent(r.cagr), report.percent(r.max_drawdown)) for r in research.ranked(curves, runs).orderBy("rank").collect()], ("rank", "configuration", "Sharpe", "CAGR", "drawdown")))
    perf = research.performance(curves).persist()
    if len(runs) > 1:
        print(f"\n{validation.validate_family(perf, args.splits, research.history(args.strategy, runs), n_samples=args.samples).format()}")
    one = metrics.returns(curves).filter("run_id = 0") if len(runs) == 1 else None
    if one is not None:
        print(f"\n{validation.validate_returns(one, n_samples=args.samples).format()}")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return command(parser().parse_args(argv))
    except MarketError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 141
