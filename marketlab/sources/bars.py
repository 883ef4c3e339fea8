"""Bars: sources, rules, and the panel on a common calendar.

Bars are long: one row for a symbol and time. A panel has a row for every time
of the calendar and symbol of the universe, with nulls where a symbol has no
bar. Calendars and universes are small (times and symbols, not bars), so only
they are ordered as a whole; everything else is keyed by symbol or time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BarsError

FIELDS = ["open", "high", "low", "close", "volume"]
SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(f, T.DoubleType()) for f in FIELDS]])
TOLERANCE = 1e-9


def from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, size: Column | None, every: str, *order: str) -> DataFrame:
    """Bars of ``every`` ("hour", "day", "week"): first, highest, lowest and last price by (ts, ``order``), and the summed size (or the count)."""
    rows = ticks.select(symbol.alias("symbol"), F.date_trunc(every, ts).cast("timestamp_ntz").alias("ts"), price.cast("double").alias("price"), (F.lit(1.0) if size is None else size.cast("double")).alias("size"), F.struct(ts.alias("_at"), *order).alias("at"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume"),
    )


def bounded(bars: DataFrame) -> DataFrame:
    """Prices mapped into (50, 100), in the same order; for prices with heavy tails."""
    return bars.withColumns({f: 50 + 50 * F.col(f) / (F.col(f) + 50) for f in FIELDS[:4]})


def from_frame(frame: DataFrame, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """Bars of any frame: names are trimmed and lowered, the five fields are needed, others are left out."""
    names = {c.strip().lower(): c for c in frame.columns}
    missing = [c for c in [date.lower(), symbol.lower(), *FIELDS] if c not in names]
    if missing:
        raise BarsError(f"columns are missing: {', '.join(missing)}")
    pick = lambda name: F.col(f"`{names[name]}`")
    return frame.select(pick(symbol.lower()).cast("string").alias("symbol"), pick(date.lower()).cast("timestamp_ntz").alias("ts"), *[pick(f).cast("double").alias(f) for f in FIELDS])


def from_pandas(spark: SparkSession, frames: dict) -> DataFrame:
    """Bars of one pandas frame per symbol, indexed by time."""
    import pandas as pd

    if not frames:
        raise BarsError("there are no symbols")
    parts = []
    for symbol, frame in frames.items():
        part = frame.rename(columns=lambda c: str(c).strip().lower())
        lost = [f for f in FIELDS if f not in part.columns]
        if lost:
            raise BarsError(f"{symbol}: columns are missing: {', '.join(lost)}")
        parts.append(part[FIELDS].astype("float64").rename_axis("ts").reset_index().assign(symbol=symbol))
    rows = pd.concat(parts)[["symbol", "ts", *FIELDS]]
    return spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def read_csv(spark: SparkSession, path: str, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """CSV bars of a file or folder: in long form, or one symbol a file, named as the file."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower() for c in raw.columns}
    if symbol.lower() in names:
        raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    else:
        raw = raw.withColumn(symbol, F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.csv$", 1)).withColumn("_file", F.col("_metadata.file_path"))
    found = from_frame(raw, date, symbol)
    name = next(c for c in raw.columns if c.strip().lower() == symbol.lower())
    twice = raw.groupBy(F.col(f"`{name}`").alias("symbol")).agg(F.countDistinct("_file").alias("files")).filter("files > 1").limit(5).collect()
    if twice:
        raise BarsError(f"symbols in more than one file: {', '.join(r.symbol for r in twice)}")
    return found


def write_csv(bars: DataFrame, path: str) -> None:
    """Long CSV by date and symbol, as one file."""
    bars.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "symbol", *FIELDS).orderBy("date", "symbol").coalesce(1).write.mode("overwrite").csv(path, header=True)


# -- rules


def violations(bars: DataFrame) -> DataFrame:
    """(``symbol``, ``rule``, ``first_ts``) of all rules that bars break; rows without any field count as absent."""
    o, h, lo, c, v = (F.col(f) for f in FIELDS)
    every = F.array(*FIELDS)
    absent = F.forall(every, lambda x: x.isNull() | F.isnan(x))
    some = F.exists(every, lambda x: x.isNull() | F.isnan(x))
    infinite = F.exists(every, lambda x: F.abs(x) == float("inf"))
    rules = [
        ("no time", F.col("ts").isNull()),
        ("incomplete", some),
        ("not finite", ~some & infinite),
        ("price not positive", ~some & ~infinite & (F.least(o, h, lo, c) <= 0)),
        ("negative volume", ~some & ~infinite & (v < 0)),
        ("high too low", ~some & ~infinite & (h < F.greatest(o, c) * (1 - TOLERANCE))),
        ("low too high", ~some & ~infinite & (lo > F.least(o, c) * (1 + TOLERANCE))),
    ]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules]))
    single = bars.filter(~absent).select("symbol", "ts", F.explode(broken).alias("rule")).groupBy("symbol", "rule").agg(F.min("ts").alias("first_ts"))
    twice = bars.groupBy("symbol", "ts").count().filter("count > 1").groupBy("symbol").agg(F.min("ts").alias("first_ts")).select("symbol", F.lit("duplicate time").alias("rule"), "first_ts")
    return single.unionByName(twice)


def validated(bars: DataFrame) -> DataFrame:
    """``bars`` without absent rows; raises if a rule is broken."""
    found = violations(bars).orderBy("symbol", "rule").limit(5).collect()
    if found:
        raise BarsError("; ".join(f"{r.symbol}: {r.rule} at {r.first_ts}" for r in found))
    return bars.filter(~F.forall(F.array(*FIELDS), lambda x: x.isNull() | F.isnan(x)))


# -- calendar and panel


def calendar(bars: DataFrame) -> DataFrame:
    """All times of any symbol, with their position ``pos`` from 0."""
    return bars.select("ts").distinct().withColumn("pos", F.row_number().over(W.orderBy("ts")).cast("long") - 1)


def universe(bars: DataFrame) -> DataFrame:
    """All symbols, with their place ``sym_idx`` from 0."""
    return bars.select("symbol").distinct().withColumn("sym_idx", F.row_number().over(W.orderBy("symbol")) - 1)


def panel(bars: DataFrame) -> DataFrame:
    """The dense panel: ``pos``, ``ts``, ``sym_idx``, ``symbol``, the fields (null without a bar), ``has_bar`` and the carried ``last_close``."""
    grid = calendar(bars).crossJoin(universe(bars))
    dense = grid.join(bars.select("symbol", "ts", *FIELDS), ["symbol", "ts"], "left")
    back = W.partitionBy("symbol").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return dense.select("pos", "ts", "sym_idx", "symbol", *FIELDS, F.col("close").isNotNull().alias("has_bar"), F.last("close", ignorenulls=True).over(back).alias("last_close"))


def pivoted(panel_: DataFrame, field: str, symbols: list[str]) -> DataFrame:
    """One row a time, with a column for each symbol's ``field``."""
    return panel_.groupBy("pos", "ts").pivot("symbol", symbols).agg(F.first(field))


def arrays(panel_: DataFrame, *fields: str) -> DataFrame:
    """One row a time, with an array for each field, in the order of the universe."""
    rows = F.array_sort(F.collect_list(F.struct("sym_idx", *fields)))
    wide = panel_.groupBy("pos", "ts").agg(rows.alias("rows"))
    return wide.select("pos", "ts", *[F.col("rows").getField(f).alias(f) for f in fields])


def sliced(bars: DataFrame, start: int, stop: int) -> DataFrame:
    """Bars at the positions [start, stop) of the calendar; symbols without a bar there are gone."""
    times = calendar(bars).filter((F.col("pos") >= start) & (F.col("pos") < stop)).select("ts")
    return bars.join(F.broadcast(times), "ts", "left_semi").select(*bars.columns)


def selected(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Bars of some symbols."""
    return bars.filter(F.col("symbol").isin(symbols))


def lookback(panel_: DataFrame, field: str, n: int) -> DataFrame:
    """``window``: the last ``n`` calendar rows of ``field`` up to each row, holes included."""
    frame = W.partitionBy("symbol").orderBy("pos").rowsBetween(-(n - 1), 0)
    got = F.collect_list(F.struct(F.col(field).alias("v"))).over(frame)
    return panel_.select("pos", "ts", "symbol", F.transform(got, lambda r: r["v"]).alias("window"))


def last_bars(bars: DataFrame, field: str, n: int) -> DataFrame:
    """``window``: the last ``n`` bars that a symbol really has, up to each of them."""
    frame = W.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
    return bars.select("symbol", "ts", F.collect_list(field).over(frame).alias("window"))


def as_of(bars: DataFrame, asked: DataFrame) -> DataFrame:
    """For (``symbol``, ``asked_ts``): the calendar time at or before it, and the symbol's bar then (null without one).

    Times are carried forward in a union of calendar and questions, so no range join is needed.
    """
    both = bars.select("ts", F.col("ts").alias("cal_ts")).distinct().unionByName(asked.select(F.col("asked_ts").alias("ts"), F.lit(None).cast("timestamp_ntz").alias("cal_ts")).distinct())
    known = both.select("ts", F.max("cal_ts").over(W.orderBy("ts").rangeBetween(W.unboundedPreceding, 0)).alias("cal_ts")).distinct()
    at = asked.join(known.withColumnRenamed("ts", "asked_ts"), "asked_ts")
    return at.join(bars.select("symbol", F.col("ts").alias("cal_ts"), *FIELDS), ["symbol", "cal_ts"], "left").select("symbol", "asked_ts", "cal_ts", *FIELDS)


def bound(bars: DataFrame, where, *, end: bool) -> int:
    """The position that an integer (from the end if negative) or a time stands for: the first at or after a start, the last at or before an end."""
    times = calendar(bars)
    n = times.count()
    if isinstance(where, int):
        pos = where + n if where < 0 else where
    else:
        at = F.lit(str(where)).cast("timestamp_ntz")
        pos = (times.filter(F.col("ts") <= at).agg(F.max("pos")) if end else times.filter(F.col("ts") >= at).agg(F.min("pos"))).first()[0]
    if pos is None or not 0 <= pos < n:
        raise BarsError(f"{where} is outside the calendar of {n} bars")
    return int(pos)
