"""Reports of small results: text, charts as SVG, and a page that stands alone.

Everything heavy is aggregated in Spark first; what comes here are rows of
metrics, and curves thinned to what a chart can show.
"""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import metrics


def percent(x) -> str:
    return "n/a" if x is None or math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else _signless(f"{x * 100:.2f}%")


def number(x, digits: int = 2) -> str:
    return "n/a" if x is None or math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else _signless(f"{x:,.{digits}f}")


def money(x) -> str:
    return "n/a" if x is None or math.isnan(x) else _signless(f"{x:,.0f}")


def _signless(text: str) -> str:
    """No minus on a zero, and a true minus elsewhere."""
    if not any(c in "123456789" for c in text):
        return text.lstrip("-")
    return text.replace("-", "−")


def table(rows: list[tuple], head: tuple | None = None) -> str:
    """Aligned columns; the first to the left, the others to the right."""
    cells = [[str(c) for c in r] for r in ([head] if head else []) + rows]
    if not cells:
        return ""
    widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    lines = ["  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths, strict=True))).rstrip() for r in cells]
    return "\n".join(lines[:1] + ["-" * sum(widths, 2 * (len(widths) - 1))] * bool(head) + lines[1:])


#: metric -> how it is shown
SHOWN = {
    "total_return": percent, "cagr": percent, "volatility": percent, "downside_deviation": percent, "sharpe": number, "sortino": number, "calmar": number,
    "max_drawdown": percent, "drawdown_duration": lambda x: "n/a" if x is None else f"{x} bars", "turnover": number, "exposure": percent, "time_in_market": percent,
}


def summary(row: dict, versus: dict | None = None, trades: dict | None = None) -> str:
    parts = ["Performance", table([(k.replace("_", " "), f(row[k])) for k, f in SHOWN.items() if k in row])]
    if versus:
        parts += ["", "Against the benchmark", table([(k.replace("_", " "), number(v)) for k, v in versus.items() if k != "run_id"])]
    if trades:
        parts += ["", "Trades", table([(k.replace("_", " "), number(v) if isinstance(v, float) else str(v)) for k, v in trades.items() if k != "run_id"])]
    return "\n".join(parts)


def nice_step(span: float, n: int = 5) -> float:
    """1, 2 or 5 times a power of ten, for about ``n`` steps."""
    if span <= 0:
        return 1.0
    raw = span / n
    unit = 10 ** math.floor(math.log10(raw))
    return next(m * unit for m in (1, 2, 5, 10) if m * unit >= raw * (1 - 1e-9))


def ticks(lo: float, hi: float, n: int = 5) -> list[float]:
    step = nice_step(hi - lo, n)
    first = math.ceil(lo / step - 1e-9)
    return [k * step for k in range(first, math.floor(hi / step + 1e-9) + 1)]


def line_chart(series: dict[str, list[tuple[float, float]]], title: str, form=number, width: int = 760, height: int = 220) -> str:
    """Lines of (x, y) points; points without a y break the line."""
    points = [p for s in series.values() for p in s if p[1] is not None and math.isfinite(p[1])]
    if not points:
        return f'<svg viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title></svg>'
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    y1 = y1 if y1 > y0 else y0 + 1
    px = lambda x: 60 + (width - 70) * ((x - x0) / (x1 - x0) if x1 > x0 else 0.5)
    py = lambda y: 24 + (height - 48) * (1 - (y - y0) / (y1 - y0))
    out = [f'<svg viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title><text x="60" y="14">{html.escape(title)}</text>']
    for t in ticks(y0, y1):
        out.append(f'<line class="grid" x1="60" x2="{width - 10}" y1="{py(t):.1f}" y2="{py(t):.1f}"/><text class="tick" x="54" y="{py(t) + 4:.1f}" text-anchor="end">{html.escape(form(t))}</text>')
    for i, (name, s) in enumerate(series.items()):
        path, pen = [], "M"
        for x, y in s:
            if y is None or not math.isfinite(y):
                pen = "M"
            else:
                path.append(f"{pen}{px(x):.1f} {py(y):.1f}")
                pen = "L"
        out.append(f'<path class="s{i % 4}" d="{" ".join(path)}"><title>{html.escape(name)}</title></path>')
    return "".join(out) + "</svg>"


def bar_chart(bars: list[tuple[str, float]], title: str, width: int = 760, height: int = 180) -> str:
    top = max((abs(v) for _, v in bars), default=0) or 1
    wide = (width - 20) / max(len(bars), 1)
    out = [f'<svg viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title><text x="10" y="14">{html.escape(title)}</text>']
    for i, (name, v) in enumerate(bars):
        h = (height - 40) * abs(v) / top
        out.append(f'<rect class="s0" x="{10 + i * wide:.1f}" y="{height - 10 - h:.1f}" width="{max(wide - 1, 1):.1f}" height="{h:.1f}"><title>{html.escape(f"{name}: {v}")}</title></rect>')
    return "".join(out) + "</svg>"


_STYLE = (
    "body{font:14px system-ui,sans-serif;max-width:820px;margin:2em auto;color:#222;background:#fff}table{border-collapse:collapse}td,th{padding:2px 10px;text-align:right}td:first-child{text-align:left}"
    "svg{width:100%;font-size:11px}path{fill:none;stroke-width:1.5}.grid{stroke:#ddd}.tick{fill:#666}.s0{stroke:#1f6f8b;fill:none}rect.s0{fill:#1f6f8b;stroke:none}.s1{stroke:#c45a2c}.s2{stroke:#5a7d3a}.s3{stroke:#7a5195}"
)


def page(title: str, equity: DataFrame, run_id=None, buckets: int = 300) -> str:
    """A tear sheet of one run's equity as HTML without links to elsewhere."""
    own = equity if run_id is None else equity.filter(F.col("run_id") == run_id)
    row = metrics.summary(own).first().asDict()
    thin = lambda df, c: [(r.pos, r[c]) for r in metrics.decimated(df, c, buckets).orderBy("pos").collect()]
    rets = metrics.returns(own)
    rolled = metrics.rolling_sharpe(rets, 126).filter("rolling_sharpe is not null")
    months = {(r.year, r.month): r.r for r in metrics.monthly_returns(rets).collect()} if "ts" in own.columns else {}
    bins = [(str(r.bin), r.n) for r in metrics.histogram(rets).orderBy("bin").collect()]
    cells = lambda y: "".join(f"<td>{percent(months[y, m]) if (y, m) in months else ''}</td>" for m in [*range(1, 13), 0])
    heat = "".join(f"<tr><td>{y}</td>{cells(y)}</tr>" for y in sorted({y for y, _ in months}))
    head = "".join(f"<th>{m}</th>" for m in ["", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Year"])
    facts = "".join(f"<tr><td>{html.escape(k.replace('_', ' '))}</td><td>{html.escape(f(row[k]))}</td></tr>" for k, f in SHOWN.items())
    body = [
        f"<h1>{html.escape(title)}</h1><table>{facts}</table>", line_chart({"equity": thin(own, "equity")}, "Equity", money),
        line_chart({"drawdown": thin(metrics.drawdowns(own).withColumn("drawdown", -F.col("drawdown")), "drawdown")}, "Drawdown", percent),
        line_chart({"sharpe": thin(rolled, "rolling_sharpe")}, "Rolling Sharpe ratio, 126 bars"), bar_chart(bins, "Returns"), f"<h2>Monthly returns</h2><table><tr>{head}</tr>{heat}</table>",
    ]
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body>{"".join(body)}</body></html>'


def plot(equity: DataFrame, path: str) -> None:
    """Equity and drawdown as an image; needs matplotlib."""
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("plots need matplotlib; the HTML page doesn't") from e
    rows = metrics.drawdowns(equity).orderBy("pos").toPandas()  # one run: the calendar
    _, (top, low) = plt.subplots(2, 1, sharex=True)
    top.plot(rows["pos"], rows["equity"])
    low.fill_between(rows["pos"], -rows["drawdown"], 0)
    plt.savefig(path)
