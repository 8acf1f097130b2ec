"""Pictures of small results. Needs matplotlib, which nothing else here does; what is drawn is a row per day or per lag."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.operators.frames import ordered, rolling

MOST = 100_000


def _rows(df: DataFrame, order: str, cols: list[str]) -> dict[str, list]:
    rows = df.select(order, *cols).orderBy(order).take(MOST + 1)
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} points aren't a picture")
    return {c: [r[c] for r in rows] for c in (order, *cols)}


def smoothed(daily: DataFrame, order: str, x: str, n: int = 20, least: int = 5) -> DataFrame:
    return daily.withColumn(x, rolling(F.avg, F.col(x), ordered([], order), n, least))


def lines(df: DataFrame, order: str, cols: list[str], path: str, title: str, right: str | None = None) -> None:
    """Columns over order; `right` has an axis of its own."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    data = _rows(df, order, cols)
    fig, ax = plt.subplots(figsize=(10, 5))
    for c in cols:
        (ax.twinx() if c == right else ax).plot(data[order], data[c], label=c)
    ax.set_title(title)
    ax.legend()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fig.savefig(path)
    plt.close(fig)


def bars(df: DataFrame, order: str, col: str, path: str, title: str, error: str | None = None) -> None:
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    data = _rows(df, order, [col] + [error] * bool(error))
    fig, ax = plt.subplots(figsize=(8, 4))
    ax.bar(data[order], data[col], yerr=[2 * e for e in data[error]] if error else None)
    ax.set_title(title)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fig.savefig(path)
    plt.close(fig)
