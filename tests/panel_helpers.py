"""Hand-made panels for the tests."""

import datetime as dt

PANEL = "ticker string, date date, open double, high double, low double, close double, vol double"


def d(i: int, start=dt.date(2020, 1, 6)) -> dt.date:
    """i-th calendar day after a Monday."""
    return start + dt.timedelta(days=i)


def walk(n, seed=1, start=100.0):
    import random
    rnd = random.Random(seed)
    out, p = [], start
    for _ in range(n):
        p = max(1.0, p * (1 + rnd.gauss(0, 0.02)))
        out.append(p)
    return out


def make_panel(spark, series: dict, spread=0.01):
    """series: ticker -> list of closes (consecutive days); OHLC around close."""
    rows = []
    for t, closes in series.items():
        for i, c in enumerate(closes):
            rows.append((t, d(i), c * (1 - spread / 2), c * (1 + spread), c * (1 - spread), c, 1000.0 + i))
    return spark.createDataFrame(rows, PANEL)
