"""Small bar tables written out by hand."""

import datetime as dt

from barloom.schemas import BARS

DAY = dt.date(2024, 3, 4)


def at(minute: int, day: dt.date = DAY) -> dt.datetime:
    return dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=minute)


def make_bars(spark, closes, ticker="T", day=DAY, start=600, step=5, premarket=0, opens=None,
              highs=None, lows=None, volumes=None):
    rows = []
    for k, c in enumerate(closes):
        o = c if opens is None else opens[k]
        rows.append((ticker, day, at(start + k * step, day), float(o),
                     float(max(o, c) if highs is None else highs[k]),
                     float(min(o, c) if lows is None else lows[k]),
                     float(c), int(100 if volumes is None else volumes[k]), k < premarket))
    return spark.createDataFrame(rows, BARS)
