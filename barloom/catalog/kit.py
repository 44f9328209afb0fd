"""Shared pieces of the catalog: result normalization and the SQL views.

Results are compared as values, so both sides round doubles to six places and print
dates and times as text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.adapters import COARSE, FINE, OPEN_MINUTE


def final(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Selected columns in comparable form."""
    out = []
    for f in (df.select(*cols) if cols else df).schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, places)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)      # no negative zero
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def _col(spec: str) -> str:
    kind, _, rest = spec.partition(":") if re.match(r"^[rpdtbi]:", spec) else ("", "", spec)
    name, eq, expr = rest.partition("=")
    expr = expr if eq else name
    if kind in ("r", "p"):
        value = f"round(CAST({expr} AS DOUBLE), {6 if kind == 'r' else 8})"
        expr = f"(CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END)"
    elif kind == "d":
        expr = f"CAST(CAST({expr} AS DATE) AS VARCHAR)"
    elif kind == "t":
        expr = f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
    elif kind == "b":
        expr = f"CAST({expr} AS INTEGER)"
    elif kind == "i":
        expr = f"CAST({expr} AS BIGINT)"
    return f"{expr} AS {name}"


def sql(cols: str | list[str], tail: str) -> str:
    """SELECT with the views the text mentions. Column marks: r rounded, p rounded to
    eight places (a price times a basis-point factor ends in a half at six), d date,
    t timestamp, b 0/1, i integer; ``name=expression`` gives an expression."""
    cols = cols.split() if isinstance(cols, str) else cols
    return with_views(f"SELECT {', '.join(_col(c) for c in cols)}\n{tail}")


def with_views(body: str) -> str:
    need: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(view)
                need.append(name)

    visit(body)
    if not need:
        return body
    parts = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    return f"WITH RECURSIVE {parts}\n{body}"


T_WINDOW = "PARTITION BY ticker, session ORDER BY bar_ts"


def _bars(seconds: int, source: str = "ticks") -> str:
    bucket = f"time_bucket(INTERVAL {seconds} SECOND, ts)"
    return f"""SELECT ticker, session, {bucket} AS bar_ts,
        first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, event_id) AS close, CAST(sum(vol) AS BIGINT) AS volume,
        (hour({bucket}) * 60 + minute({bucket})) < {OPEN_MINUTE} AS is_premarket
        FROM {source} GROUP BY 1, 2, 3"""


def lags(cols: list[str], n: int, shift: int, prefix: str) -> str:
    out = []
    for k in range(n, 0, -1):
        for c in cols:
            by = k - shift
            out.append((f"lag({c}, {by}) OVER t" if by else c) + f" AS {prefix}_{k}_{c}")
    return ", ".join(out)


PRESSURE = ("((close - low) - (high - close)) / open * 1000 AS u, "
            "((close - low) - (high - close)) / open * 1000 * (volume / float_shares * 100) AS w")

VIEWS: dict[str, str] = {
    "ticks": """SELECT event_type AS ticker, CAST(ts AS DATE) AS session, ts, 100 + value / 10 AS price,
        CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS vol, event_id FROM events""",
    "fine": _bars(FINE),
    "bars": _bars(COARSE),
    "fund": """SELECT ticker, max(price) AS high52, min(price) AS low52,
        1000000.0 * length(ticker) AS float_shares FROM ticks GROUP BY 1""",
    "log_events": "SELECT ticker, session, min(ts) AS start_ts FROM ticks GROUP BY 1, 2",
    "pbars": f"SELECT bars.*, float_shares, high52, low52, {PRESSURE} FROM bars JOIN fund USING (ticker)",
    "pfine": f"SELECT fine.*, float_shares, high52, low52, {PRESSURE} FROM fine JOIN fund USING (ticker)",
    "pos": f"""SELECT *, CASE WHEN NOT is_premarket THEN count(*) FILTER (NOT is_premarket) OVER t - 1 END AS i,
        count(*) FILTER (NOT is_premarket) OVER (PARTITION BY ticker, session) AS n
        FROM pbars WINDOW t AS ({T_WINDOW})""",
    "fine_looked": f"""SELECT ticker, session, bar_ts, {lags(['w', 'u'], 5, 1, 'f1')}
        FROM pfine WINDOW t AS ({T_WINDOW})""",
    "fine_last": f"""SELECT * EXCLUDE (bar_ts, rn) FROM (SELECT *,
        time_bucket(INTERVAL {COARSE} SECOND, bar_ts) AS coarse_ts,
        row_number() OVER (PARTITION BY ticker, session, time_bucket(INTERVAL {COARSE} SECOND, bar_ts)
                           ORDER BY bar_ts DESC) AS rn FROM fine_looked) WHERE rn = 1""",
    "pre": """SELECT ticker, session, max(high) FILTER (is_premarket) AS pm_high,
        min(low) FILTER (is_premarket) AS pm_low,
        arg_min(high, bar_ts) FILTER (NOT is_premarket) AS first_high FROM bars GROUP BY 1, 2""",
    "gains": f"""SELECT *, {', '.join(f'(lead(close, {k}) OVER t - close) / close * 100 AS g{k}' for k in (1, 2, 3))}
        FROM pos WINDOW t AS ({T_WINDOW})""",
    "labelled": """SELECT *, CASE WHEN g1 IS NULL THEN NULL WHEN g1 >= 5 THEN 1.0 WHEN g1 <= -5 THEN 0.0
        WHEN g2 IS NULL THEN NULL WHEN g2 >= 5 THEN 1.0 WHEN g2 <= -5 THEN 0.0
        WHEN g3 IS NULL THEN NULL WHEN g3 >= 5 THEN 1.0 WHEN g3 <= -5 THEN 0.0
        ELSE (5 + g3) / 10 END AS y FROM gains""",
    "ranges": f"""SELECT *, max(high) OVER t AS day_high, min(low) OVER t AS day_low FROM labelled
        WINDOW t AS ({T_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "looked": f"SELECT *, {lags(['w', 'u'], 8, 0, 'f5')} FROM ranges WINDOW t AS ({T_WINDOW})",
    "feats": """SELECT looked.*, 1 AS good_news, 0 AS earnings,
        1 - close / high52 AS high52_ratio, 1 - low52 / close AS low52_ratio,
        CASE WHEN pm_high > 0 THEN 1 - first_high / pm_high END AS pm_high_ratio,
        CASE WHEN pm_high > 0 THEN 1 - pm_low / first_high END AS pm_low_ratio,
        1 - open / day_high AS day_high_ratio, 1 - day_low / open AS day_low_ratio, """
        + ", ".join(f"f5_{k}_w * f5_{k}_w AS f5_{k}_sq" for k in range(8, 0, -1)) + ", "
        + ", ".join(f"f1_{k}_w, f1_{k}_u, f1_{k}_w * f1_{k}_w AS f1_{k}_sq" for k in range(5, 0, -1))
        + """ FROM looked JOIN pre USING (ticker, session)
        LEFT JOIN fine_last ON looked.ticker = fine_last.ticker AND looked.session = fine_last.session
            AND looked.bar_ts = fine_last.coarse_ts""",
    "anchored": """SELECT * FROM feats WHERE i >= 8 AND i < round_even(n / 2.0, 0) + 10 AND y IS NOT NULL
        AND f1_5_u IS NOT NULL AND f1_4_u IS NOT NULL AND f1_3_u IS NOT NULL AND f1_2_u IS NOT NULL
        AND f1_1_u IS NOT NULL""",
    "hard": "SELECT * REPLACE (CASE WHEN y >= 0.7 THEN 1 ELSE 0 END AS y) FROM anchored",
    "days": """SELECT ticker, session, arg_min(open, bar_ts) FILTER (NOT is_premarket) AS day_open,
        max(high) AS day_high, min(low) AS day_low, arg_max(close, bar_ts) AS day_close,
        CAST(sum(volume) AS BIGINT) AS day_volume FROM bars GROUP BY 1, 2""",
    "gaps": """SELECT *, (day_open - prev_close) / prev_close * 100 AS gap_pct FROM (SELECT *,
        lag(day_close) OVER (PARTITION BY ticker ORDER BY session) AS prev_close FROM days)""",
    "rvols": """SELECT *, day_volume / nullif(avg(day_volume) OVER (PARTITION BY ticker ORDER BY session
        ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS rvol FROM gaps""",
    "supplied": """SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS session,
        max(l_extendedprice / l_quantity) AS day_high, min(l_extendedprice / l_quantity) AS day_low,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS day_volume, sum(l_extendedprice) AS turnover
        FROM lineitem GROUP BY 1, 2""",
}
