"""Normalization, scoring, folds and augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import pct_change
from ..operators import dataset as D, performance as P, scoring as M, sessions as S, walkforward as W
from ..operators.features import scored_columns
from ..operators.labels import binarize
from ..plans import training as TR
from ..runtime import materialize
from ..schemas import SCORED
from ..sources import adapters as A
from .kit import COARSE, T_WINDOW, VIEWS, final, sql
from .rows import BAR, FEATURE_SQL, FEATURES

QUERIES: dict = {}
SQL: dict[str, str] = {}

RECENT = "2024-01-17"
INPUTS = len(SCORED)


def weights(a: int, b: int) -> M.Layers:
    """A fixed test network: every weight follows from its row and column number."""
    def grid(rows: int, cols: int, p: int, q: int, m: int, scale: float) -> np.ndarray:
        j, i = np.mgrid[0:rows, 0:cols]
        return ((i * p + j * q) % m - m // 2) / scale
    return [(grid(128, INPUTS, a, b, 23, 100.0), grid(1, 128, 3, 1, 5, 10.0)[0]),
            (grid(128, 128, b, a, 19, 200.0), grid(1, 128, 7, 1, 11, 20.0)[0]),
            (grid(1, 128, 5, a, 13, 50.0), np.array([0.05]))]


ALL_NET, RECENT_NET = (31, 17), (29, 11)


def _grid_sql(rows: int, cols: int, p: int, q: int, m: int, scale: float) -> str:
    return (f"list_transform(range({rows}), lambda j: list_transform(range({cols}), "
            f"lambda i: ((i * {p} + j * {q}) % {m} - {m // 2}) / CAST({scale} AS DOUBLE)))")


def net_sql(name: str, a: int, b: int) -> str:
    return (f"SELECT {_grid_sql(128, INPUTS, a, b, 23, 100.0)} AS w1, {_grid_sql(1, 128, 3, 1, 5, 10.0)}[1] AS b1, "
            f"{_grid_sql(128, 128, b, a, 19, 200.0)} AS w2, {_grid_sql(1, 128, 7, 1, 11, 20.0)}[1] AS b2, "
            f"{_grid_sql(1, 128, 5, a, 13, 50.0)}[1] AS w3")


def _dense(x: str, w: str, b: str, f: str) -> str:
    return f"list_transform(range(1, 129), lambda k: {f.replace('@', f'(list_dot_product({x}, {w}[k]) + {b}[k])')})"


def forward(source: str, net: str) -> str:
    """Rows of ``source(keys, x)`` with the probability ``p`` of ``net``."""
    return f"""SELECT * EXCLUDE (x, h1, h2, w1, b1, w2, b2, w3), 1 / (1 + exp(-(list_dot_product(h2, w3) + 0.05))) AS p FROM (
        SELECT *, {_dense('h1', 'w2', 'b2', 'CASE WHEN @ > 0 THEN @ ELSE 0.05 * @ END')} AS h2 FROM (
        SELECT *, {_dense('x', 'w1', 'b1', 'tanh(@)')} AS h1 FROM {source} CROSS JOIN {net}))"""


def standardized(view: str) -> str:
    xs = ", ".join(f"({c} - (SELECT avg({c}) FROM {view})) / (SELECT stddev_samp({c}) FROM {view})" for c in SCORED)
    return f"(SELECT ticker, session, bar_ts, [{xs}] AS x FROM hard)"


VIEWS.update({
    "recent_hard": f"SELECT * FROM hard WHERE session >= DATE '{RECENT}'",
    "net_all": net_sql("net_all", *ALL_NET),
    "net_recent": net_sql("net_recent", *RECENT_NET),
    "p_alls": forward(standardized("hard"), "net_all"),
    "p_recents": forward(standardized("recent_hard"), "net_recent"),
})


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return register


def hard(spark, d) -> DataFrame:
    """The labelled set, stored: statistics, scoring and training each read it."""
    rows = TR.labelled_anchors(*A.market(spark, d), COARSE)
    return materialize(binarize(rows), "hard")


@query("prj_09_zscore", sql(
    ["ticker", "d:session", "t:bar_ts", *[f"r:{c}=({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in SCORED]],
    "FROM hard"))
def _(spark, d):
    rows = hard(spark, d)
    return final(D.zscore(rows, D.feature_stats(rows)), *BAR, *SCORED)


def two_scores(spark, d) -> DataFrame:
    rows = hard(spark, d)
    recent = rows.filter(F.col("session") >= F.lit(RECENT).cast("date"))
    return M.score(rows, rows, recent, weights(*ALL_NET), weights(*RECENT_NET))


@query("scr_01_score", sql(
    ["ticker", "d:session", "t:bar_ts", "r:p_all=a.p", "r:p_recent=r.p"],
    "FROM p_alls a JOIN p_recents r USING (ticker, session, bar_ts)"))
def _(spark, d):
    return final(two_scores(spark, d), *BAR, "p_all", "p_recent")


@query("scr_02_mlp_score", sql(["ticker", "d:session", "t:bar_ts", "r:p", "b:p_hit=p > 0.5"], "FROM p_alls"))
def _(spark, d):
    rows = hard(spark, d)
    z = D.zscore(rows, D.feature_stats(rows))
    return final(M.mlp_score(scored_columns(z, tuple(BAR)), weights(*ALL_NET)), *BAR, "p", "p_hit")


BOTH = ("CAST(a.p > 0.5 AND r.p > 0.5 AS INTEGER)", "FROM p_alls a JOIN p_recents r USING (ticker, session, bar_ts)")


@query("scr_03_ensemble_and", sql(["ticker", "d:session", "t:bar_ts", f"i:signal={BOTH[0]}"], BOTH[1]))
def _(spark, d):
    return final(two_scores(spark, d), *BAR, "signal")


@query("jn_06_ensemble_counts", sql(["b:hit_all=a.p > 0.5", "b:hit_recent=r.p > 0.5", f"i:signal=sum({BOTH[0]})",
                                     "i:n=count(*)"], BOTH[1] + " GROUP BY a.p > 0.5, r.p > 0.5"))
def _(spark, d):
    out = two_scores(spark, d).groupBy(F.col("p_all_hit").alias("hit_all"), F.col("p_recent_hit").alias("hit_recent"))
    return final(out.agg(F.sum("signal").alias("signal"), F.count(F.lit(1)).alias("n")))


@query("scr_04_train_logistic")
def _(spark, d):
    """Fitted on the earlier sessions, judged on the recent ones."""
    rows = hard(spark, d)
    recent = F.col("session") >= F.lit(RECENT).cast("date")
    model = M.train(rows.filter(~recent), SCORED, max_iter=10)
    out = model.transform(rows.filter(recent)).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n_rows"))
    return final(out)


@query("scr_05_heldout_set", sql(["ticker", "d:session", "t:bar_ts", "i:i", *FEATURE_SQL, "y"], "FROM recent_hard"))
def _(spark, d):
    log = (A.event_log(spark, d).filter(F.col("session") >= F.lit(RECENT).cast("date"))
           .withColumn("start_ts", F.col("session").cast("timestamp")))
    fine, fund = A.market(spark, d)
    rows = TR.build_training_set(fine, log, fund, COARSE, 86400)
    return final(rows, *BAR, "i", *FEATURES, "y")


MONTH = "((year(session) - 1995) * 12 + month(session) - 1)"


@query("scr_06_walk_forward", sql(
    ["fold", "role", "i:n_rows=count(*)", "d:first_day=min(session)", "d:last_day=max(session)", "i:volume=sum(day_volume)"],
    f"""FROM (SELECT *, CASE WHEN m >= f AND m < f + 12 THEN 'train' WHEN m = f + 12 THEN 'validate'
        WHEN m = f + 13 THEN 'test' END AS role, f + 1 AS fold FROM (SELECT *, {MONTH} AS m,
        unnest([0, 1, 2, 3]) AS f FROM supplied)) WHERE role IS NOT NULL GROUP BY fold, role"""))
def _(spark, d):
    tagged = D.walk_forward(A.lineitem_daily(spark, d), "1995-01-01", 12)
    return final(tagged.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("session").alias("first_day"),
        F.max("session").alias("last_day"), F.sum("day_volume").alias("volume")))


LEARNED = ["ret1", "ret5", "day_range", "log_volume", "rvol"]


def daily_examples(spark, d) -> DataFrame:
    """Features of each ticker's day, the return of its next session, and whether that is up; folds
    of two years and two months each."""
    days = Window.partitionBy("ticker").orderBy("session")
    price = F.col("price")
    rows = (S.relative_volume(A.lineitem_daily(spark, d)).withColumn("price", F.col("turnover") / F.col("day_volume"))
            .withColumns({"ret1": pct_change("price", F.lag("price", 1).over(days)), "ret5": pct_change("price", F.lag("price", 5).over(days)),
                          "day_range": (F.col("day_high") - F.col("day_low")) / price, "log_volume": F.log1p(F.col("day_volume").cast("double")),
                          "pct": pct_change(F.lead("price").over(days), "price")})
            .withColumn("y", F.when(F.col("pct").isNotNull(), (F.col("pct") > 0).cast("int"))))
    return D.walk_forward(rows.select("ticker", "session", *LEARNED, "pct", "y"), "1994-01-01", 24)


def decided(spark, d) -> DataFrame:
    tagged = materialize(daily_examples(spark, d), "examples")
    scored = materialize(W.probabilities(tagged, materialize(W.fit(tagged, LEARNED), "models"), LEARNED), "scored")
    return W.decide(scored, W.thresholds(scored))


_KNOWN = ", ".join(f"coalesce({c}, avg({c}) FILTER (role = 'train' AND y IS NOT NULL) OVER (PARTITION BY fold), 0) AS {c}" for c in LEARNED)
_SIDES = ", ".join(f"avg({c}) FILTER (y = {k}) AS {c}_m{k}, greatest(var_pop({c}) FILTER (y = {k}), 1e-9) AS {c}_v{k}" for c in LEARNED for k in (0, 1))
_ODDS = " + ".join(f"(ln({c}_v0 / {c}_v1) + pow({c} - {c}_m0, 2) / {c}_v0 - pow({c} - {c}_m1, 2) / {c}_v1) / 2" for c in LEARNED)
_WMONTH = "((year(session) - 1994) * 12 + month(session) - 1)"
VIEWS.update({
    "wdays": """SELECT ticker, session, (price - lag(price) OVER w) / lag(price) OVER w * 100 AS ret1, (price - lag(price, 5) OVER w) / lag(price, 5) OVER w * 100 AS ret5,
        (day_high - day_low) / price AS day_range, ln(1 + day_volume) AS log_volume, day_volume / nullif(avg(day_volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS rvol,
        (lead(price) OVER w - price) / price * 100 AS pct FROM (SELECT *, turnover / day_volume AS price FROM supplied) WINDOW w AS (PARTITION BY ticker ORDER BY session)""",
    "wtagged": f"""SELECT *, CASE WHEN m >= f AND m < f + 24 THEN 'train' WHEN m = f + 24 THEN 'validate' WHEN m = f + 25 THEN 'test' END AS role, f + 1 AS fold
        FROM (SELECT *, CAST(pct > 0 AS INTEGER) AS y, {_WMONTH} AS m, unnest([0, 1, 2, 3]) AS f FROM wdays)""",
    "wfilled": f"SELECT ticker, session, fold, role, y, pct, {_KNOWN} FROM wtagged WHERE role IS NOT NULL",
    "wmodel": f"SELECT fold, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, {_SIDES} FROM wfilled WHERE role = 'train' AND y IS NOT NULL GROUP BY fold",
    "wscored2": f"SELECT ticker, session, fold, role, y, pct, 1 / (1 + exp(-(ln(n1 / n0) + {_ODDS}))) AS p FROM wfilled JOIN wmodel USING (fold)",
    "wbins": "SELECT fold, least(floor(p * 100), 99) AS bin, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM wscored2 WHERE role = 'validate' AND y IS NOT NULL GROUP BY 1, 2",
    "wchosen": """SELECT fold, CAST(bin AS BIGINT) AS threshold FROM (SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        + coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good FROM wbins)
        QUALIFY row_number() OVER (PARTITION BY fold ORDER BY good DESC, bin) = 1""",
    "wdecided": "SELECT s.*, threshold, CAST(least(floor(p * 100), 99) >= threshold AS INTEGER) AS hit FROM wscored2 s JOIN wchosen USING (fold) WHERE role = 'test'",
})


@query("scr_06_walk_forward_scores", sql("ticker d:session fold r:p i:threshold i:hit", "FROM wdecided"))
def _(spark, d):
    """Every row of every fold's test month, also those with missing features or without a next session."""
    return final(decided(spark, d), "ticker", "session", "fold", "p", "threshold", "hit")


@query("scr_06_walk_forward_metrics", sql(
    ["fold", "i:threshold", "i:n_rows=count(*)", "i:n_pos=sum(y)", "i:n_hits=sum(hit)", "r:accuracy=avg(CAST(hit = y AS INTEGER))",
     "r:precision=sum(hit * y) / nullif(sum(hit), 0)", "r:recall=sum(hit * y) / sum(y)",
     "r:roc_area=(sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))"],
    """FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY fold, round(p * 10000)) - 1) / 2 AS mid FROM wdecided WHERE y IS NOT NULL
       WINDOW w AS (PARTITION BY fold ORDER BY round(p * 10000))) GROUP BY fold, threshold"""))
def _(spark, d):
    return final(W.metrics(decided(spark, d)))


@query("ag_13_walk_forward", sql(
    ["fold=coalesce(fold, 0)", "i:n_trades=count(*)", "r:sum_pct=sum(pct)", "r:win_rate=avg(CAST(pct > 0 AS DOUBLE))",
     "r:profit_factor=sum(pct) FILTER (pct > 0) / nullif(-sum(pct) FILTER (pct < 0), 0)"],
    "FROM wdecided WHERE hit = 1 AND pct IS NOT NULL GROUP BY ROLLUP (fold)"))
def _(spark, d):
    """One trade per hit of the test months, held to the next session, by the fold whose model took it."""
    trades = decided(spark, d).filter("hit = 1 AND pct IS NOT NULL").select("fold", "pct")
    return final(P.performance_by_fold(trades))


def _uniform(seed: str) -> str:
    return (f"((CAST('0x' || substr(md5(concat_ws('|', '{seed}', ticker, CAST(epoch(bar_ts) AS BIGINT), shift)), 1, 8) AS BIGINT) + 0.5)"
            " / 4294967296.0::DOUBLE)")


MOVED = " UNION ALL ".join(
    f"SELECT ticker, session, bar_ts, {s} AS shift, " + ", ".join(
        (f"lag({c}, {s})" if s > 0 else f"lead({c}, {-s})") + f" OVER ({T_WINDOW}) AS {c}" if s else c
        for c in ("open", "close", "volume")) + " FROM bars" for s in (-2, -1, 0, 1, 2))
NOISE = f"(1 + 0.001 * sqrt(-2 * ln({_uniform('a:a')})) * cos(2 * pi() * {_uniform('a:b')}))"


@query("scr_07_augment", sql(
    ["ticker", "d:session", "t:bar_ts", "i:shift", f"r:open=open * {NOISE}", f"r:close=close * {NOISE}",
     f"i:volume=CASE WHEN {_uniform('a:volume')} < 0.1 THEN 0 ELSE volume END"],
    f"FROM ({MOVED}) WHERE close IS NOT NULL"))
def _(spark, d):
    return final(D.augment(A.bars(spark, d)), *BAR, "shift", "open", "close", "volume")
