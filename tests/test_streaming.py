"""Streaming twins over several micro-batches, restarts and late rows."""

import datetime as dt
import os

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B, trades as T
from barloom.plans.training import live_features
from barloom.sources import adapters as A, streams as SRC
from barloom.streaming import bars as SB, live as LV, state as ST
from tests.helpers import make_bars

FMT = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def same(a, b):
    b = b.select(a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def land(quotes, path, **part):
    quotes.drop("session").write.mode("append").option(*FMT).json(path)


def follow(spark, stream, path, max_files=None):
    reader = spark.readStream.schema(stream.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


@pytest.mark.parametrize("days_per_file", [5, 12])
def test_bars_and_volume_over_micro_batches(spark, small, tmp_path, days_per_file):
    """Two different splits of the feed, both stages run after each part has landed."""
    p = lambda n: str(tmp_path / n)
    quotes = A.as_quotes(A.ticks(spark, small))
    closing = A.as_quotes(A.as_ticks(spark.read.parquet(SRC.write_closing(spark, p("closing")))))
    day = F.dayofmonth("session")
    parts = [quotes.filter((day >= d) & (day < d + days_per_file)) for d in range(1, 31, days_per_file)]
    for part in [*parts, closing]:
        land(part, p("in"))
        stream = SB.stream_quote_bars(SRC.stream_quotes(spark, p("in")), A.COARSE)
        assert SB.late_rows(SB.run_available(stream, p("bars"), p("c1"))) == 0
        SB.run_available(ST.stream_volume_delta(follow(spark, stream, p("bars"))), p("out"), p("c2"))
    want = B.volume_delta(B.quote_bars(quotes, A.COARSE))
    same(want.select("ticker", "session", "bar_ts", "close", "volume"), spark.read.parquet(p("out")))


def test_max_files_gives_several_batches(spark, small, tmp_path):
    p = lambda n: str(tmp_path / n)
    quotes = A.as_quotes(A.ticks(spark, small))
    for d in (1, 11, 21):
        land(quotes.filter(F.dayofmonth("session").between(d, d + 9)).coalesce(1), p("in"))
    stream = SRC.stream_quotes(spark, p("in"), max_files=1)
    q = SB.run_available(stream, p("out"), p("c"))
    assert len([x for x in q.recentProgress if x.numInputRows]) >= 3
    assert spark.read.parquet(p("out")).count() == quotes.count()


def test_state_survives_a_restart(spark, tmp_path):
    """The second half of a session arrives in a later run of the same checkpoint."""
    p = lambda n: str(tmp_path / n)
    bars = make_bars(spark, [10, 11, 12, 13]).withColumns(
        {"total_open": (F.minute("bar_ts") + 100).cast("long"), "total_close": (F.minute("bar_ts") + 104).cast("long")})
    cut = F.col("close") < 12
    for part in (bars.filter(cut), bars.filter(~cut)):
        part.coalesce(1).write.mode("append").parquet(p("bars"))
        SB.run_available(ST.stream_volume_delta(follow(spark, bars, p("bars"))), p("out"), p("c"))
    got = spark.read.parquet(p("out")).orderBy("bar_ts").collect()
    assert [r.volume for r in got] == [4, 5, 5, 5]


def test_late_rows_are_counted(spark, small, tmp_path):
    p = lambda n: str(tmp_path / n)
    quotes = A.as_quotes(A.ticks(spark, small))
    late = F.dayofmonth("session") < 10
    land(quotes.filter(~late), p("in"))
    stream = lambda: SB.stream_quote_bars(SRC.stream_quotes(spark, p("in")), A.COARSE)
    assert SB.late_rows(SB.run_available(stream(), p("out"), p("c"))) == 0
    land(quotes.filter(late), p("in"))
    assert SB.late_rows(SB.run_available(stream(), p("out"), p("c"))) > 0
    assert spark.read.parquet(p("out")).filter(late).count() == 0


def test_late_rows_over_more_batches_than_spark_reports(spark, tmp_path):
    """120 batches, a late quote in every third: the listener and the count by bar both find all."""
    p = lambda n: str(tmp_path / n)
    start = dt.datetime(2024, 3, 4, 12)
    rows = []
    for k in range(120):
        rows.append(("T", start + dt.timedelta(minutes=30 * k), 10.0, k, k))
        if k % 3 == 2:                                     # a day and more behind: each in a bar of its own
            rows.append(("T", start - dt.timedelta(days=2, minutes=30 * k), 9.0, k, 1000 + k))
    quotes = spark.createDataFrame(rows, "ticker string, ts timestamp, last_price double, total_volume long, seq long"
                                   ).withColumn("session", F.to_date("ts"))
    (tmp_path / "in").mkdir()
    table = quotes.toArrow()
    for k in range(120):                                   # a file per batch, a second apart
        pq.write_table(table.filter(pc.equal(table["total_volume"], k)), p(f"in/{k:03}.parquet"))
        os.utime(p(f"in/{k:03}.parquet"), (1709500000 + k, 1709500000 + k))
    watch = SB.LateRows.watch(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = SB.stream_quote_bars(follow(spark, quotes, p("in"), max_files=1), 1800, counted=True)
        q = SB.run_available(stream, p("out"), p("c"))
        assert len(q.recentProgress) <= 100 < len(watch.by_batch)
        assert watch.total(q) == 40 > SB.late_rows(q)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.streams.removeListener(watch)
    late = SB.late_quotes(quotes, spark.read.parquet(p("out")), 1800).collect()
    assert len(late) == 40 and all(r.n_late == r.n_landed == 1 for r in late)


def test_late_quotes_of_a_bar_that_was_kept(spark):
    """Only the quotes beyond those in the bar are late; bars after the newest one are open."""
    at = lambda m: dt.datetime(2024, 3, 4, 10, m)
    landed = spark.createDataFrame([("T", at(1), 1.0), ("T", at(2), 1.0), ("T", at(3), None), ("T", at(4), 1.0), ("T", at(31), 1.0)],
                                   "ticker string, ts timestamp, last_price double").withColumn("session", F.to_date("ts"))
    bars = landed.limit(1).select("ticker", "session", F.lit(at(0)).alias("bar_ts"), F.lit(1).cast("long").alias("n_quotes"))
    assert [(r.bar_ts.minute, r.n_landed, r.n_late) for r in SB.late_quotes(landed, bars, 1800).collect()] == [(0, 3, 2)]


def test_positions_match_batch_over_splits(spark, bars, tmp_path):
    p = lambda n: str(tmp_path / n)
    rules = T.ExitRules(-2.0, 3.0, 2.5, limit_minutes=90)
    marked = bars.withColumn("signal", (~F.col("is_premarket") & (F.col("close") > F.col("open"))).cast("int"))
    for hours in ((0, 9), (9, 14), (14, 24)):
        part = marked.filter((F.hour("bar_ts") >= hours[0]) & (F.hour("bar_ts") < hours[1]))
        part.coalesce(1).write.mode("append").parquet(p("bars"))
        SB.run_available(ST.stream_positions(follow(spark, marked, p("bars")), rules), p("out"), p("c"))
    entries = marked.filter("signal = 1").select(
        "ticker", "session", F.col("bar_ts").alias("entry_ts"), F.col("close").alias("entry_price"))
    legs = T.exits(entries, bars, "live", rules)
    kept = T.non_overlapping(T.positions(legs)).select("ticker", "session", "entry_ts")
    want = legs.filter("exit_ts is not null").join(kept, ["ticker", "session", "entry_ts"], "left_semi")
    cols = ["ticker", "session", "entry_ts", "leg", "exit_ts"]
    same(want.select(cols), spark.read.parquet(p("out")))


def test_state_goes_when_the_watermark_passes(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    days = [make_bars(spark, [10, 11, 12], day=dt.date(2024, 3, d)).withColumn("signal", F.lit(1)) for d in (4, 6, 8)]
    for df in days:
        df.coalesce(1).write.mode("append").parquet(p("bars"))
        q = SB.run_available(ST.stream_positions(follow(spark, df, p("bars")), T.SPEC, "1 hour"), p("out"), p("c"))
    rows = [x.stateOperators[0].numRowsTotal for x in q.recentProgress if x.stateOperators]
    assert rows[-1] == 1                                     # of three sessions only the newest is held


def test_live_features_match_batch_over_splits(spark, small, tmp_path):
    p = lambda n: str(tmp_path / n)
    fine, fund = A.market(spark, small)
    fine = fine.filter(F.dayofmonth("session") <= 6)
    for cut in ((0, 11), (11, 15), (15, 24)):
        part = fine.filter((F.hour("bar_ts") >= cut[0]) & (F.hour("bar_ts") < cut[1]))
        part.write.mode("append").partitionBy("session").parquet(p("fine"))
        LV.stream_features(follow(spark, fine, p("fine")), p("fine"), p("out"), p("c"), fund, A.COARSE)
    got = SB.read_upserts(spark, p("out"), ["ticker", "session", "bar_ts"])
    same(live_features(fine, fund, A.COARSE).drop("y"), got.drop("y"))
    assert got.filter("pm_high_ratio <> 0 AND pm_low_ratio <> 0").count() > 0


def test_live_premarket_ratios_need_a_range_from_before_the_open(spark):
    """The stored range is used as it is; a session first seen after the open has ratios of 0."""
    early = make_bars(spark, [20.0] * 4 + [22.0] * 20, premarket=4, step=1)
    late = make_bars(spark, [22.0] * 20, ticker="U", step=1)
    fund = spark.createDataFrame([("T", 30.0, 5.0, 1e6), ("U", 30.0, 5.0, 1e6)],
                                 "ticker string, high52 double, low52 double, float_shares double")
    fine = early.unionByName(late)
    ratios = lambda df: {(r.ticker, round(r.pm_high_ratio, 6), round(r.pm_low_ratio, 6)) for r in df.collect()}
    assert ratios(live_features(fine, fund, 60)) == {("T", -0.1, -0.1), ("U", 0.0, 0.0)}
    stored = early.limit(1).select("ticker", "session", F.lit(44.0).alias("pm_high"), F.lit(11.0).alias("pm_low"))
    assert ratios(live_features(fine, fund, 60, stored)) == {("T", 0.5, -1.0), ("U", 0.0, 0.0)}


def test_snapshot_keeps_newest_per_ticker(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    a, b = make_bars(spark, [1, 2, 3]), make_bars(spark, [7], ticker="U")
    c = make_bars(spark, [4], start=615)
    for part in (a.unionByName(b), c):
        part.coalesce(1).write.mode("append").parquet(p("bars"))
        SB.write_snapshot(follow(spark, a, p("bars")), p("out"), p("c"))
    got = {r.ticker: r.close for r in SB.read_snapshot(spark, p("out")).collect()}
    assert got == {"T": 4.0, "U": 7.0}


def test_snapshot_versions_are_bounded_and_survive_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    write = SB.snapshot_batch(path, keep=2, keep_seconds=0)
    level = lambda: [(r.ticker, r.close) for r in SB.read_snapshot(spark, path).collect()]
    batches = [make_bars(spark, [k], start=600 + k) for k in range(1, 8)]
    for n in range(5):
        write(batches[n], n)
        assert level() == [("T", n + 1.0)]
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.is_dir()) == ["version=3", "version=4"]

    def crash(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:                       # the version is whole, the pointer has not moved
        m.setattr(SB, "put_text", crash)
        with pytest.raises(OSError):
            write(batches[5], 5)
    assert level() == [("T", 5.0)]
    write(batches[5], 5)
    assert level() == [("T", 6.0)]
    write(batches[5], 5)                                   # replayed after the move
    write(batches[0], 4)
    assert level() == [("T", 6.0)]
    kept = SB.snapshot_batch(path, keep=1, keep_seconds=3600)
    kept(batches[6], 6)                                    # a version younger than an hour stays for its readers
    assert level() == [("T", 7.0)]
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.is_dir()) == ["version=4", "version=5", "version=6"]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write = SB.upsert_batch(path)
    df = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    write(df, 0)
    write(df.withColumn("v", F.col("v") + 10).filter("k = 'A'"), 1)
    write(df.withColumn("v", F.col("v") + 10).filter("k = 'A'"), 1)
    got = SB.read_upserts(spark, path, ["k"]).orderBy("k").collect()
    assert [(r.k, r.v) for r in got] == [("A", 11), ("B", 2)]


def test_fill_by_timer_over_splits(spark, tmp_path):
    """Empty slots are carried when the watermark passes them, before any later bar of the ticker."""
    p = lambda n: str(tmp_path / n)
    def quoted(closes, start, ticker="T"):
        return make_bars(spark, closes, ticker=ticker, start=start).withColumns(
            {"total_open": F.lit(100).cast("long"), "total_close": F.floor(F.unix_seconds("bar_ts") % 86400 / 60)})
    def run(part):
        part.coalesce(1).write.mode("append").parquet(p("bars"))
        SB.run_available(ST.stream_fill(follow(spark, part, p("bars")), 300, close_minute=720), p("out"), p("c"))
        rows = spark.read.parquet(p("out")).filter("ticker = 'T'").orderBy("bar_ts").collect()
        return [((r.bar_ts.hour * 60 + r.bar_ts.minute), r.close, r.volume, r.is_filled) for r in rows]
    first = [(600, 10.0, 500, False), (605, 11.0, 5, False)]
    assert run(quoted([10, 11], 600)) == first
    carried = [(m, 11.0, 0, True) for m in (610, 615, 620)]
    assert run(quoted([5], 625, "U")) == first + carried
    after = [(630, 12.0, 25, False)]
    between = [(625, 11.0, 0, True)]
    assert run(quoted([12], 630)) == first + carried + between + after
    rest = [(m, 12.0, 0, True) for m in range(635, 720, 5)]
    assert run(quoted([5], 800, "U")) == first + carried + between + after + rest


def test_watchlist_scores_members_only_and_follows_the_scan(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    day = make_bars(spark, [20 + k for k in range(40)], start=560).unionByName(make_bars(spark, [5.0] * 40, ticker="U", start=560))
    prior = spark.createDataFrame([("T", 15.0, 10.0), ("U", 4.0, 10.0)], "ticker string, prev_close double, mean_pm_volume double")
    prior = prior.withColumn("session", F.lit("2024-03-04").cast("date"))
    facts = spark.createDataFrame([("T", 7.0)], "ticker string, float_shares double")
    scan = LV.scan_batch(p("w"), prior, (25.0, 50.0), 50, (1.0, 30.0), 3.0)
    found = lambda rows: spark.createDataFrame(rows, "ticker string, pm_volume long, price double").withColumn(
        "session", F.lit("2024-03-04").cast("date"))
    scan(found([("T", 60, 20.0), ("U", 60, 4.1)]), 0)
    day.write.partitionBy("session").parquet(p("bars"))
    score = LV.score_batch(p("bars"), p("w"), facts, 3.0)
    score(day, 0)
    got = LV.watchlist(spark, p("w")).collect()
    assert [(r.ticker, r["rank"], r.float_shares, r.rvol) for r in got] == [("T", 1, 7.0, 6.0)]
    assert got[0].bar_ts == day.agg(F.max("bar_ts")).first()[0] and got[0].entry_price <= 59.0
    scan(found([("U", 90, 5.5), ("T", 70, 40.0)]), 1)              # T is withdrawn, U joins
    assert LV.watchlist(spark, p("w")).count() == 0
    score(day, 1)
    score(day, 1)                                                   # a replayed batch changes nothing
    assert [(r.ticker, r.score > 0) for r in LV.watchlist(spark, p("w")).collect()] == [("U", True)]
