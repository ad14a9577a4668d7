"""Split frames, sliding extremes, bounded lookups and interval totals, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, extremes, halo, intervals, outcomes, windows

HR = 3_600_000


def history(n, seed, symbols="AAB"):
    """(symbol, ts_ms, v): gaps, ties of values, one symbol of two thirds of the rows."""
    rng = random.Random(seed)
    at = dict.fromkeys(symbols, 0)
    out = []
    for _ in range(n):
        s = rng.choice(symbols)
        at[s] += rng.choice([1, 1, 1, 2, 5, 40])
        out.append((s, at[s] * HR, rng.choice([float(rng.randrange(5)), rng.random() * 100, None])))
    return out


@pytest.fixture(scope="module")
def data(spark):
    found = history(400, 2)
    return found, spark.createDataFrame(found, "symbol string, ts_ms long, v double").repartition(3).cache()


def by_symbol(found):
    return {s: sorted((r for r in found if r[0] == s), key=lambda r: r[1]) for s in {r[0] for r in found}}


@pytest.mark.parametrize("part", [7, 31, 10_000])
def test_split_frames_equal_whole_ones(data, part):
    found, df = data
    own = halo.split(df, 5, part_rows=part)
    got = halo.joined(own.withColumn("m", F.sum("v").over(halo.of_part().rowsBetween(-5, 0))))
    assert got.columns == ["symbol", "ts_ms", "v", "m"] and own.select("_part").distinct().count() >= 200 // part
    want = {(s, r[1]): sum(x[2] or 0 for x in mine[max(0, i - 5) : i + 1]) for s, mine in by_symbol(found).items() for i, r in enumerate(mine)}
    assert {(r["symbol"], r["ts_ms"]): round(r["m"] or 0, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert not halo.joined(halo.split(df.limit(0), 5)).collect()


@pytest.mark.parametrize("span, n, part", [(50, 239, 20), (7, 51, 10_000), (2, 11, 3), (1, 5, 4), (9, 1, 5)])
def test_framed_averages_equal_folds(data, monkeypatch, span, n, part):
    found, df = data
    monkeypatch.setattr(halo, "PART_ROWS", part)
    got = {(r["symbol"], r["ts_ms"]): r["e"] for r in halo.with_framed_ema(df.where("v IS NOT NULL"), "v", span, n, "e").collect()}
    for s, mine in by_symbol([r for r in found if r[2] is not None]).items():
        for i, r in enumerate(mine):
            frame = [x[2] for x in mine[max(0, i - n + 1) : i + 1]]
            e = frame[0]
            for x in frame[1:]:
                e += (x - e) * 2 / (span + 1)
            assert abs(got[s, r[1]] - e) < 1e-9 * max(1, abs(e))


@pytest.mark.parametrize("n, part", [(1, 3), (10, 4), (10, 25), (100, 10_000)])
def test_cusums_equal_folds(data, n, part):
    found, df = data
    got = {(r["symbol"], r["ts_ms"]): r["c"] for r in halo.with_cusum(df, "v", 20.0, n, "c", part_rows=part).collect()}
    for s, mine in by_symbol(found).items():
        for i, r in enumerate(mine):
            c = 0.0
            for x in mine[max(0, i - n + 1) : i + 1]:
                c = c if x[2] is None else max(0.0, c + x[2] - 20.0)
            assert abs(got[s, r[1]] - c) < 1e-8


@pytest.mark.parametrize("lo, hi", [(0, 0), (-HR, -HR), (HR, 24 * HR), (-30 * HR, -1), (0, 2160 * HR - 1), (-3 * HR, 5 * HR)])
def test_sliding_aggregates_equal_brute_force(data, lo, hi):
    found, df = data
    facts = {"top": (F.max, F.when(F.col("v").isNotNull(), F.struct("v", (-F.col("ts_ms")).alias("t")))), "low": (F.min, F.col("v")), "n": (F.sum, F.lit(1).cast("long")), "total": (F.sum, F.col("v"))}
    some = df.unionByName(df.limit(3)).unionByName(df.limit(1).withColumn("ts_ms", F.lit(None).cast("long")))
    out = extremes.over_range(df, lo, hi, facts, points=some).collect()
    assert len(out) == 404
    for r in out:
        inside = [x for x in found if r["ts_ms"] is not None and x[0] == r["symbol"] and r["ts_ms"] + lo <= x[1] <= r["ts_ms"] + hi]
        values = [(x[2], -x[1]) for x in inside if x[2] is not None]
        assert (r["n"] or 0) == len(inside) and r["low"] == min((v for v, _ in values), default=None)
        assert (tuple(r["top"]) if r["top"] else None) == max(values, default=None)
        assert abs((r["total"] or 0) - sum(v for v, _ in values)) < 1e-6


def test_extremes_look_at_no_frame_of_the_window(data):
    _, df = data
    plan = windows.with_future_extreme(df, "v", 2160)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan and "unboundedpreceding" in plan.lower()
    tie = df.sparkSession.createDataFrame([("A", 0, 1.0), ("A", HR, 9.0), ("A", 2 * HR, 9.0)], "symbol string, ts_ms long, high double")
    assert [r["top_ms"] for r in windows.with_future_extreme(tie, "high", 24).orderBy("ts_ms").collect()] == [2 * HR, 2 * HR, None]
    bars = tie.select("*", F.col("high").alias("open"), F.col("high").alias("low"), F.col("high").alias("close"))
    assert outcomes.path_aggregates(bars, 24).orderBy("ts_ms").first()["f_first_high_ms"] == HR


@pytest.mark.parametrize("rows, least", [(200, 25), (10, 3), (1, 1), (25, 0)])
def test_bounded_changes_equal_a_reader_of_the_last_rows(data, rows, least):
    found, df = data
    got = {(r["symbol"], r["ts_ms"]): r.asDict() for r in asof.bounded_changes(df, "v", rows, least).collect()}
    for s, mine in by_symbol(found).items():
        for i, r in enumerate(mine):
            valid = [x for x in mine[max(0, i - rows + 1) : i + 1] if x[2] is not None and x[2] > 0]
            last = valid[-1] if valid and len(valid) >= least else None
            row = got[s, r[1]]
            assert row["n_valid"] == len(valid) and row["adopted_ms"] == (last and last[1]) and row["adopted"] == (last and last[2])
            ever = [k for k, x in enumerate(mine[: i + 1]) if x[2] is not None and x[2] > 0]
            assert row["stale"] == i - (ever[-1] if ever else -1)
            for h in (24, 72):
                base = [x for x in valid if last and x[1] <= last[1] - h * HR]
                want = last[2] / base[-1][2] - 1 if base else None
                assert row[f"chg_{h}"] == want or abs(row[f"chg_{h}"] - want) < 1e-12


# ---- intervals
def test_coverage_reminders_and_recall_equal_brute_force(spark, data):
    found, df = data
    chosen = df.where("v > 30")
    picks = [r for r in found if r[2] is not None and r[2] > 30]
    spans = [(s, t, t + 6 * HR) for s, t, _ in found[::5]] + [("C", 0, HR), found[0][:2] + (found[0][1],), found[0][:2] + (found[0][1],)]
    events = spark.createDataFrame(spans, "symbol string, t0 long, t1 long")
    out = intervals.reverse_coverage(events, chosen, 24 * HR, 48 * HR).collect()
    assert len(out) == len(spans)
    for r in out:
        count = lambda a, b: sum(x[0] == r["symbol"] and a <= x[1] <= b for x in picks)
        want = count(r["t0"] - 24 * HR, r["t0"] - 1), count(r["t0"], r["t1"]), count(r["t1"] + 1, r["t1"] + 48 * HR)
        assert (r["pre"], r["mid"], r["late"]) == want
        assert r["disposition"] == ("before" if want[0] else "during" if want[1] else "late" if want[2] else "missed")
    for r in intervals.reminders(events, chosen, 12 * HR).collect():
        assert r["reminders"] == sum(x[0] == r["symbol"] and r["t0"] - 12 * HR < x[1] <= r["t0"] for x in picks)
    ranked = df.where("v IS NOT NULL").withColumn("rk", F.col("v").cast("int"))
    best = intervals.best_before(events.select("symbol", F.col("t0").alias("ts_ms")), ranked, 24 * HR).collect()
    for r in best:
        mine = [(x[1], int(x[2])) for x in found if x[0] == r["symbol"] and x[2] is not None]
        assert r["best"] == min((k for t, k in mine if r["ts_ms"] - 24 * HR <= t < r["ts_ms"]), default=None)
        assert r["at_start"] == next((k for t, k in mine if t == r["ts_ms"] - HR), None)
    assert not intervals.reminders(events.limit(0), chosen, HR).collect() and {r["reminders"] for r in intervals.reminders(events, chosen.limit(0), HR).collect()} == {0}


def test_tradability_of_an_events_hours(spark):
    bars = spark.createDataFrame([("A", i * HR, h, l, v) for i, (h, l, v) in enumerate([(10.0, 9.0, 1.0), (12.0, 10.0, 3.0), (21.0, 11.0, 4.0), (30.0, 8.0, 0.0)])], "symbol string, ts_ms long, high double, low double, volume double")
    events = spark.createDataFrame([("A", 0, 10.0), ("B", 0, 10.0)], "symbol string, t0 long, p0 double")
    got = intervals.tradability(events, bars, 2).collect()
    assert [tuple(r) for r in got] == [("A", 0, 10.0, 3, 2, 0.5, 2.0)]
