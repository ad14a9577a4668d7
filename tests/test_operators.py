"""Operators against hand-computed cases and plain Python."""

import datetime
import gzip
import json
import math
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import asof, events, models, outcomes, scoring, stats, windows
from tidemark.sources import readers, sinks
from tidemark.streaming import streams

HR = 3_600_000


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def candles(spark, closes, edits=None, hours=None, symbol="A"):
    """Flat candles at the closes; edits: {row: {column: value}}."""
    data = []
    for i, c in enumerate(closes):
        row = {"symbol": symbol, "ts_ms": (hours[i] if hours else i) * HR, "open": float(c), "high": float(c), "low": float(c), "close": float(c), "volume": 1.0} | (edits or {}).get(i, {})
        data.append(tuple(row.values()))
    return spark.createDataFrame(data, "symbol string, ts_ms long, open double, high double, low double, close double, volume double")


def test_epochs(spark):
    cells = ["1730160000", "1730160000000", "1730160000000000", "2024-10-29 00:00:00", "", None, "abc", "NaN", "0", "-1", "1e18", "2024-10-29"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    got = [r["ms"] for r in rows(df.select("i", fn.normalize_epoch("c").alias("ms")), "i")]
    assert got == [1730160000000] * 4 + [None] * 7 + [1730160000000]


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1.5e9, "Banned until 1700000000000", "abcd", "abxy"), (999.0, "Retry-After: 3", "abcd", "abcd")], "x double, m string, a string, b string")
    got = rows(df.select(fn.human_money("x").alias("h"), fn.ban_until_ms("m", F.lit(1000).cast("long")).alias("u"), fn.bigram_overlap("a", "b").alias("o"), fn.safe_segment(F.lit("a/b c")).alias("s")))
    assert [tuple(r.values()) for r in got] == [("1.5B", 1700000000000, 1 / 3, "a_b_c"), ("999", 4000, 1.0, "a_b_c")]
    odd = spark.createDataFrame([("x",), ("inf",), ("2.5",), (None,)], "v string")
    assert [r["v"] for r in rows(odd.select(fn.safe_float("v").alias("v")))] == [0.0, 0.0, 2.5, 0.0]


def test_indicators_equal_pandas(spark):
    rng = random.Random(1)
    closes = [100.0]
    for _ in range(300):
        closes.append(closes[-1] * (1 + rng.uniform(-0.02, 0.02)))
    df = candles(spark, closes)
    got = pd.DataFrame(rows(windows.indicators(df), "ts_ms"))
    c = pd.Series(closes)
    assert (got["box_high"].dropna().values == c.shift().rolling(24).max().dropna().values).all()
    assert got["box_high"].isna().sum() == 24 and got["prev24"].isna().sum() == 47
    ema = c.iloc[-239:].ewm(span=50, adjust=False).mean().iloc[-1]
    assert math.isclose(got["ema"].iloc[-1], ema, rel_tol=1e-12)
    w = Window.partitionBy("symbol").orderBy("ts_ms").rowsBetween(-47, 0)
    k = pd.DataFrame(rows(df.select("ts_ms", windows.sample_skew("close", w).alias("s"), windows.sample_kurtosis("close", w).alias("k")), "ts_ms"))
    assert math.isclose(k["s"].iloc[-1], c.rolling(48).skew().iloc[-1], rel_tol=1e-6) and math.isclose(k["k"].iloc[-1], c.rolling(48).kurt().iloc[-1], rel_tol=1e-6)


def test_no_feature_reads_the_future(spark):
    closes = [100 + (i * 7) % 13 for i in range(120)]
    before = rows(windows.indicators(candles(spark, closes)).where(f"ts_ms <= {80 * HR}"), "ts_ms")
    after = rows(windows.indicators(candles(spark, closes[:81] + [999] * 39)).where(f"ts_ms <= {80 * HR}"), "ts_ms")
    assert before == after


def test_run_length_and_equal_count_bins(spark):
    df = spark.createDataFrame([("a", i, bool(b)) for i, b in enumerate([1, 1, 0, 1, 1, 1, 0])], "symbol string, ts_ms long, ok boolean")
    assert [r["n"] for r in rows(windows.with_run_length(df, F.col("ok"), "n"), "ts_ms")] == [1, 2, 0, 1, 2, 3, 0]
    for n, q in ((8, 3), (11, 5), (103, 5), (24, 3), (23, 3)):
        xs = spark.createDataFrame([(1, i, float((i * 37) % n)) for i in range(n)], "g int, i int, x double")
        got = [r["b"] for r in rows(xs.withColumn("b", windows.equal_count_bin("x", q, ["g"], "i")), "x", "i")]
        assert got == pd.qcut(pd.Series(range(n)), q, labels=False).tolist()


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    obs = sorted({rng.randrange(1000) for _ in range(60)})
    dec = [rng.randrange(-20, 1020) for _ in range(80)]
    o = spark.createDataFrame([("A", t, float(t)) for t in obs], "symbol string, ts_ms long, v double")
    q = spark.createDataFrame([("A", t, i) for i, t in enumerate(dec)] + [("B", 5, 99)], "symbol string, ts_ms long, i int")
    for lag in (0, 30):
        got = {r["i"]: r["v"] for r in rows(asof.backward(q, o, ["v"], lag_ms=lag))}
        assert got == {**{i: max((float(x) for x in obs if x <= t - lag), default=None) for i, t in enumerate(dec)}, 99: None}
    got = {r["i"]: r["v"] for r in rows(asof.forward(q, o, ["v"]))}
    assert got == {**{i: min((float(x) for x in obs if x >= t), default=None) for i, t in enumerate(dec)}, 99: None}


def test_bounded_changes_need_25_valid_observations(spark):
    def last(values, n=200):
        df = spark.createDataFrame([("A", i * HR, v) for i, v in enumerate(values)], "symbol string, ts_ms long, value double")
        return rows(asof.bounded_changes(df, "value", n), "ts_ms")[-1]

    assert last([100.0] * 24)["adopted"] is None and last([100.0] * 25)["adopted"] == 100.0
    full = last([100.0] * 80 + [150.0])
    assert full["chg_24"] == 0.5 and full["chg_72"] == 0.5 and full["stale"] == 0
    tail = last([100.0] * 80 + [None, 0.0, float("nan")])
    assert tail["adopted_ms"] == 79 * HR and tail["stale"] == 3
    assert last([100.0] * 100 + [None] * 200) | {"ts_ms": 0, "stale": 0} == {"symbol": "A", "ts_ms": 0, "value": None, "n_valid": 0, "adopted_ms": None, "adopted": None, "chg_24": None, "chg_72": None, "stale": 0}


def test_derivative_points_live_and_strict(spark):
    df = spark.createDataFrame([(0.10, 0.20, 0.99), (0.10, None, 0.5), (None, None, None), (0.3, 0.3, 1.0)], "chg_24 double, chg_72 double, ls double")
    live = [(r["score_deriv"], r["deriv_status"]) for r in rows(scoring.derivative_score(df, "ls"))]
    assert live == [(10, "ok"), (7, "partial"), (0, "failed"), (7, "ok")]
    assert [r["score_deriv"] for r in rows(scoring.derivative_score(df, "ls", strict=True))] == [3, None, None, 7]


def test_veto_and_ranks(spark):
    df = spark.createDataFrame([(3.2, 1.0), (3.21, 1.0), (None, 1.0), (1.0, 0.0), (1.0, -1.0), (1.0, float("nan"))], "oi double, spot double")
    assert [r["veto"] for r in rows(scoring.leverage_veto(df, "oi", "spot"))] == [False, True, False, False, False, False]
    s = spark.createDataFrame([("a", 0), ("b", None), ("c", 0)], "symbol string, score int")
    assert [r["rk"] for r in rows(scoring.ranked(s), "symbol")] == [1, None, 2]


def test_waves_merge_at_48_hours_and_split_at_49(spark):
    for gap, n in ((48, 1), (49, 2)):
        closes = [100.0] * 300
        edits = {50: {"high": 250.0}, 50 + gap: {"high": 250.0}}
        assert len(rows(events.waves(candles(spark, closes, edits), 1, 2.0))) == n
    wave = rows(events.waves(candles(spark, [100.0] * 200, {150: {"high": 250.0}}), 24, 2.0))[0]
    assert wave["peak_ms"] == 150 * HR and wave["n_bars"] == 24 and wave["gain"] == 2.5 and wave["tier"] == 2.5


def test_forward_outcomes(spark):
    flat = candles(spark, [100.0] * 100, {10: {"high": 250.0}})
    q = spark.createDataFrame([("A", 0), ("A", 20 * HR), ("A", 95 * HR), ("A", 200 * HR), ("B", 0)], "symbol string, ts_ms long")
    got = {(r["symbol"], r["ts_ms"] // HR): r for r in rows(outcomes.forward(q, flat, 48))}
    assert got["A", 0]["touch"] == 2.5 and got["A", 0]["verdict"] == "reach" and got["A", 0]["peak_ms"] == 10 * HR
    assert got["A", 20]["verdict"] == "no_reach" and got["A", 95]["state"] == "partial_tail" and got["A", 95]["verdict"] == "undetermined"
    assert got["A", 200]["state"] == got["B", 0]["state"] == "no_reference"
    early = outcomes.forward(spark.createDataFrame([("A", 0)], "symbol string, ts_ms long"), candles(spark, [100, 210]), 48)
    assert rows(early)[0]["verdict"] == "reach"
    holes = candles(spark, [100.0] * 99, hours=[*range(50), *range(51, 100)])
    state = {r["hour_idx"]: r["state"] for r in rows(outcomes.labels(holes, 24))}
    assert state[0] == "no_reference" and state[30] == "gap" and state[90] == "partial_tail" and state[52] == "complete" and state[51] == "no_reference"


def test_greedy_pumps_do_not_overlap(spark):
    closes = [10.0] * 80 + [10.0 * 1.06**i for i in range(60)] + [300.0] * 30
    data = [("A", datetime.date(2024, 1, 1) + datetime.timedelta(days=i), c, c, c) for i, c in enumerate(closes)]
    df = spark.createDataFrame(data, "symbol string, day date, close double, high double, low double")
    got = rows(events.greedy_pumps(df), "i")
    assert got and all(b["i"] - a["i"] >= 20 for a, b in zip(got, got[1:])) and all(r["gain"] >= 1 for r in got)


def test_statistics_equal_plain_python(spark):
    rng = random.Random(3)
    data = [(i, float(rng.randrange(12)), rng.random(), rng.randrange(2)) for i in range(80)]
    df = spark.createDataFrame(data, "i int, s double, z double, y int").withColumn("g", F.lit(1))
    pos, neg = [s for _, s, _, y in data if y], [s for _, s, _, y in data if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(rows(stats.auc(df, "s", "y", ["g"]))[0]["auc"], want)
    assert rows(stats.auc(df.where("i < 20"), "s", "y", ["g"]))[0]["auc"] is None
    pdf = pd.DataFrame(data, columns=list("iszy"))
    assert math.isclose(rows(stats.spearman(df, "s", "z", ["g"]))[0]["ic"], pdf["s"].rank().corr(pdf["z"].rank()))
    assert rows(stats.spearman(df.withColumn("c", F.lit(1.0)), "s", "c", ["g"]))[0]["ic"] is None
    left = rows(stats.residual(df, "z", ["s"], "res").agg(F.corr("res", "s").alias("c")))[0]["c"]
    assert abs(left) < 1e-9


def test_models(spark):
    rng = random.Random(4)
    data = [(i, x := rng.gauss(0, 1), None if i % 3 else 1.0, int(x + rng.gauss(0, 0.5) > 0)) for i in range(200)]
    df = spark.createDataFrame(data, "i int, a double, sparse double, y int")
    train, test, kept = models.prepared(df.where("i % 2 = 0"), df.where("i % 2 = 1"), ["a", "sparse"])
    assert kept == ["a"] and models.features(["a", "label", "fwd_7d", "ret_after_3"]) == ["a"]
    scored = models.probabilities(models.logistic(train, "y"), test).withColumn("g", F.lit(1))
    assert rows(stats.auc(scored, "p", "y", ["g"]))[0]["auc"] > 0.85 and rows(models.gain_bits(scored, "p", "y"))[0]["bits"] > 0.2


def test_zip_klines_and_text_sources(spark, tmp_path):
    def line(ms, close):
        return f"{ms},1,2,0.5,{close},10,{ms + 3599999},20,5,3,6,0"

    with zipfile.ZipFile(tmp_path / "BTCUSDT-1h-2024-01.zip", "w") as z:
        z.writestr("a.csv", "\n".join(["open_time,open,high,low,close,volume,close_time,q,n,tb,tq,i", line(1704067200000, 1), line(1704067200000000, 9), line(1704070800000, "x"), "short,line", line("bad", 3) if False else "bad,1,2,3,4,5,6,7,8,9,10,11"]))
    raw = readers.zip_lines(spark, str(tmp_path))
    got = rows(readers.klines(raw).select("symbol", "ts_ms", "close"), "ts_ms")
    assert got == [{"symbol": "BTCUSDT", "ts_ms": 1704067200000, "close": 1.0}, {"symbol": "BTCUSDT", "ts_ms": 1704070800000, "close": None}]
    assert readers.klines(raw, dedupe=False).count() == 3
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.csv").write_text("create_time,symbol,a,b,c,d,e,f\n2024-01-01 00:00:00,X,1,1,1,1,1,1\n2024-01-01 00:00:00,X,2,1,1,1,1,1\n2024-01-01 00:05:00,X,3,1,1,1,1,1\n")
    m = readers.metrics(spark, str(tmp_path / "m"))
    assert [r["sum_open_interest"] for r in rows(m, "ts_ms")] == [2.0, 3.0] and readers.hourly(m).count() == 1
    with gzip.open(tmp_path / "lane.jsonl.gz", "wt") as f:
        f.write(json.dumps({"symbol": "X", "ts_ms": 1}) + "\n{broken\n")
    lane = readers.json_lines(spark, str(tmp_path / "lane.jsonl.gz"), "symbol string, ts_ms long, _corrupt_record string").cache()
    assert lane.where("symbol IS NOT NULL").count() == 1 and lane.where("_corrupt_record IS NOT NULL").count() == 1
    state = readers.verified(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, actual string"), spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "4")], "name string, sha256 string"))
    assert {r["name"]: r["state"] for r in rows(state)} == {"a": "done", "b": "bad", "c": "needs_verify", "d": "missing"}


def test_sinks(spark, tmp_path):
    df = candles(spark, [1, 2, 3])
    sinks.write_bars(df, str(tmp_path / "bars"))
    sinks.write_bars(df.limit(1), str(tmp_path / "bars"))
    assert readers.bars(spark, str(tmp_path / "bars"), ["A"], "1970-01").count() == 1
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    both = sinks.flattened(spark.createDataFrame([(1, [2])], "a int, b array<int>"), spark.createDataFrame([(3, 4)], "a int, c int"))
    assert both.columns == ["a", "b", "c"] and rows(both, "a")[0]["b"] == "[2]"
    made = []
    for _ in range(2):
        sinks.reused(spark, str(tmp_path / "r"), {"v": 1}, lambda: made.append(1) or df)
    assert len(made) == 1 and sinks.fingerprint({"a": 1, "b": 2}) == sinks.fingerprint({"b": 2, "a": 1})
    table = sinks.text_table(spark.createDataFrame([("日本", float("nan")), ("a", 1.0)], "k string, v double"), 50, markdown=True)
    assert "| 日本 | —" in table and sinks.width("日本a") == 5


def test_streams(spark, tmp_path):
    data = [("A", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=7 * i), i, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp, event_id long, value double")
    df.union(df.limit(5)).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert streams.to_end(streams.deduplicated(stream()), str(tmp_path / "o1")).count() == 60
    got = rows(streams.to_end(streams.bars(stream(), late="1 day"), str(tmp_path / "o2"), "complete"), "start")
    assert len(got) == 7 and sum(r["trades"] for r in got) == 65
    ban = spark.createDataFrame([("x", 0, "ban", 100), ("x", 10, "ban", 50), ("x", 60, "ok", 0), ("x", 120, "fail", 0), ("y", 0, "ban", 5), ("y", 9, "ok", 0)], "domain string, at_ms long, kind string, until_ms long")
    ban.write.parquet(str(tmp_path / "ban"))
    end = streams.to_end(streams.pauses(spark.readStream.schema(ban.schema).parquet(str(tmp_path / "ban")), 1000), str(tmp_path / "o3"), "update")
    assert {r["domain"]: (r["until_ms"], r["state"]) for r in rows(end)} == {"x": (1120, "paused"), "y": (0, "open")}


@pytest.mark.parametrize("name", ["c03_box_score_rank", "j07_asof_backward", "d02_waves", "g05_quantiles", "w17_skew_kurt", "f20_precision_at_n"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import registry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r[c] for c in columns) for r in registry.queries()[name](spark, d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rolling_spearman_at_every_bar(spark):
    rng = random.Random(12)
    data = [(s, i, None if rng.random() < 0.03 else float(rng.randrange(40)), 1.0 if s == "C" else rng.random()) for s, n in (("A", 400), ("B", 170), ("C", 169), ("D", 100)) for i in range(n)]
    df = spark.createDataFrame(data, "symbol string, ts_ms long, close double, volume double")
    got = {(r["symbol"], r["ts_ms"]): r["rho"] for r in rows(stats.rolling_spearman(df, "close", "volume", ["symbol"], "ts_ms", 168, "rho"))}
    assert len(got) == 233 + 3 + 2
    for (s, t), rho in got.items():
        part = pd.DataFrame([x[2:] for x in data if x[0] == s and t - 168 < x[1] <= t]).astype(float).dropna()
        want = part[0].rank().corr(part[1].rank()) if s != "C" else None
        assert rho is None if want is None else math.isclose(rho, want, abs_tol=1e-9)


def test_w20_gives_every_bar_with_a_full_window(spark):
    from tidemark.plans import engine
    from tidemark.plans.domain import domain

    d = "/root/testdata/sf0.001"
    bars = domain(spark, d, "bars").groupBy("symbol").count().collect()
    assert engine.w20_rolling_spearman_168(spark, d).count() == sum(max(0, b["count"] - 167) for b in bars) > 0


def test_observations_of_one_time_have_a_set_order(spark):
    obs = spark.createDataFrame([("a", 5, 2.0), ("a", 5, 3.0), ("a", 5, None), ("a", 9, 1.0)], "symbol string, ts_ms long, value double")
    points = spark.createDataFrame([("a", 7), ("a", 5), ("a", 1), ("b", 7)], "symbol string, ts_ms long")
    for parts in (1, 3):
        got = {(r["symbol"], r["ts_ms"]): r["value"] for r in rows(asof.backward(points, obs.repartition(parts), ["value"]))}
        assert got == {("a", 7): 3.0, ("a", 5): 3.0, ("a", 1): None, ("b", 7): None}
        got = {(r["symbol"], r["ts_ms"]): r["value"] for r in rows(asof.forward(points, obs.repartition(parts), ["value"]))}
        assert got == {("a", 7): 1.0, ("a", 5): 3.0, ("a", 1): 3.0, ("b", 7): None}


def test_damaged_archives_give_no_lines(spark):
    files = spark.createDataFrame([("x/AUSDT-1h-2024-01.zip", ",".join("1" * 12))], "path string, body string")
    good = readers.zipped(files)
    body = good.first()["content"]
    odd = spark.createDataFrame([("bad.zip", bytearray(b"no archive")), ("short.zip", bytearray(body[:-30])), ("void.zip", None), ("flipped.zip", bytearray(body[:40] + bytes([body[40] ^ 255]) + body[41:]))], "path string, content binary")
    assert [r["path"] for r in rows(readers.archive_lines(good.union(odd)))] == ["x/AUSDT-1h-2024-01.zip"]


def test_metrics_are_read_with_and_without_a_header(spark, tmp_path):
    names = readers.METRICS.fieldNames()
    line = lambda t: ",".join({"create_time": t, "symbol": "A"}.get(n, "1.5") for n in names)
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + line("2024-01-01 00:00:00") + "\n")
    (tmp_path / "b.csv").write_text(line("2024-01-01 00:05:00") + "\n" + line("2024-01-01 00:10:00") + "\n")
    assert readers.metrics(spark, str(tmp_path)).count() == 3


def test_pumps_need_a_trough_before_the_peak_and_an_ignition(spark):
    def daily(symbol, close, low=None):
        start = datetime.date(2024, 1, 1)
        return [(symbol, start + datetime.timedelta(i), c, c, (low or {}).get(i, c)) for i, c in enumerate(close)]

    calm = [1.0] * 100
    pump = calm[:75] + [1.2, 1.6, 2.4] + [1.0] * 22
    data = daily("plain", pump) + daily("own", pump, {77: 0.5})  # the second one's trough is its peak's own row
    df = spark.createDataFrame(data, "symbol string, day date, close double, high double, low double")
    got = [(r["symbol"], r["i"], str(r["ignite"])) for r in rows(events.greedy_pumps(df))]
    assert got == [("plain", 77, "2024-03-16")]


def test_granularity_fallback_with_prices_of_zero(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import registry

    prices = {1: [0.0, 3.0], 2: [0.0, 0.0], 3: [2.0, 0.0], 4: [0.0], 5: [3.2, 41.51], 6: [None, None], 7: [5.0]}  # 41.51 / 3.2 lies at a half
    data = [(10 * u + i, datetime.datetime(2024, 1, 1, 0, i), u, "view", v, "{}") for u, values in prices.items() for i, v in enumerate(values)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["e02_granularity_fallback"]).fetchall()
    got = [tuple(r) for r in registry.queries()["e02_granularity_fallback"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 7
    assert {r[0]: str(r[3]) for r in got} == {1: "inf", 2: "nan", 3: "1.0", 4: "nan", 5: str(want[[w[0] for w in want].index(5)][3]), 6: "None", 7: "1.0"}


def test_stale_tail_follows_the_full_time(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import registry

    # Three in one millisecond, the valid one in the middle; then one alone.
    data = [(1, 100, 9.0), (2, 5_100, 7.0), (3, 5_200, 50.0), (4, 5_300, 1.0), (5, 9_000, 2.0), (6, 9_001, None)]
    start = datetime.datetime(2024, 1, 1)
    events_ = [(i, start + datetime.timedelta(microseconds=t), 3 + 20 * i, "purchase", v if t != 5_100 else 0.5, "{}") for i, t, v in data]
    spark.createDataFrame(events_, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["c09_stale_tail"]).fetchall()
    got = [tuple(r) for r in registry.queries()["c09_stale_tail"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sorted(r[2] for r in got) == [-1, 0, 0, 1, 2, 3]


def _events_table(spark, path, data):
    """data: event_id, microseconds, user_id, event_type, value."""
    began = datetime.datetime(2024, 1, 1)
    made = [(i, None if us is None else began + datetime.timedelta(microseconds=us), u, kind, v, "{}") for i, us, u, kind, v in data]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(path / "events.parquet"))
    return str(path)


def test_derivative_score_takes_the_last_of_one_time_not_the_greatest_change(spark, tmp_path):
    from tidemark.plans import engine

    hour = 3_600_000_000
    data = [(0, 0, 0, "purchase", 10.0)] + [(i, 100 * hour + i * 1_000_000, 0, "purchase", 10.0) for i in range(1, 199)]
    # The base is among the last 200 of the first of these two, not of the second.
    data += [(199, 110 * hour, 0, "purchase", 20.0), (200, 110 * hour + 100, 0, "purchase", 20.0)]
    data += [(300, 110 * hour + 10, 0, "signup", 90.0), (301, 110 * hour + 20, 0, "signup", 10.0)]  # ratios 1.8, then 0.2
    data += [(400, 111 * hour, 0, "error", 1.0)]
    got = rows(engine.c04_derivative_score(spark, _events_table(spark, tmp_path, data)))
    assert [(r["score_deriv"], r["deriv_status"]) for r in got] == [(3, "partial")]


def test_changes_of_one_time_count_by_place(spark):
    q = spark.createDataFrame([("A", 7)], "symbol string, ts_ms long")
    o = spark.createDataFrame([("A", 5, 1, 0.9), ("A", 5, 2, 0.1), ("A", 5, 0, None)], "symbol string, ts_ms long, place long, chg double")
    for parts in (1, 3):
        assert [r["chg"] for r in rows(asof.backward(q, o.repartition(parts), ["chg"], order=["place"]))] == [0.1]
    repeated = [("A", i * HR, 100.0) for i in range(30)] + [("A", 60 * HR, 150.0)] * 2 + [("A", 61 * HR, 100.0)]
    df = spark.createDataFrame(repeated, "symbol string, ts_ms long, value double")
    assert [r["place"] for r in rows(asof.bounded_changes(df, "value", 200, place="place"), "place")] == list(range(1, 34))


def test_granularity_fallback_opens_at_the_first_known_price(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import registry

    prices = {1: [None, 4.0, 8.0], 2: [5.0, None], 3: [None, 2.0], 4: [None, None]}
    d = _events_table(spark, tmp_path, [(10 * u + i, i, u, "view", v) for u, values in prices.items() for i, v in enumerate(values)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["e02_granularity_fallback"]).fetchall()
    got = [tuple(r) for r in registry.queries()["e02_granularity_fallback"](spark, d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[0]: r[2:] for r in got} == {1: ("fine", 2.0), 2: ("fine", 1.0), 3: ("fine", 1.0), 4: ("none", None)}


_TIED = [(1, 1000, 0, "purchase", 9.0), (2, 1400, 0, "purchase", 2.0), (3, 1400, 0, "purchase", 1.5), (4, 1100, 0, "purchase", 4.0), (10, 500, 0, "error", 0.0), (11, 3_600_001_900, 0, "error", 0.0), (12, 3_600_000_000, 0, "error", 0.0)]


def test_publish_lag_takes_the_later_of_one_millisecond(spark, tmp_path):
    from tidemark.plans import engine

    got = {r["event_id"]: r["value"] for r in rows(engine.p07_publish_lag(spark, _events_table(spark, tmp_path, _TIED)))}
    assert got == {10: None, 11: 1.5, 12: None}


def test_asof_backward_takes_the_later_of_one_millisecond(spark, tmp_path):
    from tidemark.plans import engine

    got = {r["event_id"]: (r["obs_ms"], r["value"]) for r in rows(engine.j07_asof_backward(spark, _events_table(spark, tmp_path, _TIED)))}
    at = 1_704_067_200_001
    assert got == {10: (None, None), 11: (at, 1.5), 12: (at, 1.5)}


def test_asof_forward_takes_the_earlier_of_one_millisecond(spark, tmp_path):
    from tidemark.plans import engine

    tied = [(i, us, u, kind, {9.0: 3.0, 2.0: 8.0}.get(v, v)) for i, us, u, kind, v in _TIED]
    got = {r["event_id"]: (r["obs_ms"], r["value"]) for r in rows(engine.j09_asof_forward(spark, _events_table(spark, tmp_path, tied)))}
    assert got == {10: (1_704_067_200_001, 3.0), 11: (None, None), 12: (None, None)}


def test_lookups_of_null_users_and_times_meet_nothing(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import registry

    data = [(1, 0, None, "purchase", 7.0), (2, 7_200_000_000, None, "error", 1.0), (3, None, 0, "purchase", 8.0), (4, 7_200_000_000, 0, "error", 1.0), (5, None, 0, "error", 1.0), (6, 0, 1, "purchase", 6.0), (7, 7_200_000_000, 1, "error", 1.0)]
    data += [(100 + i, 100 * 3_600_000_000 + i * 1_000_000 if i else 0, 2, "purchase", 10.0) for i in range(20)] + [(300 + i, None, 2, "purchase", 50.0) for i in range(9)]
    data += [(400, 110 * 3_600_000_000, 2, "purchase", 20.0), (401, 111 * 3_600_000_000, 2, "error", 1.0)]
    d = _events_table(spark, tmp_path, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    for name in ("p07_publish_lag", "j07_asof_backward", "j09_asof_forward", "c04_derivative_score"):
        want = con.execute(registry.oracle_sql()[name]).fetchall()
        got = [tuple(r) for r in registry.queries()[name](spark, d).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 5
    assert [r[3] for r in got if r[2] == 401] == [0]  # 21 observations are too few, nine of null times don't help
