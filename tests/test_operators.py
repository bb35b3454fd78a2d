"""Known answers and small fixtures for what SQL cannot express."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import mathx
from quillon.operators import exhibits, models, panel, scoring, screens, signals
from quillon.operators import statistics as T
from quillon.plans import shared
from quillon.sources import records


def series(spark, drift, sd=0.007, n=2600, seed=1, only=None):
    r = random.Random(seed)
    rows = [(date(2010, 1, 1) + timedelta(days=k), r.gauss(drift if only is None or k < only else 0.0, sd)) for k in range(n)]
    return spark.createDataFrame(rows, "date date, ret double")


def test_a_persistent_edge_holds(spark):
    got = T.check_claim(series(spark, 0.0006), trials=12)
    assert got["status"] == "HOLDS", got["reasons"]
    assert [r["metric"] for r in got["table"]] == ["annual return", "Sharpe", "t-statistic", "worst held-out path", "overfitting probability", "years of history"]


def test_a_dead_signal_fails(spark):
    got = T.check_claim(series(spark, 0.0, seed=3), trials=40)
    assert got["status"] == "FAILS" and any("Newey-West" in r for r in got["reasons"])


def test_an_edge_in_one_stretch_is_not_clean(spark):
    assert T.check_claim(series(spark, 0.002, only=500), trials=12)["status"] in ("WEAKER", "FAILS")


def test_erosion_of_the_published_t(spark):
    got = T.check_claim(series(spark, 0.0006), claimed_t=9.0, trials=12)
    assert got["status"] == "WEAKER" and any("falls to" in r for r in got["reasons"])


def test_overfitting_of_period_specific_fits(spark):
    r = random.Random(5)
    rows = [(f"s{s}", date(2010, 1, 1) + timedelta(days=k), r.gauss(0.004 if k // 100 == s else -0.001, 0.004)) for s in range(6) for k in range(600)]
    frame = spark.createDataFrame(rows, "name string, date date, ret double")
    assert T.overfitting(frame).first()["pbo"] >= 0.5
    assert T.check_claim(frame.filter("name = 's0'").select("date", "ret"), trials=6, competing=frame)["status"] == "FAILS"


def test_short_series_and_missing_values(spark):
    got = T.check_claim(series(spark, 0.001, n=30))
    assert got["status"] == "INSUFFICIENT" and got["table"] == []
    rows = [(date(2010, 1, 1) + timedelta(days=k), 0.001 * (k % 7 - 3) if k < 300 else float("nan")) for k in range(350)]
    assert T.check_claim(spark.createDataFrame(rows, "date date, ret double"))["years"] == 300 / 252


def test_distributions():
    assert abs(mathx.norm_cdf(1.96) - 0.9750021) < 1e-6 and abs(mathx.norm_ppf(0.975) - 1.959964) < 1e-5
    assert abs(mathx.t_sf2(2.0, 10) - 0.0733880) < 1e-6 and abs(mathx.t_sf2(0.0, 5) - 1) < 1e-12
    assert mathx.expected_max_sharpe(1) == 0 and 1.6 < mathx.expected_max_sharpe(12) < 1.7
    low = mathx.nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, np.zeros(2))
    assert np.allclose(low, [3, -1], atol=1e-3) and abs(mathx.golden(lambda x: (x - 2) ** 2, 0, 5) - 2) < 1e-6


def test_copulas_tend_to_independence():
    assert abs(float(models.rises(models.frank_given, np.array(0.3), 0.6, 1.0)) - 0.553) < 5e-4
    for f, t in ((models.frank_given, 1e-7), (models.fgm_given, 0.0), (models.gaussian_given, 0.0)):
        assert abs(float(models.rises(f, np.array(0.3), 0.6, t)) - 0.6) < 1e-4


def test_estimators_recover_what_made_the_data():
    rng = np.random.default_rng(0)
    x = models.with_one(rng.normal(size=(4000, 2)))
    b = np.array([0.2, 0.5, -0.7])
    assert np.allclose(models.ols(x, x @ b), b)
    assert np.allclose(models.probit(x, (x @ b + rng.normal(size=4000) > 0).astype(float)), b, atol=0.1)
    p = 1 / (1 + np.exp(-x @ b))
    assert np.allclose(models.logit(x, (rng.random(4000) < p).astype(float)), b, atol=0.15)
    size = np.exp(x @ b) / math.gamma(1 + 1 / 1.5) * (-np.log1p(-rng.random(4000))) ** (1 / 1.5)
    fit = models.fit_magnitude(x, size)
    assert np.allclose(fit.beta, b, atol=0.06) and abs(fit.kappa - 1.5) < 0.1
    up, s = rng.random(60) < 0.5, np.round(rng.random(60), 1)
    pairs = [(a > c) + 0.5 * (a == c) for a in s[up] for c in s[~up]]
    assert abs(models.auc(s, up) - np.mean(pairs)) < 1e-12


def test_forward_fill_and_no_look_ahead(spark):
    rows = [("a", date(2020, 1, k), float(k) if k in (1, 20) else None) for k in range(1, 25)] + [("b", date(2020, 1, 1), None)]
    got = {(r.asset, r.date.day): r.close for r in panel.filled(panel.dense(spark.createDataFrame(rows, "asset string, date date, close double"))).collect()}
    assert got["a", 6] == 1 and got["a", 7] is None and got["a", 24] == 20 and not any(k[0] == "b" for k in got)
    full = spark.createDataFrame([(a, date(2020, 1, 1) + timedelta(days=k), 100.0 + (k * j) % 7) for j, a in ((3, "a"), (5, "b")) for k in range(60)], "asset string, date date, close double")
    cut = full.filter("date <= '2020-02-10'")
    for f in (lambda p: signals.momentum(p, 2, 9), lambda p: signals.beta(panel.returns(p), 10).select("asset", "date", "score"), lambda p: signals.macd(p, 5)):
        late = {(r.asset, r.date): r.score for r in f(full).collect()}
        assert all(r.score == late[r.asset, r.date] or abs(r.score - late[r.asset, r.date]) < 1e-12 for r in f(cut).collect() if r.score is not None)


def test_ewm_against_the_recursion(spark):
    values = [None, 1.0, 2.0, None, 4.0, 3.0]
    df = spark.createDataFrame([("a", date(2020, 1, 1 + k), v) for k, v in enumerate(values)], "asset string, date date, ret double")
    import pandas as pd

    want = pd.Series(values, dtype=float).ewm(span=3, adjust=False).mean()
    got = [r.ewm for r in signals.ewm(df, 3).orderBy("date").collect()]
    assert all((a is None and pd.isna(b)) or abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))


def test_printed_numbers_and_tables(spark):
    tokens = {"12": None, "1.25*": 1.25, "(0.31)": 0.31, "−3.4": -3.4, "$1,204.50": 1204.5, "12%": 12.0, "abc": None, "-": None}
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", scoring.parse_cell(F.col("t")).alias("c"))
    for r in df.collect():
        assert (r.c.value if r.c else None) == tokens[r.t]
    row = spark.range(1).select(scoring.split_row(F.lit("Buy and hold 104.63 9.1%")).alias("r")).first().r
    assert row.label == "Buy and hold" and row.numbers == ["104.63", "9.1%"]
    text = "Table 6. Out\nk = 1 k = 3\nTW AV TW AV\nBuy and hold 104.63 9.10 104.63 9.10\nMomentum\nmom 12 100.21 8.75* 98.10 8.50\nNotes: x 1.5"
    again = "Table 7. Panels\nTW AV SD\nPanel A: early\nx 1.1 2.2 3.3\nMSE R2 Hit\ny 4.4 5.5 6.6\nPanel B: late\nx 7.7 8.8 9.9\nragged 1.0 2.0\nFigure 1. Axis\n1.5 2.5"
    pages = spark.createDataFrame([("p", 3, text), ("p", 4, "Table 6. Out\nA B\nx 1.0 2.0"), ("p", 5, again), ("p", 6, None), ("q", 1, "no exhibit 1.5")], "paper string, page int, text string")
    got = exhibits.harvest(pages).collect()
    cells = {c.cell: c.value for c in got if c.exhibit == "Table 6"}
    assert cells["T6/Buy and hold/k = 1/TW"] == 104.63 and cells["T6/Momentum/mom 12/k = 3/AV"] == 8.5 and len(cells) == 8
    # a header after data begins a block; a panel without headers has those above the panels
    assert {c.cell: c.value for c in got if c.exhibit == "Table 7"} == {
        "T7/Panel A/x/TW": 1.1, "T7/Panel A/x/AV": 2.2, "T7/Panel A/x/SD": 3.3, "T7/Panel A/y/MSE": 4.4, "T7/Panel A/y/R2": 5.5, "T7/Panel A/y/Hit": 6.6,
        "T7/Panel B/x/TW": 7.7, "T7/Panel B/x/AV": 8.8, "T7/Panel B/x/SD": 9.9,
    }
    assert {c.paper for c in got} == {"p"} and exhibits.collisions(exhibits.harvest(pages)).count() == 0


def test_signal_code_is_checked(spark):
    good = "import pandas as pd\ndef signal(prices: pd.DataFrame) -> pd.DataFrame:\n    return prices.diff()\n"
    assert exhibits.check_code(good) == ([], [])
    for bad in ("import os\n" + good, good.replace("diff()", "shift(-1)"), good + "def other():\n    pass\n", good.replace("signal(", "score("), "def ("):
        assert exhibits.check_code(bad)[0]
    with pytest.raises(ValueError):
        exhibits.apply_signal(spark.createDataFrame([("a", date(2020, 1, 1), 1.0)], "asset string, date date, close double"), "import os")


def test_records(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text('{"id": "https://x/W1", "doi": "https://doi.org/10.1/a", "title": "T", "counts_by_year": [{"year": 2020, "cited_by_count": 3}, {"year": 2022, "cited_by_count": 5}, {"year": 2021, "cited_by_count": 4}], "abstract_inverted_index": {"the": [0, 2], "cat": [1]}, "authorships": [{"author": {"display_name": "A B"}, "countries": ["US"]}], "referenced_works": ["https://x/W2", "https://x/W3"]}\nnot json\n')
    rows = records.flat_works(records.read_json(spark, f"file://{tmp_path}/w.json", records.WORK)).collect()
    assert len(rows) == 1 and len(rows[0].asDict()) == 27
    r = rows[0]
    assert (r.id, r.doi, r.abstract, r.refs, r.cites_recent2, r.cites_prior2, r.authors, r.countries) == ("W1", "10.1/a", "the cat the", "W2 W3", 9, 3, "A B", "US")
    (tmp_path / "c.csv").write_text("﻿Acronym,T-Stat,Mean Return,Sign,SampleStartYear,SampleEndYear,Cat.Signal,Predictability in OP,Portfolio Period\nMom12m,3.1,1.10,1,1965,1989,Predictor,1_clear,1\nX,,,-1,,,Placebo,1_clear,\n", encoding="utf-8")
    got = {r.Acronym: r for r in records.openap_fixture(records.read_catalogue(spark, f"file://{tmp_path}/c.csv")).collect()}
    assert abs(got["Mom12m"].annual_return - 0.132) < 1e-12 and got["Mom12m"].sign == "+" and got["Mom12m"].horizon_days == 21 and got["Mom12m"].window_start == date(1990, 1, 1)
    assert got["X"].verdict == "kill" and got["X"].sharpe_range.hi == 0.6 and got["X"].horizon_days == 1


def test_log_of_two_shapes(spark, tmp_path):
    p = f"file://{tmp_path}/log"
    records.append_log(spark.createDataFrame([("2026-01-01", 0.5, 1.0)], "timestamp string, verdict_accuracy double, asymmetric_loss double"), p)
    records.append_log(spark.createDataFrame([("2026-01-02", 2)], "ts string, triaged int"), p)
    log = records.read_log(spark, p)
    assert sorted(r.ts for r in log.collect()) == ["2026-01-01", "2026-01-02"] and scoring.platform_metrics(log).first().runs == 1


def test_fundamentals_and_upsert(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"General": {"Code": "leh.US"}, "Financials": {"Income_Statement": {"quarterly": {"2007-08-31": {"filing_date": null, "grossProfit": "12.5"}, "2007-05-31": {"filing_date": "2007-07-01", "grossProfit": "x"}}}}}')
    got = {r.fiscal_date: r for r in records.fundamentals_panel(records.read_json(spark, f"file://{tmp_path}/f.json", records.FUNDAMENTALS, True), "Income_Statement", "quarterly", ["grossProfit"]).collect()}
    assert got[date(2007, 8, 31)].filing_date == date(2007, 10, 15) and got[date(2007, 8, 31)].grossProfit == 12.5 and got[date(2007, 8, 31)].ticker == "LEH"
    assert got[date(2007, 5, 31)].grossProfit is None
    a = spark.createDataFrame([(1, 1, "old"), (2, 1, "two")], "id int, t int, v string")
    b = spark.createDataFrame([(1, 2, "new")], "id int, t int, v string")
    assert {(r.id, r.v) for r in records.upsert(a, b, ["id"], "t").collect()} == {(1, "new"), (2, "two")}


def test_screen_of_a_null_text(spark):
    r = spark.range(1).select(screens.practical(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("g"), screens.taxonomy(F.lit(None).cast("string")).alias("k")).first()
    assert r.g.ok is False and r.k.task == "General"


def test_noise_does_not_ship(spark):
    row = spark.createDataFrame([(0.1, -0.3, 0.001, -0.2, -0.1), (0.99, 2.0, 0.04, 1.0, 0.9), (None, None, None, None, None), (0.7, 0.2, 0.01, 0.5, 0.1)], "dsr double, icir double, ic_mean double, sharpe double, sharpe_oos double")
    assert [r.verdict for r in T.verdict(row).collect()] == ["kill", "ship", "iterate", "iterate"]


def test_upserting_stream_is_idempotent(spark, tmp_path):
    from quillon.streaming import feeds

    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.parquet(src)
    for n in range(2):
        s = spark.readStream.schema("k int, v string").parquet(src)
        q = feeds.upsert_batches(s, out, ["k"]).option("checkpointLocation", f"{tmp_path}/state{n}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_staged_tables_keep_their_rows(spark):
    df = shared.staged(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 10 and shared.scratch_dir(spark).startswith("file:")


def test_record_helpers(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, rank int, v string")
    assert {r.v for r in records.by_priority(rows, ["k"], "rank").collect()} == {"y", "z"}
    p = spark.createDataFrame([("m", "LS", date(2020, 1, 15), 1.5), ("m", "01", date(2020, 1, 15), 9.0)], "signalname string, port string, date date, ret double")
    assert [(r.date, r.theirs) for r in records.published_portfolio(p, "m").collect()] == [(date(2020, 1, 31), 1.5)]
    c = records.with_counts(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 5), (1, 7)], "id int, citations int"))
    assert {r.id: r.citations for r in c.collect()} == {1: 7, 2: 0}


def test_command_line_lists_queries(capsys):
    from quillon import cli

    assert cli.main(["list"]) == 0 and "momentum_backtest" in capsys.readouterr().out
