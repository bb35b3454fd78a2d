"""Operators without SQL against plain Python, numpy or pandas."""

import itertools
import math
import random
import statistics as st

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import mathx
from quillon.operators import exhibits, graphs, notes, ranking, reports, signals, statistics
from quillon.plans import registry, shared
from quillon.sources import records

QUERIES, _ = registry.load()
FOLDER = "/root/testdata/sf0.001"


def days(n):
    return [d.date() for d in pd.date_range("2001-01-01", periods=n)]


def test_macd_against_pandas(spark):
    r = random.Random(1)
    rows = [(a, d, None if r.random() < 0.1 else 100 + r.gauss(0, 5)) for a in "xy" for d in days(120)]
    got = {(x.asset, x.date): x.score for x in signals.macd(spark.createDataFrame(rows, "asset string, date date, close double"), 12).collect()}
    for a in "xy":
        close = pd.Series([c for n, _, c in rows if n == a], dtype=float)
        d = close - close.shift(1)
        sigma = d.abs().rolling(12, min_periods=2).std() / close
        star = (close * sigma * np.sign(d)).rolling(12, min_periods=6).sum() / 12
        want = star.ewm(span=12, adjust=False).mean() - star.ewm(span=26, adjust=False).mean()
        want = want - 0.9 * want.ewm(span=9, adjust=False).mean()
        for day, w in zip(days(120), want, strict=True):
            g = got[(a, day)]
            assert (g is None and math.isnan(w)) or g == pytest.approx(w, abs=1e-9)


def test_ewm_carries_its_state_over_batches(spark):
    before = spark.conf.get(shared.BATCH)
    spark.conf.set(shared.BATCH, "7")
    try:
        rows = [(f"a{k % 3}", d, None if k % 11 == 0 else float(k * k % 101)) for k, d in enumerate(days(90))]
        got = signals.ewm(spark.createDataFrame(rows, "asset string, date date, ret double"), 5).collect()
    finally:
        spark.conf.set(shared.BATCH, before)
    for a in ("a0", "a1", "a2"):
        want = pd.Series([x for n, _, x in rows if n == a], dtype=float).ewm(span=5, adjust=False).mean().tolist()
        have = [math.nan if x.ewm is None else x.ewm for x in sorted(got, key=lambda x: x.date) if x.asset == a]
        assert have == pytest.approx(want, nan_ok=True)


def test_deflated_sharpe_and_expected_maximum(spark):
    r = random.Random(5)
    x = [r.gauss(0.001, 0.01) + (0.05 if k % 50 == 0 else 0) for k in range(300)]
    row = statistics.deflated_sharpe(spark.createDataFrame(list(zip(days(300), x, strict=True)), "date date, ret double"), 12).first()
    a = np.array(x)
    raw, z = a.mean() / a.std(ddof=1), (a - a.mean()) / a.std()
    skew, kurt = (z**3).mean(), (z**4).mean()
    sd = math.sqrt((1 - skew * raw + (kurt - 1) / 4 * raw * raw) / (len(a) - 1))
    normal = st.NormalDist()
    gamma = 0.5772156649015329
    best = (1 - gamma) * normal.inv_cdf(1 - 1 / 12) + gamma * normal.inv_cdf(1 - 1 / (12 * math.e))
    assert mathx.expected_max_sharpe(12) == pytest.approx(best, abs=1e-6)
    assert row.z_score == pytest.approx((raw - best * sd) / sd, abs=1e-6) and row.dsr == pytest.approx(normal.cdf((raw - best * sd) / sd), abs=1e-6)


def test_overfitting_and_paths_by_brute_force(spark):
    r = np.random.default_rng(3)
    data = {f"s{k}": r.normal(0.0005 * k, 0.01, 240) for k in range(5)}
    long = spark.createDataFrame([(n, d, float(x)) for n, v in data.items() for d, x in zip(days(240), v, strict=True)], "name string, date date, ret double")
    block = np.arange(240) * 8 // 240
    low = []
    sharpe = lambda v: v.mean() / v.std(ddof=1)
    for half in itertools.combinations(range(8), 4):
        inside = np.isin(block, half)
        best = max(data, key=lambda n: sharpe(data[n][inside]))
        rank = sum(sharpe(v[~inside]) <= sharpe(data[best][~inside]) for v in data.values())
        low.append(rank / 6 <= 0.5)
    assert statistics.overfitting(long).first().pbo == pytest.approx(np.mean(low), abs=1e-4)
    one = long.filter("name = 's4'").select("date", "ret")
    six = np.arange(240) * 6 // 240
    want = sorted(sharpe(data["s4"][np.isin(six, c)]) * math.sqrt(252) for c in itertools.combinations(range(6), 2))
    got = statistics.path_summary(statistics.path_sharpes(one)).first()
    assert got.paths == 15 and (got.worst, got.best) == pytest.approx((want[0], want[-1]), abs=1e-3)


def test_auc_by_pairs(spark):
    r = random.Random(4)
    rows = [(None if r.random() < 0.05 else float(r.randint(0, 30)), r.random() < 0.4) for _ in range(400)]
    value = lambda s: -math.inf if s is None else s
    pairs = [(value(a), value(b)) for a, x in rows if x for b, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert statistics.auc(spark.createDataFrame(rows, "score double, positive boolean").repartition(5)).first().auc == pytest.approx(want)
    assert statistics.auc(spark.createDataFrame([], "score double, positive boolean")).first().auc is None


def test_sweep_is_what_single_runs_are(spark):
    r = random.Random(6)
    edges = spark.createDataFrame(sorted({(r.randint(50, 120), r.randint(0, 90)) for _ in range(1500)}), "src long, dst long")
    seeds = spark.createDataFrame([(k,) for k in range(30)], "id long")
    bad = spark.createDataFrame([(k,) for k in range(60, 80)], "id long")
    grid = {"least_hits": [3, 6], "least_score": [4.0], "promote": [6.0, 99.0], "decay": [0.5]}
    got = {(x.least_hits, x.promote): x for x in graphs.sweep(edges, seeds, bad, 3, grid, rounds=4, least_fresh=2).collect()}
    assert len(got) == 4
    from pyspark.sql import functions as F

    for (hits, promote), row in got.items():
        one = []
        for fold in range(3):
            hidden = seeds.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == fold).select("id")
            one.append(graphs.holdout_recovery(edges, seeds, hidden, bad, least_hits=int(hits), least_score=4.0, promote=promote, decay=0.5, rounds=4, least_fresh=2).first())
        for c in ("recall", "leak", "objective"):
            assert row[c] == pytest.approx(np.mean([x[c] for x in one]), abs=2e-6)


def test_forecast_sweep_by_least_squares(spark):
    from quillon.plans.estimators import PREDICTORS, WINDOW, frame

    rows = frame(spark, FOLDER).orderBy("date").select("date", "xs", *PREDICTORS).toPandas()
    x, y = rows[PREDICTORS].to_numpy(float), rows["xs"].to_numpy(float)
    errors, bench = {k: [] for k in range(1, 5)}, []
    for t in range(WINDOW, len(y)):
        past = slice(t - WINDOW, t)
        bench.append(y[t] - y[past].mean())
        for k in errors:
            out = []
            for c in itertools.combinations(range(4), k):
                design = np.column_stack([np.ones(WINDOW), x[past][:, c]])
                out.append(np.append(1.0, x[t, list(c)]) @ np.linalg.pinv(design) @ y[past])
            errors[k].append(y[t] - np.mean(out))
    got = {r.model: r for r in QUERIES["forecast_sweep"](spark, FOLDER).collect()}
    for k, e in errors.items():
        assert got[f"subsets {k}"].r2 == pytest.approx(100 * (1 - np.square(e).sum() / np.square(bench).sum()), abs=1e-3)
    assert got["mean"].r2 == 0 and got["log decomposed 2"].n == len(bench)


GOOD = "def signal(prices: 'F') -> 'F':\n    return prices.rolling(3).mean()\n"


@pytest.mark.parametrize(
    "body,word",
    [("prices.__class__.__mro__[1].__subclasses__()", "private name"), ("prices.shift(periods=-1)", "lookahead"), ("prices.shift(-2)", "lookahead"), ("prices.diff(-1)", "lookahead"), ("__builtins__", "private name"), ("prices.pct_change(periods=-3)", "lookahead"), ("open('x')", "banned")],
)
def test_bad_code_is_named(body, word):
    errors, _ = exhibits.check_code(f"def signal(prices: 'F') -> 'F':\n    return {body}\n")
    assert any(word in e for e in errors)


def test_code_runs_within_limits():
    wide = pd.DataFrame({"close": np.arange(60.0)}, index=pd.date_range("2001-01-01", periods=60))
    assert exhibits.check_code(GOOD) == ([], []) and exhibits.is_causal(GOOD, wide)
    hidden = "def signal(prices: 'F') -> 'F':\n    k = 0 - 1\n    return prices.shift(k).rolling(2).mean()\n"
    assert not exhibits.check_code(hidden)[0] and not exhibits.is_causal(hidden, wide)
    assert not exhibits.is_causal("def signal(prices: 'F') -> 'F':\n    return prices - prices.mean()\n", wide)
    endless = "def signal(prices: 'F') -> 'F':\n    while True:\n        pass\n"
    with pytest.raises(TimeoutError):
        exhibits.run_signal(endless, wide, seconds=1)


def test_aliases_in_three_forms(spark):
    wanted = spark.createDataFrame([(1, ["nothing", "Some Title!"]), (2, ["see arXiv 2401.01234v3"]), (3, [" MOM12m "]), (4, ["none"]), (5, [None, "a b"])], "id int, aliases array<string>")
    runs = spark.createDataFrame([("some-title", "r1"), ("2401.01234", "r2"), ("mom12m", "r3"), ("A B v2", "r5"), ("a-b", "r6")], "key string, run string")
    got = {r.id: r.run for r in ranking.resolve_aliases(wanted, runs).collect()}
    assert got[1] == "r1" and got[2] == "r2" and got[3] == "r3" and 4 not in got and got[5] in ("r5", "r6")


def test_universe_and_citation_helpers(spark, tmp_path):
    (tmp_path / "u.json").write_text('["AAA", "BBB",\n "AAA"]')
    assert sorted(r.symbol for r in records.load_universe(spark, str(tmp_path / "u.json"), []).collect()) == ["AAA", "BBB"]
    assert [r.symbol for r in records.load_universe(spark, str(tmp_path / "no.json"), ["X", "Y"]).collect()] == ["X", "Y"]
    works = spark.createDataFrame([(1, " a b  a"), (2, ""), (3, None)], "id long, refs string")
    assert sorted((r.src, r.dst) for r in graphs.edges_from_refs(works).collect()) == [(1, "a"), (1, "b")]
    wanted = spark.createDataFrame([("n1", "10.1/x", "k1", "lee"), ("n2", None, "k2", "kim"), ("n3", None, "k9", "kim")], "name string, doi string, key string, surname string")
    known = spark.createDataFrame([(1, "10.1/x", "k1", "lee", 5), (2, None, "k2", "kim", 7), (3, None, "k2", "kim", 9)], "id long, doi string, key string, surname string, citations int")
    assert {r.name: r.work for r in graphs.resolve_seeds(wanted, known).collect()} == {"n1": 1, "n2": 3}
    rows = spark.createDataFrame([("a", "Price", "1_clear"), ("b", "Other", "1_clear"), ("c", "Trading", "4_not")], "Acronym string, `Cat.Data` string, `Predictability in OP` string")
    assert [r.Acronym for r in reports.keep_predictors(rows).collect()] == ["a"]
    assert reports.targets([("w", {"cagr": 1.0, "sharpe": 2.0})], {"cagr": 0.5, "sharpe": 0.05}) == [("w", "cagr", 1.0, 0.5), ("w", "sharpe", 2.0, 0.05)]


def test_catalogue_claims_and_tables(spark):
    columns = ["Acronym", "Authors", "Year", "T-Stat", "Mean Return", "SampleStartYear", "SampleEndYear", "Predictability in OP"]
    rows = spark.createDataFrame([("Mom12m", "J and T", "1993", "3.7", "1.10", "1964", "1989", "1_clear"), ("Blank", " ", None, "", "n/a", None, " ", None)], ", ".join(f"`{c}` string" for c in columns))
    mom, blank = sorted(statistics.catalogue_claims(rows).collect(), key=lambda r: r.paper_id != "openap_mom12m")
    assert mom.claimed_annual_return == pytest.approx(0.132) and (mom.claimed_t, mom.sample_start_year, mom.sample_end_year) == (3.7, 1964, 1989)
    assert (blank.claimed_t, blank.claimed_annual_return, blank.sample_start_year, blank.notes) == (None, None, None, "") and "? (?)" in blank.source
    text = statistics.gap_table([{"metric": "t", "claimed": 3.7, "replicated": None}])
    assert text.splitlines()[-1] == "| t | 3.7 | n/a |"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.scratch_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert shared.scratch_dir(Session).startswith("file:///")


def test_staged_tables_can_be_deleted(spark):
    import os

    one = shared.staged(spark.range(5), "x")
    two = shared.settled(spark, lambda: shared.staged(spark.range(3), "y").selectExpr("id + 1 AS id"), "z")
    assert sorted(r.id for r in two.collect()) == [1, 2, 3] and os.path.isdir(one.staged_in.removeprefix("file:"))
    shared.discard(one)
    assert not os.path.isdir(one.staged_in.removeprefix("file:"))
    assert not any("/y-" in p for p in shared._folders)


def test_columns_by_position(spark):
    words = [("s", 1, 10, 30, "Small"), ("s", 1, 38, 62, "Large"), ("s", 2, 8, 12, "k=1"), ("s", 2, 25, 31, "k=2"), ("s", 2, 40, 44, "k=1"), ("s", 2, 55, 61, "k=2")]
    numbers = [("s", k, x, x + 4, f"{x}.5") for k in (3, 4) for x in (8, 26, 40, 56)] + [("s", 5, 70, 74, "1.5"), ("s", 3, 0, 4, "row")]
    schema = "sheet string, line int, x0 int, x1 int, text string"
    got = exhibits.named_by_position(spark.createDataFrame(words, schema), exhibits.column_centres(spark.createDataFrame(numbers, schema))).collect()
    assert {r.col: r.name for r in got} == {1: "Small/k=1", 2: "Small/k=2", 3: "Large/k=1", 4: "Large/k=2"}


def test_plain_words_before_patterns(spark):
    from pyspark.sql import functions as F

    from quillon.functions import rules as R
    from quillon.operators import screens

    assert screens.alternatives(r"a(b|c)d|[|]e|\\|f") == ["a(b|c)d", "[|]e", r"\\", "f"] or screens.alternatives(r"a(b|c)d|[|]e") == ["a(b|c)d", "[|]e"]
    assert [screens.required(x) for x in ("hedg(e|ing)", r"\bCEO\b", "tax(ation)? (policy)", "I/?B/?E/?S", "ab{2,3}cde", "colou?r", "x+yz")] == ["hedg", "ceo", "tax", "i", "cde", "colo", "yz"]
    r = random.Random(2)
    for pattern in (R.STRATEGY, R.ESSAY, R.UNOBTAINABLE, R.THEORY_ONLY, R.SYNTHETIC):
        bits = [x for a in screens.alternatives(pattern) for x in (screens.required(a).upper(), a.replace("\\b", "").replace("?", ""))]
        rows = [(" ".join(r.choice([*bits, "plain", "words", "ibes", "I/B/E/S"]) for _ in range(r.randint(0, 3))),) for _ in range(300)]
        t = F.col("t")
        out = spark.createDataFrame(rows, "t string").select(screens.has(t, pattern).alias("a"), screens.has_in(t, F.lower(t), pattern).alias("b")).collect()
        assert all(x.a == x.b for x in out) and any(x.a for x in out)


def test_patterns_are_run_on_texts_with_their_own_words(spark):
    from pyspark.sql import functions as F

    from quillon.functions import rules as R
    from quillon.operators import screens

    r = random.Random(5)
    for pattern in (R.THEORY, R.SYNTHETIC, R.EMPIRICAL):
        bits = [x for a in screens.alternatives(pattern) for x in (screens.required(a).upper(), a.replace("\\b", "").replace("\\s+", " ").replace("?", ""))]
        rows = [(" ".join(r.choice([*bits, "plain", "using", "DATA FROM", "1990 to 2015", "s&p 500", "proof of", "etfs"]) for _ in range(r.randint(0, 4))),) for _ in range(400)]
        t = F.col("t")
        out = spark.createDataFrame(rows, "t string").select(screens.has(t, pattern).alias("a"), screens.has_any(t, F.lower(t), pattern).alias("b")).collect()
        assert all(x.a == x.b for x in out) and any(x.a for x in out) and any(not x.a for x in out)
    plan = spark.createDataFrame([("a", "b")], "t string, a string").select(screens.abstract_screen(F.col("t"), F.col("a")))._jdf.queryExecution().analyzed().toString()
    assert f"(?i){R.EMPIRICAL}" not in plan and f"(?i){R.THEORY}" not in plan


def balanced(text):
    """The first JSON object in a text, by its braces outside of strings."""
    depth, start, quoted, skip = 0, -1, False, False
    for k, c in enumerate(text or ""):
        if quoted:
            skip, quoted = c == "\\" and not skip, c != '"' or skip
        elif c == "{":
            start = k if not depth else start
            depth += 1
        elif depth and c == '"':
            quoted, skip = True, False
        elif depth and c == "}":
            depth -= 1
            if not depth:
                return text[start : k + 1]
    return None


def test_first_objects_of_random_texts(spark):
    r = random.Random(12)
    texts = ["".join(r.choice('{}{}"\\ab:é😀\n') for _ in range(r.randint(0, 30))) for _ in range(600)] + ["", "x" * 50_000 + '{"a": "}"}']
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", notes.first_object(F.col("t")).alias("o"))
    assert {x.t: x.o for x in df.collect()} == {t: balanced(t) for t in [*texts, None]}


def test_proposals_are_set_at_their_paths(spark):
    config = spark.createDataFrame([("m", "a.b", "1"), ("m", "a.c.d", "2"), ("m", "e", "3"), ("n", "a", "4")], "name string, path string, value string")
    new = [("m", "a.b", "old", 1), ("m", "a.b", "new", 2), ("m", "a.x.y", "5", 1), ("m", "e.f", "6", 1), ("m", "a.c", "7", 1), ("n", "a.b", "8", 1), ("k", "z", "9", 1)]
    got = notes.applied(config, spark.createDataFrame(new, "name string, path string, value string, at int"))
    assert {(x.name, x.path): (x.value, x.state) for x in got.collect()} == {
        ("m", "a.b"): ("new", "set"), ("m", "a.c.d"): ("2", "kept"), ("m", "e"): ("3", "kept"), ("n", "a"): ("4", "kept"), ("m", "a.x.y"): ("5", "added"),
        ("m", "e.f"): ("6", "refused"), ("m", "a.c"): ("7", "refused"), ("n", "a.b"): ("8", "refused"), ("k", "z"): ("9", "added"),
    }
    whole = {x.name: x.json for x in notes.nested(got.filter("state <> 'refused'")).collect()}
    assert whole == {"m": '{"a":{"b":"new","c":{"d":"2"},"x":{"y":"5"}},"e":"3"}', "n": '{"a":"4"}', "k": '{"z":"9"}'}


def test_balanced_objects_and_newest(spark):
    from quillon.operators import notes

    cases = {'x {"a": {"b": "}"}} {"c": 1}': '{"a": {"b": "}"}}', "none": None, '{"q": "\\" {"} rest': '{"q": "\\" {"}', "{open": None, "": None}
    assert {t: balanced(t) for t in cases} == cases
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", notes.first_object(F.col("t")).alias("o"))
    assert {r.t: r.o for r in df.collect()} == {t: balanced(t) for t in [*cases, None]}
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 1)], "k string, at int")
    assert sorted(map(tuple, notes.newest(rows, "k", "at", 2).collect())) == [("a", 2), ("a", 3), ("b", 1)]


def test_leading_idea_by_sentences(spark):
    import re

    from pyspark.sql import functions as F

    from quillon.operators import screens

    texts = ["This paper: We test momentum. It holds! Does it last? " + "Long tail " * 40, "Abstract. One.", "", None, "no stop at all " * 30, "In this study, we find x. y. z."]
    got = [r.i for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(screens.idea(F.col("t")).alias("i")).collect()]
    assert all(len(g or "") <= 200 for g in got)
    for t, g in zip(texts, got, strict=True):
        # what stays is a beginning of the text without its opener, whole sentences or cut at a word
        if g:
            body = re.sub(r"(?i)^\s*(abstract|this (paper|study|article)|in this (paper|study|article),?( we)?)[:.]?\s*", "", t)
            plain = " ".join(g.rstrip(".…").split())
            assert " ".join(body.split()).startswith(plain)
    assert got[1].startswith("One") and not got[0].lower().startswith("this paper")


def test_paged_source_reads_every_chain(spark, tmp_path):
    from quillon.sources import external

    root = str(tmp_path)
    pages = {("a", "*"): (["1", "2"], "p2"), ("a", "p2"): (["3"], None), ("b", "*"): (["4"], "p9"), ("b", "p9"): ([], "p9"), ("c", "*"): ([], None)}
    for (q, cursor), (results, after) in pages.items():
        (tmp_path / f"{q}_{cursor.replace('*', 'first')}.txt").write_text("\n".join([after or "", *results]))

    def fetch(query, cursor):
        with open(f"{root}/{query}_{cursor.replace('*', 'first')}.txt") as f:
            after, *results = f.read().split("\n")
        return {"results": results, "next_cursor": after or None}

    spark.dataSource.register(external.paged_source(fetch))
    got = spark.read.format("paged").option("queries", "a\nb\nc").load()
    assert sorted(tuple(r) for r in got.collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")]
    assert got.rdd.getNumPartitions() == 3
    assert spark.read.format("paged").option("queries", "c").load().count() == 0


def test_feeds_with_nothing_to_read(spark):
    from pyspark.sql import functions as F

    from quillon.sources import external

    logs = spark.createDataFrame([(None,), ("",), ("a\tb\x1e",), ("s\tt\tu\x1e\n\x1e v\tw\tx\ty\tz",)], "log string").select(external.commits(F.col("log")).alias("c"))
    assert [[tuple(c) for c in r.c] for r in logs.collect()] == [[], [], [], [("s", "t", "u", ""), ("v", "w", "x", "y\tz")]]
    lists = spark.createDataFrame([(None,), ("broken",), ("[]",), ('[{"title": "t", "url": "u", "body": null}]',)], "json string")
    assert [tuple(r) for r in external.mentions(lists).collect()] == [("github_issue", "u", "t\n\n")]
    rows = spark.createDataFrame([], "symbol string, date date, field string, value double")
    assert external.price_panel(rows).count() == 0 and external.named_panel(rows.withColumnRenamed("value", "close"), ["a"]).count() == 0
    assert [r.symbol for r in external.dead_symbols(rows, spark.createDataFrame([("x",), ("x",)], "symbol string")).collect()] == ["x"]


def test_named_universes(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"universes": {"big": ["A", "B"], "small": ["C"]}}')
    (tmp_path / "v.json").write_text('{"big": ["D"]}')
    names = lambda f, name: sorted(r.symbol for r in records.load_universe(spark, str(tmp_path / f), ["X"], name).collect())
    assert names("u.json", "big") == ["A", "B"] and names("v.json", "big") == ["D"] and names("u.json", "none") == [] and names("no.json", "big") == ["X"]


def test_exhibit_labels(spark):
    from pyspark.sql import functions as F

    labels = {"T6": "Table 6", "TB1": "Table B1", "F12": "Figure 12", "X3": "X 3", "Tab": "Tab", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in labels], "k string").select("k", exhibits.exhibit_label(F.col("k")).alias("v"))
    assert {r.k: r.v for r in df.collect()} == labels


def test_all_papers_end_as_each_alone(spark):
    from quillon.operators import books, panel
    from quillon.plans.estimators import CODE
    from quillon.sources import views

    prices = panel.dense(views.supplier_month(spark, FOLDER))

    def backtest(scores):
        return books.net_returns(prices, books.quintile_long_short(panel.normalized(scores).filter("score is not null")), 5.0)

    texts = [("a", None), ("b", ""), ("c", "x" * 499), ("d", "x" * 500)]
    papers = spark.createDataFrame(texts, "paper string, text string")
    for code in (CODE, "import os"):
        alone = [reports.replicate(p, t, {}, code, prices, backtest, 2.0, 3) for p, t in texts]
        want = {(r.paper, r.status, r.claim.get("status"), r.result.get("sharpe")) for r in alone}
        assert {tuple(r) for r in reports.replicate_all(papers, code, prices, backtest, 2.0, 3).collect()} == want


def test_rounds_of_the_loop(spark):
    from pyspark.sql import functions as F

    from quillon.streaming import loop

    schema = "id long, external_id string, inserted long, status string"
    known = spark.createDataFrame([(1, "a", 1, "tradable")], schema)
    feed = spark.createDataFrame([(2, "a", 2), (3, "b", 3), (4, "b", 4), (5, "c", 5), (6, "d", 6)], "id long, external_id string, inserted long")
    run = loop.Loop(F.when(F.col("id") % 2 == 1, "tradable").otherwise("rejected"), lambda due: due.select("external_id", F.lit("done").alias("outcome")), triage_limit=2)
    first = run.round(loop.State(known, None), feed)
    assert first.counts() == (3, 2, 2, 3, 0)
    assert {r.external_id: r.status for r in first.papers.collect()} == {"a": "tradable", "b": "tradable", "c": "tradable", "d": "pending"}
    second = run.round(first, feed)
    assert second.counts() == (0, 1, 0, 0, 0) and sorted(r.external_id for r in second.results.collect()) == ["a", "b", "c"]

    def broken(due):
        raise ValueError("no machine")

    third = loop.Loop(F.lit("tradable"), broken).round(loop.State(known, None))
    assert third.counts() == (0, 0, 0, 0, 1) and third.errors == ["replicate: ValueError: no machine"]


def test_an_idea_is_described(spark):
    rows = spark.createDataFrame([(1, "Momentum and more"), (2, "momentum"), (3, "Value"), (4, None)], "id long, title string")
    name = lambda idea: [r.id for r in ranking.described(rows, idea).collect()]
    assert name(" Momentum ") == [2] and name("more") == [1] and name("3") == [3] and name("carry") == []


def test_versions_and_dropped_papers_of_a_listing(spark):
    from quillon.operators import screens

    good = "momentum in the cross-section of stock returns, a long-short portfolio strategy on CRSP data from 1990 to 2015"
    listing = spark.createDataFrame([("1v1", "old " + good, good, 1), ("1v2", "new " + good, good, 2), ("2v1", good, good, 1), ("3", "corporate governance essay", "", 1)], "id string, title string, abstract string, published long")
    ledger = spark.createDataFrame([("2", "drop"), ("1", "keep")], "base string, verdict string")
    assert [(r.base, r.title[:3]) for r in screens.gated(listing, ledger).collect()] == [("1", "new")]


def test_queued_signals_against_pandas(spark):
    from quillon.operators import published

    r = random.Random(4)
    level = 100.0
    rows = []
    for d in days(90):
        level *= 1 + r.gauss(0, 0.05)
        rows.append(("a", d, level, r.uniform(1, 9)))
    got = published.by_history(spark.createDataFrame(rows, "asset string, date date, close double, volume double")).orderBy("date").toPandas()
    p = pd.DataFrame(rows, columns=["asset", "date", "close", "volume"])
    ret, value = p.close.pct_change(), p.close * p.volume
    lags = [ret.shift(k) for k in (23, 35, 47, 59)]
    want = {
        "intermediate": p.close.shift(6) / p.close.shift(12) - 1, "long_reversal": 1 - p.close.shift(13) / p.close.shift(60), "season": sum(lags) / 4,
        "off_season": -pd.Series([np.nan if k < 60 else np.mean([ret[k - j] for j in range(12, 60) if j not in (23, 35, 47, 59)]) for k in range(90)]),
        "high": p.close / p.close.rolling(12).max(), "illiquid": (ret.abs() / value).rolling(12).mean(), "quiet": -np.log(value.shift(2)), "managed": ret / ret.shift(1).rolling(12).var(), "cheap": -np.log(p.close),
    }
    for name, series in want.items():
        assert np.allclose(got[name].astype(float), series.astype(float), equal_nan=True), name


def test_sweep_keeps_seeds_once_for_all_settings(spark, monkeypatch):
    edges = spark.createDataFrame([(1000 + k, k * j % 50) for k in range(200) for j in (1, 3, 7)], "src long, dst long").distinct()
    seeds, bad = spark.range(40).select("id"), spark.range(40, 45).select("id")
    rows, write = [], graphs.staged

    def counted(df, name):
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graphs, "staged", counted)
    totals = []
    for promote in ([50.0], [50.0 + k for k in range(30)]):
        rows.clear()
        assert graphs.sweep(edges, seeds, bad, 2, {"least_hits": [99], "promote": promote}).count() == len(promote)
        totals.append(sum(rows))
    assert totals[1] - totals[0] <= 4 * 2 * 30  # rows of runs, not of their seeds
