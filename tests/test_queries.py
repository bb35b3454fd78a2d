"""Every registered query of the library against its SQL, or for rows where SQL cannot express it."""

import oracle
import pytest

from quillon.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert oracle.difference(QUERIES[name], SQL[name], spark, FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Rows with values; what they are is tested in test_operators and test_brute."""
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    assert all(any(r[c] is not None for r in rows) for c in df.columns if c not in ("change", "claim"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def brute_ewm(levels, span):
    out, a = [], 2 / (span + 1)
    for x in levels:
        out.append(x if not out else out[-1] * (1 - a) + x * a)
    return out


def test_ewm_series_has_all_dates(spark, tmp_path):
    import datetime

    days = [datetime.datetime(1995, 1, 1) + datetime.timedelta(days=k) for k in range(450)]
    prices = [1000.0 * (k * k % 97) for k in range(450)]
    spark.createDataFrame(list(zip(days, prices, strict=True)), "o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(QUERIES["ewm_series"](spark, str(tmp_path)).collect())
    assert [r.date for r in got] == [d.date() for d in days]
    assert [r.ewm for r in got] == pytest.approx(brute_ewm([1000 + p / 1000 for p in prices], 12), abs=1e-6)


def test_the_whole_log_has_all_days(spark, tmp_path):
    import datetime

    days = [datetime.datetime(1995, 5, 20) + datetime.timedelta(days=k) for k in range(40)]
    spark.createDataFrame([(d, "FOP"[k % 3]) for k, d in enumerate(days)], "o_orderdate timestamp, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    folder = str(tmp_path)
    assert QUERIES["platform_metrics"](spark, folder).first().latest_run == days[-1].date()
    assert {r.ts for r in QUERIES["regression_alerts"](spark, folder).collect()} == {d.date() for d in days}
    assert sum(r.fired for r in QUERIES["rule_attribution"](spark, folder).collect()) == sum(k % 4 == 0 and k < 40 for k in range(1, 41))
    for name in ("platform_metrics", "regression_alerts", "rule_attribution"):
        assert oracle.difference(QUERIES[name], SQL[name], spark, folder) == "", name


def test_queries_take_all_rows(spark, tmp_path):
    folder = str(tmp_path)
    texts = [(k, "word " * 50 * k, 250 * k) for k in range(1, 13)]
    spark.createDataFrame(texts, "doc_id long, text string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k,) for k in range(97)], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, "one line"), (2, "first\nsecond")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    lines = [(k, line, "RN"[k % 2], float(line)) for k in range(4) for line in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    got = {name: QUERIES[name](spark, folder).collect() for name in ("abstract_rebuild", "alias_join", "captions", "spec_agreement")}
    assert {r.id: r.abstract for r in got["abstract_rebuild"]} == {k: t for k, t, _ in texts}
    assert {r.id: r.run for r in got["alias_join"]} == {k: f"run {k}" for k, *_ in texts}
    assert {(r.paper, r.caption) for r in got["captions"]} == {(1, "one line"), (2, "first")}
    assert sorted((r.id, r.line) for r in got["spec_agreement"]) == [(k, line) for k, line, *_ in lines]
    for name in got:
        assert oracle.difference(QUERIES[name], SQL[name], spark, folder) == "", name


def test_confidence_set_has_all_models_and_draws(spark):
    import inspect

    from quillon.operators import models
    from quillon.plans.estimators import MODELS

    rows = QUERIES["model_confidence_set"](spark, FOLDER).collect()
    assert {r.model for r in rows} == {m for m, *_ in MODELS}
    assert inspect.signature(models.confidence_sets).parameters["draws"].default == 5000


def test_archive_numbers_of_more_than_five_digits(spark, tmp_path):
    keys = [*range(12), 99999, 100001, 100003, 123457, 1000001, 1234567]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert oracle.difference(QUERIES["implementations"], SQL["implementations"], spark, str(tmp_path)) == ""


def test_windows_keep_their_digits_after_large_values(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=7 * k), "ab"[k % 2], 1e9 + k * 37 % 101 if k < 40 else k * k % 97 + k % 7 / 100, f'{{"k": {k * 31 % 89}}}') for k in range(13000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert oracle.difference(QUERIES["event_regressions"], SQL["event_regressions"], spark, str(tmp_path)) == ""


def test_windows_of_equal_or_missing_numbers_are_those_of_sql(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)

    def row(k):
        part = k // 150  # the hour stays in parts 2 and 14, k in part 4 and the value in part 12; k is missing in part 6 and now and then in later ones
        hour = None if k % 17 == 5 and part > 8 else start + datetime.timedelta(minutes=0 if part in (2, 14) else 23 * k)
        props = None if part == 6 or k % 11 == 3 and part > 8 else f'{{"k": {7 if part == 4 else k * 31 % 89}}}'
        return k, hour, "ab"[k % 2], None if k % 13 == 1 and part > 15 else 5.0 if part == 12 else k * k % 97 + k % 7 / 100, props

    spark.createDataFrame([row(k) for k in range(2700)], "event_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert oracle.difference(QUERIES["event_regressions"], SQL["event_regressions"], spark, str(tmp_path)) == ""
    found = QUERIES["event_regressions"](spark, str(tmp_path)).collect()
    assert any(r.slope_k != r.slope_k for r in found) and any(r.t_k != r.t_k and r.slope_k == 0 for r in found) and any(r.slope_k is None for r in found)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_works_do_not_go_through_a_window(spark):
    from quillon.sources import views

    assert "Window" not in plan_of(views.works(spark, FOLDER))


def test_rows_are_split_without_a_function_for_each_token(spark):
    from pyspark.sql import functions as F

    from quillon.operators import scoring

    lines = [" a  b 1.50* (2.25) x ", "7 12 none ", "", None, "−3.0%", "t\t(1,234.5)†\n", "x 7%\x85"]
    df = spark.createDataFrame([(x,) for x in lines], "t string").select(scoring.split_row(F.col("t")).alias("r"))
    assert "lambda" not in plan_of(df)
    want = [("a b", ["1.50*", "(2.25)", "x"]), ("7 12 none", []), ("", []), (None, []), ("", ["−3.0%"]), ("t", ["(1,234.5)†"]), ("x", ["7%\x85"])]
    assert [tuple(r.r) for r in df.collect()] == want


def test_index_takes_its_words_from_their_source(spark, tmp_path):
    from quillon.operators import postings

    items = spark.createDataFrame([(1, "one", "A", "paper"), (2, "two", "B", "spec")], "id long, title string, status string, kind string")
    texts = spark.createDataFrame([(1, "one", "red fox", None), (1, "one", "red", None), (2, "two", "blue", "fox")], "id long, title string, method string, finding string")
    index = postings.build(items, f"file://{tmp_path}/index", source=texts)
    assert {r.word: list(r.ids) for r in index.postings(spark).collect()} == {"one": [1], "two": [2], "red": [1], "blue": [2], "fox": [1, 2]}


def test_indexes_of_texts_are_made_a_few_at_a_time():
    import pyarrow as pa

    from quillon.plans import catalogue

    got = list(catalogue.inverted([pa.record_batch({"id": pa.array(range(120), pa.int64()), "text": ["a b a"] * 120})]))
    assert [b.num_rows for b in got] == [50, 50, 20]
    assert got[0].column(1)[0].as_py() == [("a", [0, 2]), ("b", [1])]


def test_large_tables_are_dealt_to_more_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        plan = QUERIES["columns_by_position"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_NUM" not in QUERIES["columns_by_position"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_replicated_code_is_run_once(spark):
    from quillon.plans import shared

    before = len(shared._folders)
    QUERIES["replication"](spark, FOLDER)
    made = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in shared._folders[before:]]
    assert made.count("scores") == made.count("net") == made.count("panel") == 1
