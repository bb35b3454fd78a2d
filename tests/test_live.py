"""Keyed state, interval joins, the bucketed table, the paged stream and the inverted index: late rows, restarts, retries, files."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import panel, postings, ranking, scoring
from quillon.sources import paged, upserts
from quillon.streaming import live

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2020, 1, 1)


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, base):
    q = stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


TICK = "asset string, date timestamp, close double"


def test_carried_prices_with_late_rows_missing_dates_and_a_restart(spark, tmp_path):
    """Dates without a row, rows out of order and too late ones; the stream stops after each file and goes on."""
    r = random.Random(1)
    dates = [START + k * DAY for k in range(40) if k not in (7, 8, 21)]
    full = [(a, d, None if r.random() < (0.6 if a != "c" else 1.0) else round(r.random(), 3)) for a in "abc" for d in dates]
    full += [("a", dates[-1] + 30 * DAY, None)]
    folder, base = tmp_path / "in", tmp_path / "out"
    late = [("a", dates[3], 99.0), ("b", dates[2], None)]
    for k in range(4):
        part = [x for x in full[:-1] if dates.index(x[1]) // 10 == k]
        r.shuffle(part)
        write(spark, part, TICK, folder)
        if k == 2:
            write(spark, late, TICK, folder)  # after the watermark: dropped
        run(live.carried(spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(folder))), base)
    write(spark, full[-1:], TICK, folder)
    run(live.carried(spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(folder))), base)
    got = [(x.asset, x.time, x.value) for x in spark.read.parquet(f"{base}/data").collect() if x.time < dates[-1] + DAY]
    want = {}
    for a in "abc":
        value, age = None, 0
        for x in sorted(y for y in full[:-1] if y[0] == a):
            value, age = (x[2], 0) if x[2] is not None else (value, age + 1)
            value = value if age <= panel.FILL_LIMIT else None
            want[a, x[1]] = value
    assert len(got) == len(want)  # every row once, over all restarts
    assert {(a, t): v for a, t, v in got} == want


def test_rows_of_one_date_are_one_row(spark, tmp_path):
    rows = [("a", START, None), ("a", START, 5.0), ("a", START, None), ("a", START + DAY, None), ("a", START + 60 * DAY, None)]
    write(spark, rows[:-1], TICK, tmp_path / "in")
    write(spark, rows[-1:], TICK, tmp_path / "in")
    run(live.carried(spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), tmp_path / "out")
    got = {x.time: x.value for x in spark.read.parquet(f"{tmp_path}/out/data").collect()}
    assert (got[START], got[START + DAY]) == (5.0, 5.0)


def test_interval_join_equals_the_batch_operator(spark, tmp_path):
    r = random.Random(2)
    log = [(START + k * DAY, float(r.randint(0, 50)) if r.random() < 0.9 else None) for k in range(200) if r.random() < 0.8]
    changes = [(START + r.randint(1, 195) * DAY, f"critique:r{r.randint(0, 2)}") for _ in range(60)]
    changes = sorted(set(changes))
    for name, rows, schema in (("log", log, "ts timestamp, loss double"), ("changes", changes, "ts timestamp, message string")):
        for k in range(3):
            write(spark, [x for x in rows if (x[0] - START).days // 67 == k], schema, tmp_path / name)
        write(spark, [(START + 900 * DAY, None)], schema, tmp_path / name)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    sides = read("changes", "ts timestamp, message string").select("ts", live.refs(F.coalesce("message", F.lit("critique:none"))).alias("ref")), read("log", "ts timestamp, loss double")
    run(live.around(*sides, 30, 30, "2 days"), tmp_path / "out")
    met = spark.read.parquet(f"{tmp_path}/out/data").filter("ref <> 'none'")
    got = {x.ref: (x.fired, x.mean_delta, x.verdict) for x in live.attributed(met).collect()}
    frame = spark.createDataFrame(log, "ts timestamp, asymmetric_loss double").filter("asymmetric_loss is not null")
    want = {x.ref: (x.fired, x.mean_delta, x.verdict) for x in scoring.attribute(spark.createDataFrame(changes, "ts timestamp, message string"), frame).collect()}
    assert got == want and len(got) == 3


ROW = "id long, t long, v string"


def table(spark, folder, buckets=8):
    return upserts.BucketedTable(spark, str(folder), ["id"], "t", buckets)


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    t = table(spark, f"file://{tmp_path}/t")
    first = [(k, 1, f"a{k}") for k in range(200)]
    assert len(t.upsert(spark.createDataFrame(first, ROW))) == 8
    before = files(tmp_path)
    touched = t.upsert(spark.createDataFrame([(3, 2, "new"), (3, 5, "newest"), (3, 0, "old"), (900, 1, "added")], ROW))
    assert 1 <= len(touched) <= 2
    after = files(tmp_path)
    assert before.items() <= after.items()  # nothing that was there was written again
    added = set(after) - set(before)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in added} == set(touched)
    plan = t.read(touched)._jdf.queryExecution().toString()
    assert plan.count("bucket=") == 0 or all(f"bucket={b}" not in plan for b in range(8) if b not in touched)
    read = {f.split("bucket=")[1].split("/")[0] for f in t.read(touched).inputFiles()}
    assert read == {str(b) for b in touched}
    want = {k: (1, f"a{k}") for k in range(200)} | {3: (5, "newest"), 900: (1, "added")}
    assert {x.id: (x.t, x.v) for x in t.read().collect()} == want
    gone = t.vacuum()
    assert {x.id: (x.t, x.v) for x in t.read().collect()} == want and isinstance(gone, list)
    assert len(files(tmp_path)) < len(after)
    assert {x.id for x in t.lookup(spark.createDataFrame([(3,), (77,), (12345,)], "id long")).collect()} == {3, 77}


def test_upsert_is_safe_on_retry_and_between_writers(spark, tmp_path):
    t = table(spark, f"file://{tmp_path}/t")
    batch = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], ROW)
    assert t.upsert(batch, ("s", 0)) and t.upsert(batch, ("s", 0)) == []
    assert t.manifest()["number"] == 1
    other, publish = table(spark, f"file://{tmp_path}/t"), t._publish

    def interrupted(manifest):
        raise RuntimeError("lost before the manifest")

    t._publish = interrupted
    with pytest.raises(RuntimeError):
        t.upsert(spark.createDataFrame([(1, 9, "half")], ROW), ("s", 1))
    assert {x.v for x in other.read().collect()} == {"x", "y"}  # what was half written is not seen
    t._publish = lambda m: (other.upsert(spark.createDataFrame([(2, 3, "first")], ROW)), publish(m))
    with pytest.raises(upserts.ConcurrentCommit):
        t.upsert(spark.createDataFrame([(1, 9, "second")], ROW), ("s", 1))
    t._publish = publish
    t.upsert(spark.createDataFrame([(1, 9, "second")], ROW), ("s", 1))
    assert {(x.id, x.v) for x in t.read().collect()} == {(1, "second"), (2, "first")}


def test_upsert_of_new_columns_null_keys_and_nothing(spark, tmp_path):
    t = table(spark, f"file://{tmp_path}/t")
    assert t.upsert(spark.createDataFrame([], ROW)) == []
    t.upsert(spark.createDataFrame([(None, 1, "n"), (1, None, "no order")], ROW))
    t.upsert(spark.createDataFrame([(None, 2, "m", 7), (1, 1, "ordered", 8)], ROW + ", extra int"))
    assert {(x.id, x.v, x.extra) for x in t.read().collect()} == {(None, "m", 7), (1, "ordered", 8)}
    with pytest.raises(ValueError):
        table(spark, f"file://{tmp_path}/none").read()


def test_windows_are_cut_at_fixed_places():
    w = paged.windows(["q", "r"], "2024-01-03", "2024-01-20", 7)
    assert [(x.query, x.since, x.until) for x in w if x.query == "q"] == [("q", "2024-01-03", "2024-01-04"), ("q", "2024-01-04", "2024-01-11"), ("q", "2024-01-11", "2024-01-18"), ("q", "2024-01-18", "2024-01-20")]
    assert len(w) == 8 and paged.windows(["q"], "2024-01-03", "2024-01-03") == []
    loop = lambda q, a, b, c: {"results": ["x"], "next_cursor": "1"}
    assert list(paged.chain(loop, w[0])) == [("q", "x"), ("q", "x")]


def test_a_stopped_feed_goes_on_without_loss_or_repeats(spark, tmp_path):
    days = [(datetime.date(2024, 1, 1) + k * DAY).isoformat() for k in range(40)]
    rows = [(q, d, n, f"{q}-{n}") for q in ("a", "b", "none here") for n, d in enumerate(d for d in days for _ in range(9)) if q != "none here"]
    spark.createDataFrame(rows, "query string, day string, key long, record string").repartition(3).write.parquet(f"{tmp_path}/list")
    fetch, flag = paged.listing(f"file://{tmp_path}/list", page=5), tmp_path / "fail"

    def flaky(query, since, until, cursor):
        if cursor != "*" and since >= "2024-01-18" and flag.exists():
            raise OSError("the feed is down")
        return fetch(query, since, until, cursor)

    def read_until(until):
        spark.dataSource.register(paged.feed(flaky, lambda: until, name="flaky_feed"))
        return run(spark.readStream.format("flaky_feed").option("queries", "a\nb\nnone here").option("since", "2024-01-01").load(), tmp_path)

    read_until("2024-01-10")
    assert spark.read.parquet(f"{tmp_path}/data").count() == 2 * 9 * 9
    read_until("2024-01-10")  # nothing new
    flag.touch()
    with pytest.raises(Exception, match="feed is down"):
        read_until("2024-02-10")
    flag.unlink()
    read_until("2024-02-10")
    got = sorted((x.query, x.record) for x in spark.read.schema("query string, record string").parquet(f"{tmp_path}/data").collect())
    assert got == sorted((q, r) for q, _, _, r in rows)
    batch = spark.read.format("flaky_feed").option("queries", "a").option("since", "2024-01-05").load()
    assert batch.count() == 36 * 9 and batch.rdd.getNumPartitions() == 6


def test_gallop():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 300))) for _ in range(2))
        assert postings.gallop(a, b).tolist() == np.intersect1d(a, b).tolist()


def test_index_equals_the_scan_and_reads_little(spark, tmp_path):
    r = random.Random(4)
    syllables = ["ka", "lo", "mi", "ner", "tu", "é", "x-1", "_", "Zed"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    text = lambda n: r.choice([" ", "\n", "\t "]).join(word() for _ in range(n))
    rows = [(k * 700, text(3), None if k % 9 == 0 else text(r.randint(0, 300)), text(4), r.choice(["VERIFIED", "ATTEMPTED"]), r.choice(["paper", "spec"])) for k in range(400)]
    rows += [(None, "ka", "lo", "mi", "VERIFIED", "paper")]
    items = spark.createDataFrame(rows, "id long, title string, method string, finding string, status string, kind string")
    index = postings.build(items.filter("id is not null"), f"file://{tmp_path}/index", buckets=16)
    queries = ["", "ka", "ka lo", "nertu mi ka", "É", "x-1", "_ zed", "kakaka lolo", "nothing", "KAlo mi ka ka", "a"]
    for words in queries:
        for status, kind in (("", ""), ("verified", "Paper")):
            want = [x.id for x in ranking.search(items.filter("id is not null"), words, status, kind, 50).collect()]
            assert [x.id for x in postings.search(spark, index, words, status, kind, 50).collect()] == want, words
    rare = index.words(spark).orderBy("n", "word").first()["word"]
    hits = index.postings(spark).filter((F.col("word") == rare) & (F.col("bucket") == postings.bucket_of(F.lit(rare), 16)))
    size = lambda fs: sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in fs)
    touched = {x[0] for x in hits.select(F.input_file_name()).distinct().collect()}
    assert size(touched) < size(index.postings(spark).inputFiles()) / 4
