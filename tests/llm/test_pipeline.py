"""The pipeline's stages on the smallest tables, each judged on its own input."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline as p

from quillon.llm import decontaminate, jaccard_join

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in p.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights"]
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, FOLDER)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert 0 < docs.count() <= before
            before = docs.count()
        if name == "n-gram Jaccard join":
            assert jaccard_join.near_duplicates(docs).filter("n_links > 0 or (n_copies > 1)").count() == 0
        if name == "benchmark decontamination":
            assert decontaminate.find_leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0
    assert p.run(spark, FOLDER).count() == docs.count()
    assert p.ORACLE_SQL is None


def test_stages_take_odd_rows_and_columns(spark):
    prose = lambda k, n: " ".join(f"w{(k * 37 + j * j) % 9973}" for j in range(n))
    rows = [(k, prose(k, 80) + "\n" + prose(k + 1000, 20), "en", "s", 1, k, "x", 2) for k in range(30)]
    rows += [(None, prose(50, 90), None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (40, "", "en", "s", 0, 1, "", 0), (41, " \n ", "en", None, 3, 1, "", 0), rows[3], rows[3], (42, prose(7, 60000), "en", "t", 1, 1, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, runs string, kept int").repartition(3)
    for frame in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, frame, FOLDER)
            assert out.columns[: len(frame.columns)] == frame.columns, name
            assert out.count() <= 4 * docs.count()
    kept = p.STAGES[2][1](spark, docs, FOLDER)
    assert sum(r.doc_id == 3 for r in kept.collect()) == 1
    assert {r.doc_id for r in kept.collect()} >= {*range(30), 42}


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline the entry module still imports and has the other queries."""
    root = os.path.dirname(os.path.abspath(p.__file__))
    shutil.copytree(f"{root}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
