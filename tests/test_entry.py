"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from millrace import queries as engine
from millrace import queries_more as engine_more

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    return sorted([str([row[c] for c in sorted(row)]) for row in df])


@pytest.mark.parametrize("name", [n for n in engine.QUERIES if n in engine.ORACLES])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = engine.QUERIES[name](spark, SF).toArrow().to_pylist()
    want = con.sql(engine.ORACLES[name]).to_arrow_table().to_pylist()
    assert plain(got) == plain(want)


@pytest.mark.parametrize(
    "first, second, score",
    [
        ([1.0, 0.0], [0.0012355 - 2e-10, (1 - (0.0012355 - 2e-10) ** 2) ** 0.5], 0.001235),  # below the half of the sixth place, on it once it is rounded at nine
        ([1.0] * 256, [1.0] * 129 + [-1.0] * 127, 0.007813),  # 2 / 256, the half itself
        ([1.0] * 256, [1.0] * 127 + [-1.0] * 129, -0.007813),
    ],
)
def test_index_scores_are_rounded_once(spark, tmp_path, first, second, score):
    spark.createDataFrame([(0, first), (1, second)], "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = engine_more.index_search(spark, f"file://{tmp_path}").toArrow().to_pylist()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert plain(got) == plain(con.sql(engine_more.ORACLES["index_search"]).to_arrow_table().to_pylist())
    assert {r["score"] for r in got if r["query_id"] != r["doc_id"]} == {score}


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_import_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(driver.__file__)
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


@pytest.mark.skipif(not os.path.exists(f"{os.path.dirname(driver.__file__)}/corpus_pipeline.py"), reason="the training-data operators aren't here")
@pytest.mark.parametrize("lacking", ["xxhash", "zstandard", "regex", "millrace.llm.mixing"])
def test_import_where_a_package_of_theirs_is_missing(tmp_path, lacking):
    root = os.path.dirname(driver.__file__)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("__pycache__"))
    code = f"import sys; sys.modules[{lacking!r}] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
