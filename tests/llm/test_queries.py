"""Registered queries against their SQL, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from pixeltide.llm.queries import ORACLE, QUERIES

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_every_operator_has_a_query():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    wanted = duck.sql(ORACLE[name]).project(columns).fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(wanted, key=repr) != []


@pytest.mark.parametrize("name", ["op6_chat_examples", "op10_secret_scan"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in text for node in ("Python", "Arrow", "Pandas", "ExistingRDD"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_document(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if "doc_id" in df.columns and "piece" not in df.columns:
        assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_stages(spark, sf_dir, docs):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs([(10**6, None), (10**6 + 1, "12 34"), (10**6 + 2, "")]).select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")
    )
    now, counts = table.unionByName(extra.unionByName(extra)), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == list(corpus_pipeline.COLUMNS) == table.columns
        counts.append(now.count())
    assert counts[0] == table.count() and counts[0] > counts[1] > counts[2] == counts[3]
    assert now.select("doc_id").distinct().count() == counts[3]
    assert not any("AKIA" in r.text for r in now.select("text").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[3]
