"""Registered training-data queries against their SQL twins, and the pipeline stage by stage."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from basketlake.llm import queries
from basketlake.llm.common import stored
from llm_fixtures import SMALL, shipped  # noqa: F401


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def comparable(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "null"
        return repr(float(value)) if isinstance(value, (int, float)) else str(value)
    return sorted([cell(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, duck, name, capsys):
    frame = queries.QUERIES[name](spark, SMALL)
    capsys.readouterr()
    frame.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in ("op1_mixing", "op8_licenses"):
        assert "Python" not in plan and "Arrow" not in plan
    result = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert comparable(frame.collect(), frame.columns) == comparable(result.fetchall(), names)


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_point.queries())


def test_pipeline_stages(spark):
    """Each stage keeps the columns and does to its own input what its operator says."""
    docs = queries.table(spark, SMALL, "documents")
    names = docs.columns
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, SMALL, "labels").collect()}
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        outputs[name] = (before, after)
        if name != "mixing":
            assert docs.columns == names
    before, after = outputs["quality"]
    marked = [i for i in ids if i in labels]
    assert sum((i in after) != bool(labels[i]) for i in marked) <= 0.05 * len(marked)
    before, after = outputs["near_duplicates"]
    assert len(after) < len(before) and len(set(after.values())) == len(after)
    before, after = outputs["decontamination"]
    bench = queries.table(spark, SMALL, "benchmark")
    left = spark.createDataFrame([(i, t) for i, t in after.items()], "doc_id long, text string")
    assert not queries.contamination_digest(left, bench).where("contaminated").count()
    assert all(before[i] == after[i] for i in after)
    before, after = outputs["secrets"]
    assert set(before) == set(after)
    assert docs.where(F.col("taken") <= 0).count() == 0 and docs.where("taken > 2 * size").count() == 0
