"""Each operator on messy and on empty tables: no crash, one row per row, defined values."""

import pytest
from pyspark.sql import functions as F

from basketlake.llm import ann, decontam, langid, licenses, mixing, neardup, quality, secret_scan, toxicity, warc
from llm_fixtures import make_docs, messy, nothing, shipped  # noqa: F401


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta"), (None, "gamma delta"), (2, None), (2, ""), (2, "alpha beta")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, None, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")


def per_row(spark, benchmark, labels):
    return {
        "mixing": mixing.mixed,
        "language": langid.identify,
        "decontamination": lambda d: decontam.contamination_digest(d, benchmark),
        "secrets": secret_scan.secret_spans,
        "near_duplicates": neardup.near_duplicates,
        "quality": quality.quality,
        "licenses": licenses.license_scan,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
    }


NAMES = ["mixing", "language", "decontamination", "secrets", "near_duplicates", "quality", "licenses", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_messy_rows_all_come_back(spark, messy, benchmark, labels, name):
    rows = per_row(spark, benchmark, labels)[name](messy).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in messy.select("doc_id").collect())
    by_id = {r["doc_id"]: r for r in rows}
    if name == "mixing":
        assert by_id[2]["size"] == by_id[3]["size"] == by_id[4]["taken"] == 0 and by_id[8]["size"] == 20_001
    if name == "language":
        assert by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == by_id[9]["lang_pred"] == "und" and by_id[9]["score"] == 0
    if name == "decontamination":
        assert by_id[2]["n_words"] == 0 and not by_id[2]["contaminated"]
    if name == "near_duplicates":
        assert by_id[5]["component_id"] == by_id[6]["component_id"] == 5 and by_id[None]["component_id"] is None and by_id[None]["kept"]
        assert by_id[3]["n_shingles"] == 0 and by_id[3]["component_id"] == 3 and not by_id[6]["kept"]
    if name == "quality":
        assert not by_id[2]["kept"] and not by_id[4]["kept"] and by_id[2]["score"] == 0


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, nothing, benchmark, labels, name):
    assert per_row(spark, benchmark, labels)[name](nothing).count() == 0


@pytest.mark.parametrize("name", ["decontamination", "toxicity"])
def test_empty_side_tables(spark, messy, benchmark, labels, name):
    rows = per_row(spark, benchmark.limit(0), labels.limit(0))[name](messy).collect()
    assert len(rows) == messy.count()
    if name == "decontamination":
        assert not any(r["contaminated"] for r in rows)


def test_filters_keep_all_columns(spark, messy, benchmark):
    for out in (quality.kept_documents(messy), neardup.deduplicated(messy), decontam.decontaminated(messy, benchmark),
                decontam.decontaminated(messy, benchmark, remove="spans"), secret_scan.masked(messy)):
        assert out.columns == messy.columns and out.schema["n_chars"].dataType == messy.schema["n_chars"].dataType
        out.collect()
    ids = [r["doc_id"] for r in neardup.deduplicated(messy).select("doc_id").collect()]
    assert ids.count(1) == 1 and 5 in ids and 6 not in ids and None in ids


def test_pages_and_vectors(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (20, [1.0, 0.0]), (5, [1.0, 0.0]),
            (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [1.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")))
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out.collect()}
    assert found == {(0, 1): (5, 1.0), (0, 2): (20, 1.0), (0, 3): (6, 0.5), (20, 1): (0, 1.0), (20, 2): (5, 1.0), (20, 3): (6, 0.5)}
