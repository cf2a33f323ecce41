"""The pipeline's stages on messy rows, odd column names and an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketlake.llm.common import stored
from llm_fixtures import SMALL, make_docs, messy, nothing, shipped  # noqa: F401

ODD = {"Size": "1", "taken": "'x'", "a.b": "2", "c`d": "cast(null as string)"}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_and_rows(spark, messy, nothing, empty):
    """Nulls, ties, repeats, names with dots and of figures, no n_chars: columns stay, figures replace their names."""
    docs = (nothing if empty else messy).drop("n_chars", "size", "taken").withColumns({name: F.expr(value) for name, value in ODD.items()})
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stored(stage(spark, docs, SMALL), f"odd-{name}")
        if name != "mixing":
            assert docs.columns == names
            assert docs.count() == before if name == "secrets" else docs.count() <= before
    assert docs.columns == [n for n in names if n.lower() not in corpus_pipeline.FIGURES] + list(corpus_pipeline.FIGURES)
    assert docs.where("taken <= 0 or taken > 2 * size").count() == 0
