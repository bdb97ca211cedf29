"""The pipeline's stages on rows that are hard to tell apart, and on columns that are called like the operators' own."""

import collections

import pytest
from pyspark.sql import functions as F

from vertexloom.llm import exact_dedup, langid, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: What the operators call their own columns.
OWN = "row doc _id _source _size _words _copies _copy _key _sha _rank _at _part _n _first _before all snull skey tie w rate goal words copies size target source_size taken sha cp held best n bucket hit same inv kept fp first root node key a b u v m keep_row component_id none least".split()
BASE = " ".join(f"w{i}" for i in range(300))
OTHER = " ".join(f"v{i}" for i in range(300))
STAGES = {"exact": exact_dedup.drop_copies, "near": simhash.one_of_each, "mix": mixing.mixed, "language": langid.identified}


def docs(spark, rows, named=True):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in OWN}) if named else df


def ids(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_columns_may_be_called_anything(spark, name):
    rows = [(i, f"{BASE if i % 2 else OTHER} number {i // 4}", "s" if i % 3 else None) for i in range(40)] + [(None, None, None), (7, "", "s")]
    plain, named = STAGES[name](docs(spark, rows, named=False)), STAGES[name](docs(spark, rows))
    assert named.columns == docs(spark, rows).columns and named.dtypes == docs(spark, rows).dtypes
    assert ids(plain) == ids(named) and all(r.row == "own row" and r.least == "own least" for r in named.collect())


def test_a_doc_id_on_rows_of_several_texts_loses_none(spark):
    rows = [(3, BASE, "a"), (9, BASE + " end", "a"), (9, OTHER, "a")]
    assert ids(simhash.one_of_each(docs(spark, rows))) == {(3, BASE): 1, (9, OTHER): 1}
    rows = [(1, "same text", "a"), (1, "another text", "a"), (2, "same  text", "b"), (2, "a third", "b"), (2, "a third", "b")]
    assert ids(exact_dedup.drop_copies(docs(spark, rows))) == {(1, "another text"): 1, (2, "same  text"): 1, (2, "a third"): 1}


def test_null_ids_are_rows_like_others(spark):
    rows = [(None, BASE, "a"), (None, BASE, "a"), (None, OTHER, "a"), (4, OTHER, "a")]
    assert ids(simhash.one_of_each(docs(spark, rows))) == {(None, BASE): 1, (4, OTHER): 1}
    assert ids(exact_dedup.drop_copies(docs(spark, rows))) == {(None, BASE): 1, (4, OTHER): 1}


def test_the_mix_takes_repeated_rows_as_often_as_it_says(spark):
    rows = [(5, "a b c", "x")] * 40 + [(i, "a b c d", "y") for i in range(200)] + [(i, "a b", "z") for i in range(300)]
    said = mixing.mix(docs(spark, rows)).agg(F.sum("taken")).first()[0]
    got = mixing.mixed(docs(spark, rows)).agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert said == got


def test_a_large_document_does_not_throw_a_source_off(spark):
    rows = [(0, "w " * 900, "x")] + [(i, "w " * (1 + i % 9), "x") for i in range(1, 400)] + [(i, "w " * 7, "y") for i in range(1000, 1400)]
    by = mixing.mix(docs(spark, rows)).groupBy("source").agg(F.sum("taken").alias("got"), F.first("target").alias("goal")).collect()
    assert all(abs(r.got - r.goal) <= 0.03 * r.goal for r in by)
