"""Registered queries against SQL, and the pipeline's stages against their contracts."""

import pytest
from compare import duck_rows, spark_rows
from frames import docs, odd_rows, prose, rows

import corpus_pipeline
from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(queries.oracle_sql()[name], SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_runs_and_all_but_the_last_stage_keep_the_columns(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    df = source
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        if name == "packing":
            assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
        else:
            assert out.columns == source.columns and out.dtypes == source.dtypes
        assert 0 < out.count()
        df = out


def test_one_of_each_group_stays_and_secrets_are_masked(spark):
    same = prose(50, 1)
    df = docs(spark, [(3, same), (1, same), (2, prose(50, 2)), (2, prose(50, 2)), (None, same), (4, None)])
    left = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert [r[0] for r in rows(left.select("doc_id"))] == [1, 2, 4, None]
    masked = corpus_pipeline.mask_secrets(spark, docs(spark, [(1, "password=abcdefgh x")]), SF).first()
    assert masked.text == "[redacted] x" and masked.n_chars == 12


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF).collect() == []
    assert corpus_pipeline.drop_near_copies(spark, docs(spark, odd_rows()), SF).count() == 7


def test_rows_of_one_document_and_odd_columns(spark):
    from pyspark.sql import functions as F

    df = docs(spark, [(1, "b " * 30), (1, "a " * 30), (2, None), (2, "x"), (None, "y")]).withColumn("k", F.lit(5)).withColumn("row", F.lit("r"))
    left = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert rows(left.select("doc_id", "text")) == sorted([(1, "a " * 30), (2, None), (None, "y")], key=repr) and left.columns == df.columns
    dotted = corpus_pipeline.mask_secrets(spark, df.withColumn("a.b", F.lit(3)), SF)
    assert dotted.columns == [*df.columns, "a.b"] and {r[0] for r in dotted.select("`a.b`").collect()} == {3}
    masked = corpus_pipeline.mask_secrets(spark, df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("spans", F.lit(1)), SF)
    assert masked.count() == 5 and masked.columns == [*df.columns, "m", "spans"]
