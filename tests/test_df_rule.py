"""The rule of frequent words, where every word of a query is frequent."""

from compare import duck_rows, spark_rows

from ledgerloom.operators import retrieval
from ledgerloom.plans import catalog


def test_frequent_words_all_go(spark, tmp_path):
    rows = [(k // 3, k % 3, "user", "the and thing thble") for k in range(90)]  # events of turn 2 get another text
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    got = spark_rows(catalog.QUERIES["fts04_df_rule"](spark, str(tmp_path)))
    assert got == duck_rows(catalog.ORACLES["fts04_df_rule"], str(tmp_path)) == (["word"], [])
    event = spark.createDataFrame([(k, "the thing" if k < 3 else "the") for k in range(5)], "id long, text string")
    assert retrieval.df_rule(retrieval.postings(event), 1000, ["the", "thing"], 0.002) == ["thing"]
    assert retrieval.df_rule(retrieval.postings(event), 1000, ["the", "thing"], 0.002, keep_one=False) == []


def test_an_index_is_written_from_texts_tokenised_once(spark, tmp_path, monkeypatch):
    calls, made = [], retrieval.X.tokens
    monkeypatch.setattr(retrieval.X, "tokens", lambda text: calls.append(1) or made(text))
    event = spark.createDataFrame([(1, "the thing"), (2, None), (3, ""), (4, "Thing the the")], "id long, text string")
    retrieval.Index.write(event, f"file://{tmp_path}/index")
    assert len(calls) == 1 and not (tmp_path / "index" / "tokens" / "segment=0").exists()
    index = retrieval.Index.read(spark, f"file://{tmp_path}/index")
    assert sorted((r.id, r.len, r.pos, r.term) for r in index.postings.collect()) == [(1, 2, 0, "the"), (1, 2, 1, "thing"), (4, 3, 0, "thing"), (4, 3, 1, "the"), (4, 3, 2, "the")]
    assert tuple(index.totals.first()) == (4, 1.25) and {r.id for r in index.documents.collect()} == {1, 2, 3, 4}
