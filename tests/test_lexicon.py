"""Words that no dictionary knows."""

from proofloom.operators import lexicon as L

from .conftest import rows


def test_unknown_words_reads_the_words_once(spark, tmp_path):
    used = [(1, "tree"), (1, "qux"), (2, "qux"), (2, "qux"), (3, "zap"), (4, None), (5, "oak"), (6, "")]
    spark.createDataFrame(used, "screen long, word string").write.parquet(f"{tmp_path}/used")
    words = spark.read.parquet(f"{tmp_path}/used")
    lexicon = spark.createDataFrame([("tree",), ("tree",), (None,)], "word string")
    ignore = spark.createDataFrame([("zap",), ("oak",)], "word string")
    got = L.unknown_words(words, lexicon, ignore)
    assert got.columns == ["word", "screen"]
    assert rows(got, "screen", "word") == [(1, "qux"), (2, "qux"), (2, "qux"), (6, "")]
    assert rows(L.unknown_words(words, lexicon), "screen", "word") == [(1, "qux"), (2, "qux"), (2, "qux"), (3, "zap"), (5, "oak"), (6, "")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [screen") == 1
    assert rows(L.unknown_word_report(got, "screen")) == [("", 1, "6"), ("qux", 2, "1; 2")]
