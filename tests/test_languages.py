"""Languages told by letters and by whole words."""

from pyspark.sql import functions as F

from shelfwise.functions import text as T


def test_words_at_any_border(spark):
    cases = {"und": "de", "x und\n": "de", "UND!": "de", "_und": "en", "und_": "en", "under": "en", "und7": "en", "undund und": "de", "commit mit": "de", "filament": "tr", "filaments filamento": "es", "a-precio-b": "es", "\nfiyat\r\n": "tr", "": "en", "é und": "de"}
    d = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert d.where(T.detect_lang(F.col("t")) != F.col("want")).collect() == []


def test_a_text_is_lowered_once(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(T.detect_lang(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
