"""Names are sent to the titles, and a title is made ruled once."""

from pyspark.sql import functions as F

from shelfwise.functions import identity as I
from shelfwise.plans import titles
from shelfwise.sources.dictionary import dictionary


def test_the_dictionary_is_known_to_be_small(spark):
    assert int(dictionary(spark)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10_000_000


def test_a_title_is_ruled_once(spark):
    rows = spark.createDataFrame([("Siyah PLA",)], "title string")
    for made in (I.swatches(F.col("title")), I.product_type(F.col("title")), I.technology(F.col("title")), I.kit_form(F.col("title"))):
        assert rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("spoolless") <= 1


def test_titles_come_in_many_parts(spark):
    assert titles.titles(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
