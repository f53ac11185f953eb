"""A trained scorer of title pairs: features in JVM expressions, a Spark ML network, fit, save and load.

A title's vector counts its folded words and their runs of three letters in HASHES slots, to unit length.
A pair's features are |a - b| and a * b of the two vectors, slot by slot, and what the rules
know of the pair: the likeness of words, conflicts and gaps of axes, words of one side only, numbers that only one side has.
The network has one hidden layer of HIDDEN, and its probability counts from THRESHOLD on.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.identity import axes, conflicts, gaps
from shelfwise.functions.similarity import title_words, words_score
from shelfwise.functions.text import fold

HASHES, HIDDEN, THRESHOLD = 64, 128, 0.8
#: Labelled pairs that are learned from, at most; steps of the fit.
SAMPLE_PAIRS, STEPS = 20_000, 60
#: What shops add to a title, and nothing of what a thing is.
NOISE = ("3D Yazıcı", "3D Printer", "Stoktan", "Orijinal")


def surface(title: Column) -> Column:
    """Ways to write one title: capitals, folded, dashes for blanks, words in another order, words of shops about it."""
    words = F.split(title, " ")
    return F.array(
        F.upper(title), fold(title), F.replace(title, F.lit(" "), F.lit("-")), F.concat_ws(" ", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), words[0]),
        *[F.concat_ws(" ", title, F.lit(n)) for n in NOISE], F.concat_ws(" ", F.lit(NOISE[2]), fold(title), F.lit(NOISE[0])),
    )


def labelled(titles: DataFrame, key: str, title: str, group: str, identity: str, noise: Column | None = None) -> DataFrame:
    """a, b, label (1.0 same, 0.0 different): balanced, as many pairs of each kind as there are rows with a neighbour.

    Same: a title and another way to write it. Different: a title and the next identity of its group, by
    a hash of the key, so no group is joined with itself and a hot group gives two pairs a
    row. noise: what both titles of a row's pairs say besides. Rows without a title are left out.
    """
    more = F.lit("") if noise is None else F.coalesce(noise, F.lit(""))
    rows = titles.where(F.col(title).isNotNull()).select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(group).alias("g"), F.col(identity).alias("i"), more.alias("n"), F.xxhash64(key, F.lit(7)).alias("h"))
    said = lambda c: F.trim(F.concat_ws(" ", c, "n"))
    # one row for each identity of a group; of these the next one is another
    each = rows.groupBy("g", "i").agg(F.min_by(F.struct("k", "t", "h"), F.struct("h", "k")).alias("r")).select("g", "i", "r.*")
    ring = Window.partitionBy("g").orderBy("h", "k")
    other = each.withColumn("other", F.lead("t").over(ring)).where("other is not null").select("g", "i", "other")
    ways = surface(F.col("t"))
    same = rows.select("k", said("t").alias("a"), said(F.get(ways, F.pmod(F.col("h"), F.size(ways)).cast("int"))).alias("b"), F.lit(1.0).alias("label"))
    odd = F.get(surface(F.col("other")), F.pmod(F.col("h"), F.size(ways)).cast("int"))
    different = rows.join(other, ["g", "i"]).select("k", said("t").alias("a"), said(odd).alias("b"), F.lit(0.0).alias("label"))
    return same.unionByName(different).where(fold(F.col("a")) != "")


def _terms(title: Column) -> Column:
    """The words of a title and their runs of three letters."""
    words = F.filter(F.split(fold(title), " "), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, 3))
    return F.concat(words, F.flatten(F.transform(words, runs)))


def _facts(x: Column, y: Column) -> list[Column]:
    """What the rules know of a pair of sides (struct of words, axes and folded)."""
    words = lambda s: F.filter(F.split(s["folded"], " "), lambda w: w != "")
    numbers = lambda s: F.filter(words(s), lambda w: w.rlike("[0-9]"))
    alone = lambda p, q: F.size(F.array_except(p, q)).cast("double")
    return [
        words_score(x["words"], y["words"]), F.size(conflicts(x["axes"], y["axes"])).cast("double"), F.size(gaps(x["axes"], y["axes"])).cast("double"),
        alone(words(x), words(y)), alone(words(y), words(x)), alone(numbers(x), numbers(y)) + alone(numbers(y), numbers(x)), (x["folded"] == y["folded"]).cast("double"),
    ]


def with_features(pairs: DataFrame, a: str = "a", b: str = "b", kind: Column | None = None) -> DataFrame:
    """pairs with a vector features. Every different title is made into a vector once."""
    kind = F.lit("printer") if kind is None else kind
    titles = pairs.select(F.col(a).alias("t")).unionByName(pairs.select(F.col(b).alias("t"))).distinct()
    counted = HashingTF(numFeatures=HASHES, inputCol="terms", outputCol="counts").transform(titles.where("t is not null").withColumn("terms", _terms(F.col("t"))))
    unit = Normalizer(inputCol="counts", outputCol="unit").transform(counted)
    made = unit.select("t", F.struct(vector_to_array("unit").alias("v"), title_words(F.col("t")).alias("words"), axes(F.col("t"), kind).alias("axes"), fold(F.col("t")).alias("folded")).alias("side"))
    sides = pairs.join(made.select(F.col("t").alias(a), F.col("side").alias("_x")), a).join(made.select(F.col("t").alias(b), F.col("side").alias("_y")), b)
    x, y = F.col("_x"), F.col("_y")
    far = F.zip_with(x["v"], y["v"], lambda p, q: F.abs(p - q))
    near = F.zip_with(x["v"], y["v"], lambda p, q: p * q)
    return sides.withColumn("features", array_to_vector(F.concat(far, near, F.array(*_facts(x, y))))).drop("_x", "_y")


def held_out(a: Column, b: Column) -> Column:
    """Pairs that are not learned from: one title in five."""
    return F.crc32(F.coalesce(a, F.lit("")).cast("binary")) % 5 == 0


def fit(pairs: DataFrame, sample_pairs: int = SAMPLE_PAIRS, hidden: int = HIDDEN, steps: int = STEPS) -> PipelineModel:
    """A model of labelled pairs (a, b, label); of more than sample_pairs those of the least hashes are learned from."""
    chosen = pairs.orderBy(F.xxhash64("a", "b", "label"), "a", "b").limit(sample_pairs)
    ready = with_features(chosen).select("features", "label")
    width = 2 * HASHES + 7
    network = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[width, hidden, 2], maxIter=steps, seed=7, blockSize=256)
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), network]).fit(ready)


def scored(pairs: DataFrame, model: PipelineModel, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with probability: how sure the model is that both titles are of one thing."""
    out = model.transform(with_features(pairs, a, b))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction").withColumnRenamed("p", "probability")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
