"""Detectors as models (§2.16), on pyspark.ml; each is trained and evaluated on different rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arrears.functions import patterns as P
from arrears.functions.text import explicit, lexical_confidence, matched
from arrears.operators.sampling import augment

FEATURES = 4096


def split(df: DataFrame, key: str, share: float = 0.7, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """M8: a lasting split by hash, so that no row is trained on and evaluated."""
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return df.where(h < int(1000 * share)), df.where(h >= int(1000 * share))


@dataclass
class Detector:
    """M1: a name and a pipeline of feature and model stages; rows have text and label."""

    name: str
    stages: list
    model: PipelineModel | None = None

    def train(self, rows: DataFrame) -> Detector:
        self.model = Pipeline(stages=self.stages).fit(weighted(rows))
        return self

    def detect(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).withColumn("is_satd", F.col("prediction") == 1)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Detector:
        self.model = PipelineModel.load(path)
        return self


def weighted(rows: DataFrame) -> DataFrame:
    """Balanced class weights."""
    counts = rows.groupBy("label").count()
    n = counts.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return rows.join(F.broadcast(counts.crossJoin(n)), "label").withColumn("weight", F.col("_n") / (F.col("_k") * F.col("count"))).drop("count", "_n", "_k")  # a row a class


def tf_idf(n: int) -> list:
    """Hashed 1- to n-grams, which need no vocabulary on the driver, with inverse document frequencies."""
    stages = [RegexTokenizer(inputCol="text", outputCol="w1", pattern="[^a-z]+", toLowercase=True)]
    stages += [NGram(n=i, inputCol="w1", outputCol=f"w{i}") for i in range(2, n + 1)]
    stages += [HashingTF(inputCol=f"w{i}", outputCol=f"f{i}", numFeatures=FEATURES) for i in range(1, n + 1)]
    return [*stages, VectorAssembler(inputCols=[f"f{i}" for i in range(1, n + 1)], outputCol="tf"), IDF(inputCol="tf", outputCol="features", minDocFreq=2)]


def logistic(n: int = 2) -> Detector:
    """M3's base model, and M6's fallback with n = 3."""
    return Detector(f"logistic_{n}", [*tf_idf(n), LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01)])


def forest(trees: int = 100) -> Detector:
    """M5's fallback."""
    return Detector("forest", [*tf_idf(1), RandomForestClassifier(weightCol="weight", numTrees=trees, seed=42)])


GRAPH_COLUMNS = ["nodes", "edges", "density", "degree_mean", "degree_max", "degree_std"]


def perceptron() -> Detector:
    """M4's fallback, over the word graph's features."""
    return Detector("perceptron", [VectorAssembler(inputCols=GRAPH_COLUMNS, outputCol="features"), MultilayerPerceptronClassifier(layers=[len(GRAPH_COLUMNS), 16, 2], seed=42, maxIter=100)])


def self_training(labelled: DataFrame, unlabelled: DataFrame, *, threshold: float = 0.7, rounds: int = 10) -> Detector:
    """M3: pseudo-labels at or over the threshold join the training rows until none is new."""
    from arrears.operators.components import Scratch

    scratch, base = Scratch(labelled.sparkSession), labelled.select("text", "label")
    model, before = logistic().train(base), -1
    for _ in range(rounds):
        sure = model.detect(unlabelled).select("text", F.col("prediction").alias("label"), F.array_max(vector(F.col("probability"))).alias("p"))
        sure = scratch.save(sure.where(F.col("p") >= threshold).select("text", "label"), "sure")
        n = sure.count()
        if n == before or not n:
            break
        before, model = n, logistic().train(base.union(sure))
    return model


def vector(c: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(c)


def lexical(rows: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """M2."""
    found = matched(F.col("text"), patterns or P.EXPLICIT_RE + P.IMPLICIT_RE)
    rows = rows.withColumn("matched", found).withColumn("is_satd", F.size("matched") > 0)
    return rows.withColumn("is_explicit", explicit(F.col("text"))).withColumn("confidence", F.when(F.col("is_satd"), lexical_confidence(F.size("matched"))).otherwise(0.0))


def augmented(rows: DataFrame) -> DataFrame:
    """The rows, and for positive ones two changed copies."""
    copies = [rows.where("label = 1").withColumn("text", augment(F.col("text"), F.col("text"), m)) for m in ("delete", "swap")]
    return rows.union(copies[0]).union(copies[1])


def word_graph(rows: DataFrame, key: str, text: str = "text", window: int = 3) -> DataFrame:
    """Features of each text's graph of words at most `window` places apart.

    A word that recurs within the window has a loop, which counts as an edge and twice in its degree, but not in clustering.
    Neighbouring words are always linked, so a text with words is one component. Triangles are found from edges that point
    to the end of higher degree, so that a frequent word does not pair all its neighbours.
    """
    part_of_word = r"[\p{L}\p{N}_]"
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"(?<!{part_of_word})([a-z]+)(?!{part_of_word})"), F.lit(1))
    words = rows.select(key, F.posexplode(found).alias("p", "w"))
    own = W.partitionBy(key).orderBy("p")
    later = F.array_distinct(F.array_compact(F.array(*[F.lead("w", d).over(own) for d in range(1, window + 1)])))
    pairs = words.select(key, F.col("w").alias("a"), later.alias("near")).select(key, "a", F.explode("near").alias("b"))
    pairs = pairs.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = pairs.select(key, F.explode(F.array("a", "b")).alias("w"), (F.col("a") == F.col("b")).cast("int").alias("loop"))
    degree = degree.groupBy(key, "w").agg(F.count(F.lit(1)).alias("degree"), (F.count(F.lit(1)) - F.sum("loop")).alias("others"))
    nodes = words.groupBy(key, "w").agg(F.count(F.lit(1)).alias("times")).join(degree, [key, "w"], "left")

    end = lambda c: degree.select(key, F.col("w").alias(c), F.struct("others", "w").alias(f"o_{c}"))
    plain = pairs.where("a <> b").join(end("a"), [key, "a"]).join(end("b"), [key, "b"])
    up = F.col("o_a") < F.col("o_b")
    arcs = plain.select(key, F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("o_b")).otherwise(F.col("o_a")).alias("t"))
    wedges = arcs.join(arcs.select(key, "s", F.col("t").alias("u")), [key, "s"]).where(F.col("t") < F.col("u"))
    wedges = wedges.select(key, F.col("s").alias("x"), F.col("t.w").alias("y"), F.col("u.w").alias("z"))
    closed = wedges.join(arcs.select(key, F.col("s").alias("y"), F.col("t.w").alias("z")), [key, "y", "z"])
    triangles = closed.select(key, F.explode(F.array("x", "y", "z")).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("triangles"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    local = F.when(zero("others") > 1, 2 * zero("triangles") / (F.col("others") * (F.col("others") - 1))).otherwise(0.0)
    out = nodes.join(triangles, [key, "w"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum(zero("degree")) / 2).cast("long").alias("edges"), F.avg(zero("degree")).alias("degree_mean"),
        F.max(zero("degree")).alias("degree_max"), F.stddev_pop(zero("degree")).alias("degree_std"), F.avg(local).alias("clustering"),
        F.lit(1).alias("components"), (F.count(F.lit(1)) / F.sum("times")).alias("coverage"),
    )
    n = F.col("nodes")
    return out.withColumn("clustering", F.when(n > 2, F.col("clustering")).otherwise(0.0)).withColumn("density", F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0))


REGISTRY = {"logistic": logistic, "prompt": lambda: logistic(3), "forest": forest, "perceptron": perceptron}
