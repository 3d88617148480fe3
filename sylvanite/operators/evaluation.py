"""From feature sets to learning: sparse rows, selection, subsets, linear machines and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import explode_vertices
from ._session import numbered


def frequent_pairs(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(graph_id, feature) whose feature is listed."""
    return pairs.join(features.select("feature").distinct(), "feature", "left_semi")


def svm_rows(pairs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(graph_id, label, features array<struct<index, value>>) of (graph_id, feature); with targets, graphs of target 0 go."""
    pair = F.struct(F.col("feature").cast("int").alias("index"), F.lit(1.0).alias("value"))
    rows = pairs.distinct().groupBy("graph_id").agg(F.sort_array(F.collect_list(pair)).alias("features"))
    if targets is None:
        return rows.select("graph_id", F.lit(0.0).alias("label"), "features")
    return rows.join(targets.where("activity <> 0"), "graph_id").select("graph_id", F.col("activity").cast("double").alias("label"), "features")


def changed_label(how: str, column: str = "activity") -> Column:
    """Two classes of three: AvsI: 2 against 0, 1 goes (null); AvsMI: 2 against 0 and 1; AMvsI: 1 and 2 against 0."""
    t = F.col(column)
    return {"AvsI": F.when(t == 2, 1).when(t == 0, -1), "AvsMI": F.when(t == 2, 1).otherwise(-1), "AMvsI": F.when(t == 0, -1).otherwise(1)}[how]


def label_baseline(graphs: DataFrame, multiple: bool = False) -> DataFrame:
    """(graph_id, label, occurrences): each graph's vertex labels, with how often each stands there or with 1."""
    out = explode_vertices(graphs).groupBy("graph_id", "label").agg(F.count("*").alias("occurrences"))
    return out if multiple else out.withColumn("occurrences", F.lit(1).cast("long"))


def merged(a: DataFrame, b: DataFrame, key: str = "graph_id") -> DataFrame:
    """Feature rows side by side: indices of b follow the largest of a."""
    top = a.agg(F.coalesce(F.max(F.array_max(F.transform("features", lambda x: x["index"]))), F.lit(0)).alias("_top"))
    right = b.select(key, F.col("features").alias("_b")).join(F.broadcast(top))  # one row
    moved = F.transform("_b", lambda x: F.struct((x["index"] + F.col("_top")).cast("int").alias("index"), x["value"].alias("value")))
    return a.join(right, key).select(key, "label", F.concat("features", moved).alias("features"))


def chi_squared(rows: DataFrame) -> DataFrame:
    """(index, statistic): each feature's sums by class against those expected of the classes' shares."""
    total = rows.count()
    classes = rows.groupBy("label").agg((F.count("*") / F.lit(float(max(total, 1)))).alias("share"))
    flat = rows.select("label", F.explode("features").alias("f")).groupBy("label", F.col("f.index").alias("index")).agg(F.sum("f.value").alias("observed"))
    feature = flat.groupBy("index").agg(F.sum("observed").alias("all"), F.collect_list(F.struct("label", "observed")).alias("seen"))
    # classes are few: one short array on every row
    shares = classes.agg(F.collect_list(F.struct("label", "share")).alias("shares"))
    seen = lambda c: F.coalesce(F.get(F.transform(F.filter("seen", lambda s: s["label"] == c["label"]), lambda s: s["observed"]), F.lit(0)), F.lit(0.0))
    term = lambda c: F.pow(seen(c) - c["share"] * F.col("all"), 2) / (c["share"] * F.col("all"))
    return feature.join(F.broadcast(shares)).select("index", F.aggregate(F.transform("shares", term), F.lit(0.0), lambda a, b: a + b).alias("statistic"))


def top_features(rows: DataFrame, percent: float) -> DataFrame:
    """rows with only the given share of features (rounded up), those of the largest statistic, ties to the smaller index."""
    scored = chi_squared(rows).where("statistic is not null").withColumn("_order", F.struct((-F.col("statistic")).alias("s"), "index"))
    keep = -int(-scored.count() * percent // 100)
    best = numbered(scored, "_order", "_rank").where(F.col("_rank") < keep).select("index")
    flat = rows.select("graph_id", "label", F.explode_outer("features").alias("f")).join(best, F.col("f.index") == best["index"], "left").select("graph_id", "label", F.when(best["index"].isNotNull(), F.col("f")).alias("f"))
    return flat.groupBy("graph_id", "label").agg(F.sort_array(F.collect_list("f")).alias("features"))


def subset(rows: DataFrame, n: int, key: str = "graph_id", label: str | None = "label", seed: int = 0, complement: bool = False) -> DataFrame:
    """n rows drawn by a hash of the key, uniformly or (with a label) with every class's share rounded to the nearest; complement: the others."""
    c = F.col(label) if label else F.lit(0)
    placed = numbered(rows.withColumn("_order", F.struct(c.alias("c"), F.xxhash64(key, F.lit(seed)).alias("h"), F.col(key).alias("k"))), "_order", "_rank").drop("_order")
    sizes = placed.groupBy(c.alias("_class")).agg(F.count("*").alias("_size"), F.min("_rank").alias("_first"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    bounds = sizes.join(F.broadcast(total)).withColumn("_quota", F.round(F.lit(float(n)) * F.col("_size") / F.col("_total")))
    taken = placed.join(bounds, c.eqNullSafe(F.col("_class"))).withColumn("_in", F.col("_rank") - F.col("_first") < F.col("_quota"))
    return taken.where(~F.col("_in") if complement else F.col("_in")).select(*rows.columns)


def vectors(rows: DataFrame, size: int) -> DataFrame:
    """(graph_id, label, features) with sparse vectors, for the machine-learning library; of an index that repeats the first value counts."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    @F.udf(VectorUDT())
    def sparse(pairs):
        known = {}
        for p in pairs or ():
            known.setdefault(p["index"], p["value"])
        return Vectors.sparse(size, {k: v for k, v in known.items() if 0 <= k < size})

    return rows.select("graph_id", "label", sparse("features").alias("features"))


def train(data: DataFrame, costs=(0.01, 0.1, 1.0, 10.0), folds: int = 3, seed: int = 0):
    """A linear support vector machine, its regularisation chosen by cross-validated area under the curve. Labels 0 and 1."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    svm = LinearSVC(maxIter=50)
    grid = ParamGridBuilder().addGrid(svm.regParam, [1.0 / c for c in costs]).build()
    return CrossValidator(estimator=svm, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed, parallelism=4).fit(data)


def area_under_curve(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    """The chance that a row of label 1 scores over one of label 0, ties half."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    data = scored.select(F.col(score).cast("double").alias("rawPrediction"), F.col(label).cast("double").alias("label"))
    return BinaryClassificationEvaluator(numBins=0).evaluate(data)


def errors(scored: DataFrame) -> DataFrame:
    """(accuracy, mse, scc) of (label, prediction): share of equal ones, mean square error, squared correlation."""
    d = F.col("label") - F.col("prediction")
    return scored.agg(F.avg((d == 0).cast("double")).alias("accuracy"), F.avg(d * d).alias("mse"), F.pow(F.corr("label", "prediction"), 2).alias("scc"))


def geometric_mean(df: DataFrame, column: str) -> DataFrame:
    """(mean, spread) of positive values, both on the logarithmic scale."""
    return df.agg(F.exp(F.avg(F.ln(column))).alias("mean"), F.exp(F.stddev_pop(F.ln(column))).alias("spread"))


def best_cells(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k rows of the largest value: a top-k report."""
    return df.orderBy(F.desc(column), *[c for c in df.columns if c != column]).limit(k)
