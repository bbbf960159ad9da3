"""Models on object tables: a table goes in, the same table with one more column comes out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.operators.neighbours import nearest_neighbours
from rastrel.plans.ranks import take_smallest
from rastrel.schema import DEFAULT_CATEGORY, matrix_columns, q
from rastrel.session import cut_lineage, discard, stored

MODELS: dict[str, Callable[..., DataFrame]] = {}


class ModelNotFoundError(KeyError):
    """No model is registered under a name."""


def register_model(name: str) -> Callable:
    """Decorator that adds a model (df, in_col, out_col, channels, **options) -> df."""
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MODELS[name] = fn
        return fn
    return add


def run_model(df: DataFrame, in_col: str | None, out_col: str = "out", mode: str = "communities",
              channels: Sequence[str] | None = None, **options) -> DataFrame:
    if mode not in MODELS:
        raise ModelNotFoundError(f"{mode} is not one of {sorted(MODELS)}")
    return MODELS[mode](df, in_col, out_col, channels, **options)


def _features(df: DataFrame, channels: Sequence[str] | None) -> list[str]:
    """Listed channels when all are present, else every channel of the table."""
    present = matrix_columns(df)
    chosen = [c for c in present if channels and c in channels]
    return chosen if channels and all(c in present for c in channels) else present


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    # plain names, as vector columns address their inputs by name
    return VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df)


def _image_column(df: DataFrame) -> str:
    return "description" if "description" in df.columns else "sample"


def training_rows(df: DataFrame, in_col: str) -> DataFrame:
    """All objects of images in which at least one object has a label of its own."""
    key = _image_column(df)
    labelled = df.where(q(in_col).cast("string") != DEFAULT_CATEGORY).select(q(key)).distinct()
    return df.join(labelled, key, "left_semi")


def _forest(options: dict, weight: str | None = None) -> RandomForestClassifier:
    # 100 trees without a depth limit; 30 is the deepest that MLlib grows.
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction",
        numTrees=int(options.get("n_estimators", 100)), maxDepth=int(options.get("max_depth", 30)),
        seed=int(options.get("seed", 0)),
    )
    return forest.setWeightCol(weight) if weight else forest


def _label_names(index_model) -> F.Column:
    return F.array(*[F.lit(v) for v in index_model.labels])


@register_model("random forest")
def random_forest_labels(df: DataFrame, in_col: str | None, out_col: str = "rf",
                         channels: Sequence[str] | None = None, **options) -> DataFrame:
    """Class of every object by a forest trained on the images that carry labels."""
    source = in_col or "sample"
    columns = _features(df, channels)
    rows = _assembled(df.withColumn("_class", q(source).cast("string")), columns)
    training = training_rows(rows, source)
    indexer = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc").fit(training)
    model = _forest(options).fit(indexer.transform(training))
    scored = model.transform(rows)
    names = _label_names(indexer)
    return scored.withColumn(out_col, F.element_at(names, F.col("_prediction").cast("int") + 1)).select(
        *[q(c) for c in dict.fromkeys([*df.columns, out_col])]
    )


@register_model("boosted trees")
def adaboost_labels(df: DataFrame, in_col: str | None, out_col: str = "adaboost",
                    channels: Sequence[str] | None = None, rounds: int = 100, **options) -> DataFrame:
    """Multi-class AdaBoost over small forests: each round weights the objects missed so far.

    Stops early when a round makes no error or is no better than chance, as boosting does. A round reads the whole table once: the
    forest's answers change the weights of the training rows and are added to every row's votes, and the table is written for the next
    round. So the plan of a round, and of the result, is the same after 100 rounds as after one. Ties of votes go to the first label.
    """
    source = in_col or "sample"
    columns = _features(df, channels)
    rows = _assembled(df.withColumn("_class", q(source).cast("string")), columns)
    indexer = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc").fit(training_rows(rows, source))
    n_classes = len(indexer.labels)
    key = _image_column(df)
    known = df.where(q(source).cast("string") != DEFAULT_CATEGORY).select(q(key)).distinct().withColumn("_known", F.lit(True))
    # rows of images without labels get no training weight; their class may be unknown to the indexer
    marked = indexer.setHandleInvalid("keep").transform(rows).join(known, key, "left")
    state = cut_lineage(marked.withColumns({
        "_w": F.when(F.col("_known"), F.lit(1.0)), "_votes": F.array_repeat(F.lit(0.0), n_classes),
    }).drop("_known", "_class"))
    settings = dict(options)
    for i in range(rounds):
        model = _forest({**settings, "seed": 10 + i}, "_w").fit(state.where("_w IS NOT NULL").select("_features", "_label", "_w"))
        judged = cut_lineage(model.transform(state).drop("rawPrediction", "probability"))
        miss = (F.col("_prediction") != F.col("_label")).cast("double")
        error = judged.agg(F.sum(F.col("_w") * miss) / F.sum("_w")).first()[0]
        chance = error >= 1 - 1 / n_classes
        if chance and i:
            break
        last = chance or error <= 0
        weight = 1.0 if last else float(np.log((1 - error) / error) + np.log(max(n_classes - 1, 1)))
        vote = F.transform("_votes", lambda v, k: v + F.when(k == F.col("_prediction").cast("int"), F.lit(weight)).otherwise(0.0))  # noqa: B023
        state = judged.withColumns({"_votes": vote, "_w": F.col("_w") * F.exp(miss * weight)}).drop("_prediction")
        if last:
            break
    best = F.array_position("_votes", F.array_max("_votes")).cast("int")
    return state.withColumn(out_col, F.element_at(_label_names(indexer), best)).select(*[q(c) for c in dict.fromkeys([*df.columns, out_col])])


def mixing_training_set(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("sample", "cell_id"),
                        share: float = 0.5, prop_mix: float = 1.0, seed: int = 0) -> DataFrame:
    """Single objects (label 0) and averages of two random ones (label 1): (features.., _label).

    Exactly int(n * share) objects are drawn by hash order; pairs are drawn by number, so partners
    meet through two equality joins.
    """
    n = df.count()
    size = int(n * share)
    hashed = df.select(
        F.xxhash64(*[q(k) for k in key], F.lit(seed)).alias("_h"), *[q(c).cast("double").alias(c) for c in columns]
    )
    drawn = take_smallest(hashed, [], "_h", size)
    numbered = cut_lineage(_number_rows(drawn))
    single = numbered.select(*[q(c) for c in columns], F.lit(0.0).alias("_label"))
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(max(size, 1))) + 1
    pairs = df.sparkSession.range(int(prop_mix * size)).select(draw(1).alias("_i"), draw(2).alias("_j"))
    first = numbered.select(F.col("_n").alias("_i"), *[q(c).alias(f"a{k}") for k, c in enumerate(columns)])
    second = numbered.select(F.col("_n").alias("_j"), *[q(c).alias(f"b{k}") for k, c in enumerate(columns)])
    mixed = pairs.join(first, "_i").join(second, "_j").select(
        *[((F.col(f"a{k}") + F.col(f"b{k}")) / 2).alias(c) for k, c in enumerate(columns)], F.lit(1.0).alias("_label")
    )
    return single.unionByName(mixed)


def _number_rows(df: DataFrame) -> DataFrame:
    """Rows numbered 1..n along their hash, by counts per hash range and positions inside it."""
    from pyspark.sql import Window

    cut = df.withColumn("_s", F.shiftright("_h", 52))
    sizes = cut.groupBy("_s").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_s").orderBy("_h")
    return cut.join(starts, "_s").withColumn("_n", F.col("_before") + F.row_number().over(inside)).drop("_s", "_before")


@register_model("object mixing")
def object_mixing(df: DataFrame, in_col: str | None, out_col: str = "rf", channels: Sequence[str] | None = None,
                  share: float = 0.5, key: Sequence[str] = ("sample", "cell_id"), **options) -> DataFrame:
    """1.0 for objects that look like the average of two others, else 0.0."""
    columns = _features(df, channels)
    training = mixing_training_set(df, columns, key, share, seed=int(options.get("seed", 0)))
    model = _forest(options).fit(_assembled(training, columns))
    scored = model.transform(_assembled(df, columns))
    return scored.withColumn(out_col, F.col("_prediction")).select(*[q(c) for c in dict.fromkeys([*df.columns, out_col])])


# ---------------------------------------------------------------- scaling and projection

def scale_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with mean 0 and population standard deviation 1; constant columns become 0."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(q(c)).alias("m"), F.stddev_pop(q(c)).alias("s")).alias(f"c{i}") for i, c in enumerate(columns)
    ]).alias("s")).scalar()
    named = df.withColumn("_s", stats)
    place = {c: i for i, c in enumerate(columns)}
    one = lambda c, i: F.when(F.col(f"_s.c{i}.s") > 0, (q(c) - F.col(f"_s.c{i}.m")) / F.col(f"_s.c{i}.s")).otherwise(F.lit(0.0))
    return named.select(*[one(c, place[c]).alias(c) if c in place else q(c) for c in df.columns])


def pca_project(df: DataFrame, columns: Sequence[str], components: int | None = None) -> DataFrame:
    """Centred principal component scores PC1.. of standardised columns, min(25, columns/2) by default."""
    k = components or max(1, min(25, len(columns) // 2))
    rows = _assembled(df, columns)
    steps = Pipeline(stages=[
        StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=False),
        PCA(k=k, inputCol="_scaled", outputCol="_pc"),
    ])
    scored = steps.fit(rows).transform(rows).withColumn("_a", vector_to_array("_pc"))
    return scored.select(*[q(c) for c in df.columns], *[F.col("_a")[i].alias(f"PC{i + 1}") for i in range(k)])


def pca_embedding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-dimensional view of objects: the first two components of scaled channels as UMAP1, UMAP2."""
    keys = [c for c in df.columns if c not in columns]
    scaled = scale_features(df.select(*[q(k) for k in keys], *[q(c).cast("double").alias(c) for c in columns]), columns)
    return pca_project(scaled, columns, 2).select(
        *[q(k) for k in keys], F.col("PC1").alias("UMAP1"), F.col("PC2").alias("UMAP2")
    )


# ---------------------------------------------------------------- neighbour graph and communities

def _both_ways(edges: DataFrame, key: str) -> DataFrame:
    """(a, b) of every edge and of its reverse; the edges are made once."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.select(F.explode(F.array(pair(key, "neighbour"), pair("neighbour", key))).alias("e")).select("e.a", "e.b")


def communities(edges: DataFrame, key: str, rounds: int = 10) -> DataFrame:
    """Community of each object by label propagation on an undirected neighbour graph.

    Every round an object takes the label most of its neighbours carry (the smallest on a tie, its
    own when among them). Labels meet edges through one join; counts are combined before the
    shuffle. Each round is written, and takes the place of the last one's files.
    """
    both = stored(_both_ways(edges, key).distinct())
    labels = stored(both.select("a").distinct().withColumn("label", F.col("a")))
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a", "label").agg(
            F.count(F.lit(1)).alias("n")
        )
        own = labels.select("a", F.col("label").alias("old"))
        ranked = heard.join(own, "a").groupBy("a").agg(
            F.max(F.struct(
                F.col("n"), (F.col("label") == F.col("old")).alias("same"), (-F.col("label")).alias("neg"),
            )).alias("best"), F.first("old").alias("old"),
        )
        following = stored(ranked.select("a", (-F.col("best.neg")).alias("label"), "old"))
        discard(labels)
        labels = following
        if not following.where(F.col("label") != F.col("old")).limit(1).count():
            break
    discard(both)
    return labels.select(F.col("a").alias(key), "label")


def modularity(edges: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Modularity of a labelling of the undirected graph: one row (modularity)."""
    both = _both_ways(edges, key).distinct()
    of = lambda side: labels.select(F.col(key).alias(side), F.col("label").alias(f"l{side}"))
    marked = both.join(of("a"), "a").join(of("b"), "b")
    per = marked.groupBy(F.col("la").alias("label")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum((F.col("la") == F.col("lb")).cast("bigint")).alias("within")
    )
    total = per.agg(F.sum("degree").alias("m")).scalar()
    return per.withColumn("_m", total).agg(
        F.sum(F.col("within") / F.col("_m") - (F.col("degree") / F.col("_m")) * (F.col("degree") / F.col("_m"))).alias("modularity")
    )


@register_model("communities")
def knn_communities(df: DataFrame, in_col: str | None, out_col: str = "community",
                    channels: Sequence[str] | None = None, n_neighbors: int = 30, key: str = "cell_id",
                    rounds: int = 10, **_) -> DataFrame:
    """Community of each object in the k-nearest-neighbour graph of its channels.

    ``key`` is an integer column unique in the table.
    """
    columns = _features(df, channels)
    graph = stored(nearest_neighbours(df, key, columns, n_neighbors).select(key, "neighbour"))
    labels = communities(graph, key, rounds).select(key, F.col("label").cast("string").alias(out_col))
    base = df.drop(out_col) if out_col in df.columns else df
    return base.join(labels, key, "left").select(*[q(c) for c in base.columns], q(out_col))
