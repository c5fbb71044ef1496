"""Acceptance models (I46-I50) on MLlib: grouped folds, out-of-fold scores, importances, pruning."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.readers import written


def group_folds(df: DataFrame, group: str, k: int = 5, stratify: str | None = None) -> DataFrame:
    """A fold for each group; rows of a group never part.

    Groups are dealt in turn, larger ones first.  With ``stratify`` (a 0/1
    column) those with more ones come first and every other round is dealt
    backwards, so that the folds have alike shares of both classes.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(stratify).cast("long") if stratify else F.lit(0)).alias("_ones"))
    turn = F.row_number().over(Window.orderBy(F.desc("_ones"), F.desc("_n"), group)) - 1  # one row a group
    fold = F.when((F.floor(turn / k) % 2 == 1) & F.lit(stratify is not None), k - 1 - turn % k).otherwise(turn % k)
    return df.join(sizes.select(group, fold.cast("int").alias("fold")), group)


def useful_features(df: DataFrame, features: list[str], leaks: set[str] = frozenset()) -> list[str]:
    """Features without leak columns and constants."""
    stats = df.agg(*[F.min(c).alias(f"l_{c}") for c in features], *[F.max(c).alias(f"h_{c}") for c in features]).first()
    return [c for c in features if c not in leaks and stats[f"l_{c}"] != stats[f"h_{c}"]]


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df.na.fill(0, features))


def _by_fold(data: DataFrame, k: int, model) -> DataFrame:
    """``prob`` of each row from a model of the other folds; where those have one class only, its label."""
    parts = []
    for i in range(k):
        train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
        classes = {r["label"] for r in train.select("label").distinct().collect()}
        if len(classes) < 2:
            parts.append(test.withColumn("prob", F.lit(float(next(iter(classes), 0)))))
            continue
        parts.append(model.fit(train).transform(test).withColumn("prob", vector_to_array("probability")[1]))
    out = parts[0].select(*data.columns, "prob")
    for p in parts[1:]:
        out = out.unionByName(p.select(*data.columns, "prob"))
    return out


def out_of_fold(df: DataFrame, features: list[str], group: str, k: int = 5, rounds: int = 5, depth: int = 3) -> DataFrame:
    """Out-of-fold probability of each row; rows of a group share a fold.  The folds are a table, read by every model."""
    data = _vector(written(group_folds(df, group, k)), features)
    return _by_fold(data, k, GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7)).select(*df.columns, "fold", "prob")


def bridge_model(df: DataFrame, columns: list[str], group: str, leaks: set[str], k: int = 5, rounds: int = 5, depth: int = 3) -> DataFrame:
    """Out-of-fold probability of each row by stratified folds of whole groups, without leaks and constants, ones weighed as zeros are.

    Fewer folds where there are fewer than ``k`` groups; one group or one class
    can't be measured out of fold and raises.
    """
    n = df.agg(F.countDistinct(group).alias("groups"), F.sum("label").alias("ones"), F.count(F.lit(1)).alias("rows")).first()
    if n["groups"] < 2 or not n["ones"] or n["ones"] == n["rows"]:
        raise ValueError(f"needs two groups and both classes: {n['groups']} groups, {n['ones']} ones of {n['rows']} rows")
    features = useful_features(df, columns, leaks)
    k = min(k, n["groups"])
    data = _vector(written(group_folds(df, group, k, "label").withColumn("_weight", F.when(F.col("label") == 1, (n["rows"] - n["ones"]) / n["ones"]).otherwise(1.0))), features)
    model = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_weight", maxIter=rounds, maxDepth=depth, seed=7)
    return _by_fold(data, k, model).select(*df.columns, "fold", "prob")


def metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: n, auc, ap, accuracy, brier of ``label`` and ``prob``; auc and ap null without both classes."""
    both = scored.select("label").distinct().count() == 2
    area = lambda name: float(BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", metricName=name).evaluate(scored)) if both else None
    hit = ((F.col("prob") >= threshold).cast("int") == F.col("label")).cast("double")
    out = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg((F.col("prob") - F.col("label")) ** 2).alias("brier"))
    return out.select("n", F.lit(area("areaUnderROC")).cast("double").alias("auc"), F.lit(area("areaUnderPR")).cast("double").alias("ap"), "accuracy", "brier")


def importances(df: DataFrame, features: list[str], rounds: int = 5) -> list[tuple[str, float]]:
    """Features by gain, largest first."""
    model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=3, seed=7).fit(_vector(df, features))
    return sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda x: (-round(x[1], 9), x[0]))


def rank_candidates(df: DataFrame, features: list[str], query: list[str], weight: str | None = None, rounds: int = 5) -> DataFrame:
    """Ranker by regressed relevance, ranked inside each query; ``weight`` names a column of sample weights.

    MLlib has no pairwise objective: relevance is taken relative to its query's
    mean, so that only differences inside a query count.
    """
    centred = df.withColumn("_rel", F.col("label") - F.avg("label").over(Window.partitionBy(*query)))
    data = _vector(centred, features)
    model = GBTRegressor(featuresCol="_x", labelCol="_rel", maxIter=rounds, maxDepth=3, seed=7, **({"weightCol": weight} if weight else {})).fit(data)
    scored = model.transform(data).withColumn("rank_score", F.col("prediction"))
    order = Window.partitionBy(*query).orderBy(F.desc(F.round("rank_score", 9)), "cand")
    return scored.withColumn("rank", F.row_number().over(order)).select(*df.columns, "rank_score", "rank")


def top_one(ranked: DataFrame) -> DataFrame:
    """Queries and the share of them whose first candidate is right."""
    return ranked.where("rank = 1").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("label").cast("double")).alias("top1"))


def holdout_by_group(df: DataFrame, features: list[str], category: str, group: str, share: float = 0.25, rounds: int = 20, depth: int = 5) -> DataFrame:
    """Site confidence: a quarter of the groups (rounded up) is held out whole; boosted trees on numbers and one column for each category.

    Groups are drawn by hash, so that a repeated run holds out the same ones.
    """
    groups = df.select(group).distinct()
    order = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(42), group), group))  # one row a group
    drawn = groups.withColumn("held", (order <= F.ceil(F.lit(share) * F.lit(groups.count()))).cast("int"))
    split = df.join(drawn, group)
    indexed = StringIndexer(inputCol=category, outputCol="_c", handleInvalid="keep", stringOrderType="alphabetAsc").fit(split).transform(split)
    dummies = OneHotEncoder(inputCol="_c", outputCol="_d", dropLast=False).fit(indexed).transform(indexed)
    data = VectorAssembler(inputCols=[*features, "_d"], outputCol="_x", handleInvalid="keep").transform(dummies.na.fill(0, features))
    model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7).fit(data.where("held = 0"))
    return model.transform(data).select(*df.columns, "held", vector_to_array("probability")[1].alias("prob"))


def prune(df: DataFrame, families: dict[str, list[str]], group: str, k: int = 3, tolerance: float = 0.01) -> list[tuple[int, str, str, float, float, int, int]]:
    """Greedy removal while the metric stays within ``tolerance`` of the round before: whole families, then single features.

    Every trial is measured out of fold, over the same folds of whole groups
    (written once), so that a feature that only memorises its rows doesn't help.
    Rows (step, phase, dropped, auc, ap, features left, best); best marks the
    step with the largest (auc, ap), of equal ones that with fewest features.
    """
    folds = written(group_folds(df, group, k))
    model = LogisticRegression(featuresCol="_x", labelCol="label", maxIter=10)

    def measure(features: list[str]) -> tuple[float, float]:
        scored = _by_fold(_vector(folds, features), k, model).select("label", "prob").persist()
        try:
            return tuple(round(BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", metricName=m).evaluate(scored), 6) for m in ("areaUnderROC", "areaUnderPR"))
        finally:
            scored.unpersist()

    left = dict(families)
    base = measure([f for v in left.values() for f in v])
    steps = [(0, "all", "", *base, sum(map(len, left.values())))]
    for phase in ("family", "feature"):
        while len(left) > 1:
            tried = sorted(((measure([f for k, v in left.items() if k != gone for f in v]), gone) for gone in left), key=lambda x: (-x[0][0], -x[0][1], x[1]))
            now, gone = tried[0]
            if now[0] < base[0] - tolerance:
                break
            base = now
            del left[gone]
            steps.append((len(steps), phase, gone, *base, sum(map(len, left.values()))))
        left = {f: [f] for v in left.values() for f in v}
    best = max(steps, key=lambda x: (x[3], x[4], -x[5]))[0]
    return [(*s, int(s[0] == best)) for s in steps]
