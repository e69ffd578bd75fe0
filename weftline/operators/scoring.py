"""Feature vectors, clusters and anomaly scores."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import functions as X


def maxabs(df: DataFrame, features: str = "features") -> DataFrame:
    """Each feature over its greatest absolute value; zero stays zero."""
    n = df.select(F.max(F.size(features))).first()[0] or 0
    top = df.agg(F.array(*(F.max(F.abs(F.get(features, F.lit(i)).cast("double"))) for i in range(n))).alias("_top"))
    scaled = F.zip_with(features, "_top", lambda x, m: F.when(m > 0, x.cast("double") / m).otherwise(F.lit(0.0)))
    return df.join(F.broadcast(top), how="inner").withColumn(features, scaled).drop("_top")  # one row


def averages(df: DataFrame, features: str = "features") -> DataFrame:
    """(min, max, mean, population deviation) of each vector in place of it."""
    mean = X.total(F.col(features)) / F.size(features)
    spread = F.aggregate(features, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(features) - F.col("_mean") * F.col("_mean")
    return df.withColumn("_mean", mean).withColumn(features, F.array(F.array_min(features).cast("double"), F.array_max(features).cast("double"), F.col("_mean"), F.sqrt(F.greatest(spread, F.lit(0.0))))).drop("_mean")


def centroids(df: DataFrame, cluster: str = "label", features: str = "features") -> dict[int, list[float]]:
    """The means of given clusters; as many rows as clusters reach the driver."""
    n = df.select(F.max(F.size(features))).first()[0] or 0
    rows = df.groupBy(cluster).agg(*(F.avg(F.get(features, F.lit(i)).cast("double")) for i in range(n))).collect()
    return {r[0]: list(r[1:]) for r in sorted(rows)}


def distances(df: DataFrame, centres: list[list[float]], features: str = "features", squared: bool = True) -> DataFrame:
    """distances to all centres, and the nearest cluster (from 1 on) with its distance; squared as the models store them."""
    each = F.array(*(X.squared_distance(F.col(features), c) for c in centres))
    if not squared:
        each = F.transform(each, lambda d: F.sqrt(d))
    return df.withColumn("distances", each).withColumns({"distance": F.array_min("distances"), "cluster": F.array_position("distances", F.array_min("distances")).cast("int")})


def variances(assigned: DataFrame, k: int) -> list[float]:
    """Mean squared distance of each cluster; the least float for empty ones and ones of a single row."""
    rows = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.col("distance") * F.col("distance")).alias("v")).collect()
    by = {r["cluster"]: r["v"] if r["n"] > 1 else X.FLOAT_EPSILON for r in rows}
    return [max(by.get(i + 1, X.FLOAT_EPSILON), X.FLOAT_EPSILON) for i in range(k)]


def davies_bouldin(assigned: DataFrame, centres: list[list[float]]) -> float:
    """Mean over clusters of the worst (s_i + s_j) / d_ij, s being the mean distance to the centre."""
    rows = assigned.groupBy("cluster").agg(F.avg(F.sqrt("distance")).alias("s")).collect()
    s = {r["cluster"] - 1: r["s"] for r in rows}
    c = np.array(centres)
    worst = [max(((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in s if j != i and np.linalg.norm(c[i] - c[j]) > 0), default=0.0) for i in s]
    return float(np.mean(worst)) if worst else 0.0


@dataclass(frozen=True)
class Evaluation:
    average_distance: float
    davies_bouldin: float
    mutual_information: float | None


def evaluate(assigned: DataFrame, centres: list[list[float]], label: str | None = None) -> Evaluation:
    """Mean distance to the nearest centre, Davies-Bouldin index and, with a label, mutual information of clusters and
    labels over the mean of their entropies. Only counts by cluster and label reach the driver. No rows: zeros."""
    mean = assigned.agg(F.avg("distance")).first()[0] or 0.0
    shared = None
    if label is not None:
        by = {(r[0], r[1]): r[2] for r in assigned.groupBy("cluster", label).agg(F.count("*")).collect()}
        n = sum(by.values())
        sides: list[dict] = [{}, {}]
        for key, k in by.items():
            for side, x in zip(sides, key, strict=True):
                side[x] = side.get(x, 0) + k
        entropy = [-sum(k / n * np.log(k / n) for k in side.values()) for side in sides]
        both = sum(k / n * np.log(k * n / (sides[0][a] * sides[1][b])) for (a, b), k in by.items())
        shared = float(2 * both / sum(entropy)) if sum(entropy) > 0 else 0.0
    return Evaluation(mean, davies_bouldin(assigned, centres), shared)


@dataclass
class Clusters:
    centres: list[list[float]]
    variances: list[float]
    index: float = 0.0


@dataclass
class Profile:
    """What `build_profile` learns: the transformer's parameters and the best cluster models."""

    method: str
    scale: list[float]
    mean: list[float]
    loadings: list[list[float]]
    models: list[Clusters]
    features: list[str]
    tags: list[str] | None = None

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"models": [m.__dict__ for m in self.models]}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Profile:
        d = json.loads(text)
        return cls(**d | {"models": [Clusters(**m) for m in d["models"]]})

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "profile string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path: str) -> Profile:
        return cls.from_json(spark.read.schema("profile string").json(path).first()[0])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Vectors as the models know them: Direct (scaled), Pca (scaled, centred, projected), Average (shape only)."""
        if self.method == "average":
            return averages(df, features)
        scaled = F.transform(features, lambda x, i: x.cast("double") * F.get(F.array(*map(F.lit, [1 / s if s else 0.0 for s in self.scale])), i))
        if self.method == "direct":
            return df.withColumn(features, scaled)
        dot = lambda w: F.aggregate(F.zip_with(scaled, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(-float(np.dot(self.mean, w))), lambda a, x: a + x)
        return df.withColumn(features, F.array(*(dot(w) for w in self.loadings)))

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """distances, scores and their summary: every model in one pass over the rows, no join."""
        out, ds, ss = self.transform(df, features), [], []
        for m in self.models:
            each = F.array(*(X.squared_distance(F.col(features), c) for c in m.centres))
            least = F.array_min(each)
            var = F.element_at(F.array(*map(F.lit, m.variances)), F.array_position(each, least).cast("int"))
            ds.append(least)
            ss.append(X.anomaly_score(least, var))
        out = out.withColumns({"distances": F.array(*ds), "scores": F.array(*ss)})
        return out.withColumns(X.score_summary(F.col("scores")))


def detected(scored: DataFrame, threshold: float = 0.1) -> DataFrame:
    return scored.where((F.col("average_score") >= 0) & (F.col("average_score") < threshold))


def assemble(df: DataFrame, columns: list[str], features: str = "features") -> DataFrame:
    """Numbers and vectors joined into one vector of doubles."""
    kinds = dict(df.dtypes)
    part = lambda c: F.transform(c, lambda x: x.cast("double")) if kinds[c].startswith("array") else F.array(F.col(c).cast("double"))
    return df.withColumn(features, F.flatten(F.array(*map(part, columns))))


def build_profile(df: DataFrame, method: str = "direct", features: str = "features", names: list[str] | None = None, ks: tuple[int, ...] = (3, 4, 5, 6, 7, 8), top: int = 3, rank: int = 3, seed: int = 1, tags: list[str] | None = None) -> Profile:
    """Transforms, trains a k-means model for each k, ranks them by Davies-Bouldin index and keeps the best.

    The scaler, the covariance and the clusters are aggregates over all rows; the driver sees k centres and n x n sums."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = df.select(F.max(F.size(features))).first()[0] or 0
    top_abs = df.agg(*(F.max(F.abs(F.get(features, F.lit(i)).cast("double"))) for i in range(n))).first()
    profile = Profile(method, [float(x or 0) for x in top_abs], [0.0] * n, [], [], names or [], tags)
    if method == "pca":
        scaled = Profile("direct", profile.scale, [], [], [], []).transform(df, features)
        g = lambda i: F.get(features, F.lit(i))
        profile.mean = [float(x or 0) for x in scaled.agg(*(F.avg(g(i)) for i in range(n))).first()]
        pairs_ = [(i, j) for i in range(n) for j in range(i, n)]
        cov = np.zeros((n, n))
        for at in range(0, len(pairs_), 400):
            part = pairs_[at : at + 400]
            for (i, j), v in zip(part, scaled.agg(*(F.avg((g(i) - profile.mean[i]) * (g(j) - profile.mean[j])) for i, j in part)).first(), strict=True):
                cov[i, j] = cov[j, i] = v or 0.0
        values, vectors = np.linalg.eigh(cov)
        for k in np.argsort(-values, kind="stable")[: min(rank, n)]:
            v = vectors[:, k]
            profile.loadings.append((v * (1 if v[np.abs(v).argmax()] >= 0 else -1)).tolist())
    data = profile.transform(df, features).select(array_to_vector(features).alias("v")).persist()
    try:
        rows, found = data.count(), []
        for k in ks:
            if rows < k:
                continue
            fit = KMeans(k=k, featuresCol="v", predictionCol="p", tol=1e-6, seed=seed, initMode="k-means||").fit(data)
            centres = [c.tolist() for c in fit.clusterCenters()]
            assigned = distances(data.select(vector_to_array("v").alias("features")), centres)
            found.append(Clusters(centres, variances(assigned, len(centres)), davies_bouldin(assigned, centres)))
        profile.models = sorted(found, key=lambda m: m.index)[:top]
    finally:
        data.unpersist()
    return profile


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return n.select("*", rate("tp", "fn").alias("tpr"), rate("tn", "fp").alias("spc"), rate("fp", "tn").alias("fpr"))


def roc(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Rates at each threshold; rows are counted by threshold interval before the running sums, so they aren't multiplied."""
    at = sorted(thresholds)
    place = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in at), F.lit(0))
    by = df.groupBy(place.alias("_i")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    grid = df.sparkSession.createDataFrame(list(enumerate(at, 1)), "i int, threshold double")
    all_ = by.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return grid.join(F.broadcast(by), F.col("_i") >= F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp")).join(F.broadcast(all_)).select("threshold", (F.col("tp") / F.col("all_pos")).alias("tpr"), (F.col("fp") / F.col("all_neg")).alias("fpr"))
