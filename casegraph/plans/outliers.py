"""Behavioural outliers: twelve features, ECOD and an isolation forest, the union of both flags with its drivers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import isolation_scores
from ..operators.relational import column_quantiles, ecod
from ..operators.store import written

FEATURES = ("degree", "betweenness", "calls", "night_ratio", "distinct_contacts", "tx_in", "tx_out", "tx_counterparties", "cases", "sightings", "phones", "accounts")
FOREST_SAMPLE = 20_000


def scaled(df: DataFrame, key: str, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    return df.select(key, *(F.log1p(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).alias(c) for c in columns))


def forest(df: DataFrame, key: str, columns: tuple[str, ...] = FEATURES, trees: int = 300, seed: int = 42) -> DataFrame:
    """(key, score): trees are grown on a sample of at most FOREST_SAMPLE rows (each tree sees 256 anyway), drawn by a hash of the key; every
    row is scored, batch by batch, by the same trees together with the sample."""
    sample = df.orderBy(F.xxhash64(key), key).limit(FOREST_SAMPLE).toPandas()
    points = sample[list(columns)].to_numpy(np.float64)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(columns)].to_numpy(np.float64)
            s = forest_scores(points, x, trees, seed)
            yield pd.DataFrame({key: b[key], "score": s})

    return df.mapInPandas(run, f"{key} {kind}, score double")


def forest_scores(points: np.ndarray, x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Scores of x by trees grown on `points` only."""
    return isolation_scores(points, trees=trees, seed=seed, others=x)


def outliers(df: DataFrame, key: str, columns: tuple[str, ...] = FEATURES, share: float = 0.06, least_rows: int = 20) -> DataFrame:
    """(key, ecod, forest, both, score, drivers) of rows that either method puts in its top `share`; fewer than `least_rows` rows give
    none. drivers: the three features that stand out most, by robust distance from the median."""
    s = scaled(df, key, columns)
    n = s.count()
    if n < least_rows:
        return s.select(key, F.lit(0.0).alias("ecod"), F.lit(0.0).alias("forest"), F.lit(False).alias("both"), F.lit(0.0).alias("score"), F.lit("").alias("drivers")).limit(0)
    e, f = ecod(s, key, list(columns)).withColumnRenamed("score", "ecod"), forest(s, key, columns).withColumnRenamed("score", "forest")
    j = e.join(f, key)
    j = written(j, "outlier_scores")
    cut = column_quantiles(j, {"_e": ("ecod", 1 - share), "_f": ("forest", 1 - share)})
    top = j.agg(F.max("ecod").alias("_me"), F.max("forest").alias("_mf"))
    j = j.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(top)).where("ecod > _e or forest > _f")  # one row each
    blend = 0.5 * F.col("ecod") / F.col("_me") + 0.5 * F.col("forest") / F.col("_mf")
    both = (F.col("ecod") > F.col("_e")) & (F.col("forest") > F.col("_f"))
    mid = column_quantiles(s, {f"_m_{c}": (c, 0.5) for c in columns})
    far = F.slice(F.array_sort(F.array(*(F.struct((-F.abs(F.col(c) - F.col(f"_m_{c}"))).alias("d"), F.lit(c).alias("c")) for c in columns))), 1, 3)
    drivers = s.crossJoin(F.broadcast(mid)).select(key, F.array_join(F.transform(far, lambda x: x["c"]), ",").alias("drivers"))
    return j.join(drivers, key).select(key, "ecod", "forest", both.alias("both"), F.least(F.lit(1.0), 0.3 + 0.4 * blend + F.when(both, 0.2).otherwise(0.0)).alias("score"), "drivers")


def best_passage(found: DataFrame, doc: str = "doc_id", limit: int = 20) -> DataFrame:
    """The best passage of each document, the best documents first: (doc, n, score)."""
    best = found.groupBy(doc).agg(F.max_by(F.struct("n", "score"), F.struct("score", -F.col("n"))).alias("x"))
    return best.select(doc, "x.n", "x.score").orderBy(F.desc("score"), doc).limit(limit)


def shown_components(of: DataFrame, most: int = 120) -> DataFrame:
    """Components (component, size), the largest first, until about `most` nodes are shown."""
    sizes = of.groupBy("component").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.desc("size"), "component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.orderBy(F.desc("size"), "component").limit(most).withColumn("before", before).where(F.col("before") < most).drop("before")


def community_sweep(edges: DataFrame, truth: DataFrame, resolutions: tuple[float, ...] = (0.4, 0.6, 0.8, 1.0, 1.2)) -> DataFrame:
    """Agreement of communities at several resolutions with the truth (id, truth)."""
    from ..operators.graph import clustering_agreement, louvain

    out = None
    for r in resolutions:
        row = clustering_agreement(louvain(edges, r).join(truth, "id").select("truth", F.col("community").alias("found"))).withColumn("resolution", F.lit(r))
        out = row if out is None else out.unionAll(row)
    return out
