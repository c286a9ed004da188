"""Places: distances, and a gazetteer lookup whose tables are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres; null if any part is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def located(df: DataFrame, candidates: list[str], places: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon, precision, matched): the first candidate text that names a place of `places` (name, lat, lon, precision: city, state,
    court or country), by the words of the text: every run of one to three words is looked up, longer names first, cities before
    states before courts before countries."""
    rank = F.coalesce(*(F.when(F.col("precision") == p, i) for i, p in enumerate(("city", "state", "court", "country"))), F.lit(9))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    texts = df.select(key, F.posexplode(F.array(*(words(c) for c in candidates))).alias("pos", "w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("name")))).otherwise(F.expr("cast(array() as array<struct<n:int,name:string>>)"))))
    each = texts.select(key, "pos", F.explode(runs).alias("r")).select(key, "pos", "r.n", "r.name").distinct()
    hit = each.join(places.select(F.lower("name").alias("name"), "lat", "lon", "precision", rank.alias("rank")), "name")
    best = hit.groupBy(key).agg(F.min_by(F.struct("lat", "lon", "precision", F.col("name").alias("matched")), F.struct("pos", "rank", -F.col("n"), "name")).alias("x"))
    return best.select(key, "x.lat", "x.lon", "x.precision", "x.matched")
