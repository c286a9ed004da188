"""Pairs of similar names by an index of letter pairs, without comparing every name with every other.

If two names score enough, their longest common subsequence is long, so the names share at least so many of the letter pairs inside their words, whatever
the order of the words. Each name is posted under its rarest pairs only, as many as leave fewer behind than it must share: two names that are similar
enough then meet under one of them. With TOGETHER - 1 more of them, they meet under so many at once, so names of common lengths are posted under combinations of
TOGETHER pairs, which few names share. Names too short or too split for this are posted under their letters. Scores are computed for names that met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import scored
from ..operators.skew import spread_join
from ..operators.store import dropped, written

#: A weighted score of this much can come from a common part of names of very different lengths, which no bound on shared pairs covers.
LOWEST = 85.5
#: Names of up to so many rare pairs are posted under all combinations of TOGETHER of them (364 at most), others under each pair.
TOGETHER, MOST = 3, 14


def _kept(share: float, q: int) -> float:
    """The share of a name's letters (q 1) or pairs (q 2) that another name has, at least, if the ratio of both is `share`: the common subsequence has share /
    (2 - share) of the name at least, and each letter outside it breaks up to q."""
    common = share / (2 - share)
    return 1 - q * (1 - common)


def _need(length: Column, spaces: Column, share: float, q: int, cap: float = 1.0) -> Column:
    """How many of its letters or pairs inside words a name must share: those that touch a space do not count."""
    return F.ceil(length * min(_kept(share, q), cap) - (q - 1) - q * spaces - 1e-9)


def _posted(names: DataFrame, q: int) -> DataFrame:
    """(side, name_id, len, short, spaces, grams, bits): every letter or pair inside a word, numbered where it repeats, the rarest of all names first; bits has a
    bit for each, flipped by each that falls on it."""
    words = F.filter(F.split("name", r"\s+"), lambda w: w != "")
    gram = F.flatten(F.transform("words", lambda w: F.when(F.length(w) >= q, F.transform(F.sequence(F.lit(1), F.length(w) - (q - 1)), lambda i: F.substring(w, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))))
    own = names.withColumn("words", words).withColumns({"len": F.length("name"), "short": F.length(F.array_join(F.array_distinct("words"), " ")), "spaces": F.length("name") - F.length(F.array_join("words", "")), "g": gram})
    nth = F.transform("g", lambda x, i: F.concat_ws("#", x, F.size(F.filter(F.slice("g", F.lit(1), i + 1), lambda y: y == x)).cast("string")))  # within a name
    each = written(own.select("side", "name_id", "len", "short", "spaces", F.explode(nth).alias("gram")), "grams")
    df = each.groupBy("gram").agg(F.count("*").alias("df"))
    bits = F.expr("aggregate(grams, 0L, (s, x) -> s ^ shiftleft(1L, cast(pmod(xxhash64(x), 64L) as int)))")
    by_name = each.join(df, "gram").groupBy("side", "name_id", "len", "short", "spaces").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("grams"))
    out = written(by_name.withColumn("bits", bits), "postings")
    dropped(each)
    return out


def _front(p: DataFrame, need: Column, more: int = 0) -> DataFrame:
    """`p` with need and front: so many of its rarest grams that names which share `need` share 1 + more of them."""
    return p.withColumn("need", F.greatest(need, F.lit(1)).cast("int")).withColumn("front", F.slice("grams", F.lit(1), F.greatest(F.size("grams") - F.col("need") + 1 + more, F.lit(0))))


def _single(p: DataFrame, grams: str) -> DataFrame:
    return p.withColumn("gram", F.explode(F.transform(grams, lambda g: F.xxhash64(g)))).drop("grams", "front")


def _combined(p: DataFrame) -> DataFrame:
    """A row for each combination of three grams of front."""
    rest = lambda here, at: F.slice("h", at, F.greatest(F.size("h") - at + 1, F.lit(0)))
    p = p.withColumn("h", F.transform("front", lambda g: F.xxhash64(g))).withColumn("n", F.size("grams")).drop("grams", "front")
    p = p.select("*", F.posexplode("h").alias("i", "g1"))
    p = p.select("*", F.posexplode(rest("h", F.col("i") + 2)).alias("j", "g2"))
    p = p.select("*", F.explode(rest("h", F.col("i") + F.col("j") + 3)).alias("g3"))
    return p.withColumn("gram", F.xxhash64("g1", "g2", "g3")).drop("h", "i", "j", "g1", "g2", "g3")


def _met(x: DataFrame, y: DataFrame, agree: Column) -> DataFrame:
    """(a, b): name_ids of the postings that share a gram and `agree`, a condition on their other columns, which begin with x_ and y_. Frequent grams are dealt to tasks.
    Grams are compared by a hash: one more name that meets is no harm."""
    counts = x.groupBy("gram").agg(F.count("*").alias("n"))
    left, right = (p.select("gram", *(F.col(c).alias(f"{k}_{c}") for c in p.columns if c != "gram")) for k, p in (("x", x), ("y", y)))
    return spread_join(left, right, "gram", counts, x.count(), F.xxhash64("x_name_id")).where(agree).select(F.col("x_name_id").alias("a"), F.col("y_name_id").alias("b")).distinct()


def _of(p: DataFrame, side: str) -> DataFrame:
    return p.where(F.col("side") == side).drop("side")


def _band() -> Column:
    """Lengths by powers of 1.5: a name of 1.5 times the length is in a higher band, one of under 8 times in one of the next six."""
    return F.floor(F.log("len") / F.log(F.lit(1.5))).cast("int")


def _inside(short: DataFrame, long: DataFrame) -> DataFrame | None:
    """(a, b) of postings of shorter names (with front) and of all grams of names that are 1.5 to 8 times as long; None if there are no such lengths."""
    bands = lambda p: {r[0] for r in p.select(_band()).distinct().collect()}  # noqa: E731  fewer than 40
    here, there = bands(short), bands(long)
    if not (met := [b for b in there if any(1 <= b - a <= 6 for a in here)]):
        return None
    x = short.withColumn("band", F.explode(F.sequence(_band() + 1, _band() + 6))).where(F.col("band").isin(met))
    y = long.withColumn("band", _band()).where(F.col("band").isin(met))
    x, y = (_single(p, c).select("name_id", "len", F.xxhash64("band", "gram").alias("gram")) for p, c in ((x, "front"), (y, "grams")))
    return _met(x, y, (F.col("y_len") >= 1.5 * F.col("x_len")) & (F.col("y_len") < 8 * F.col("x_len")))


def candidates(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """(a, la, b, lb): of names (id, name) of x and y all pairs whose weighted score can reach `least`, of any length and order of words."""
    if least <= LOWEST:
        raise ValueError(f"pairs are found for scores above {LOWEST}")
    key = F.col("id").cast("string").alias("id")  # both sides' ids may be of any type that comes back from a text
    names = x.select(F.lit("x").alias("side"), key, "name").unionByName(y.select(F.lit("y").alias("side"), key, "name")).where("name is not null and trim(name) <> ''")
    names = written(names.distinct().withColumn("name_id", F.xxhash64("side", "id", "name")), "names")
    share, sets = least / 100, least / 95  # ratios count whole, those of sorted and common words 0.95
    cap = min(2 / 3, sets / (2 - sets) if sets <= 1 else 1.0)  # words in common make up so much of a name, if they decide
    need1, need2 = (_need(F.col("short"), F.col("spaces"), share, q, cap) for q in (1, 2))
    pairs = _posted(names, 2)
    near = (F.greatest("x_len", "y_len") < 1.5 * F.least("x_len", "y_len")) & (F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits"))) <= F.col("x_n") + F.col("y_n") - 2 * F.greatest("x_need", "y_need"))
    good = _front(pairs.where(need2 >= 1), need2)
    few = (F.col("need") >= TOGETHER) & (F.size("front") + TOGETHER - 1 <= MOST)
    combined = _combined(_front(pairs.where(need2 >= TOGETHER), need2, TOGETHER - 1).where(F.size("front") <= MOST).select("side", "name_id", "len", "bits", "need", "grams", "front"))
    single = _single(good.withColumns({"few": few, "n": F.size("grams")}).select("side", "name_id", "len", "bits", "need", "n", "few", "grams", "front"), "front")
    found = [_met(_of(combined, "x"), _of(combined, "y"), near)]
    if not good.where(~few).isEmpty():  # at least one of two names has no combinations
        found += [_met(_of(single.where("not few"), "x").drop("few"), _of(single, "y").drop("few"), near), _met(_of(single.where("few"), "x").drop("few"), _of(single.where("not few"), "y").drop("few"), near)]
    # names whose pairs say nothing meet all others under their letters
    apart = F.greatest("x_len", "y_len") < 1.5 * F.least("x_len", "y_len")
    letters = None
    lone = written(names.join(pairs.select("name_id"), "name_id", "left_anti"), "lone")  # without any pair
    if not lone.isEmpty() or not pairs.where(need2 < 1).isEmpty():
        letters = _posted(names, 1)
        first = _single(_front(letters, need1).withColumn("bare", need2 < 1).select("side", "name_id", "len", "bare", "grams", "front"), "front")
        bare, rest = first.where("bare").drop("bare"), first.where("not bare").drop("bare")
        found += [_met(_of(bare, "x"), _of(first.drop("bare"), "y"), apart), _met(_of(rest, "x"), _of(bare, "y"), apart)]
    if least <= 90:  # a name inside a longer one counts 0.9
        inside = least / 90
        tight1, tight2 = (_need(F.col("len"), F.col("spaces"), inside, q) for q in (1, 2))
        parts = [_front(pairs.where(tight2 >= 1), tight2)]
        if not lone.isEmpty() or not pairs.where(tight2 < 1).isEmpty():
            letters = letters or _posted(names, 1)
            parts.append(_front(letters.where(tight2 < 1), tight1))
        for part, every in zip(parts, (pairs, letters), strict=False):
            for here, there in (("x", "y"), ("y", "x")):
                if met := _inside(_of(part, here), _of(every, there)):
                    found.append(met if here == "x" else met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = written(found[0], "met")
    for more in found[1:]:
        met = met.union(written(more, "met"))
    kinds = {"a": x.schema["id"].dataType, "b": y.schema["id"].dataType}
    named = lambda side, i, n: _of(names, side).select(F.col("name_id").alias(f"{i}_key"), F.col("id").alias(i), F.col("name").alias(n))
    out = met.distinct().select(F.col("a").alias("a_key"), F.col("b").alias("b_key")).join(named("x", "a", "la"), "a_key").join(named("y", "b", "lb"), "b_key")
    return out.select(F.col("a").cast(kinds["a"]).alias("a"), "la", F.col("b").cast(kinds["b"]).alias("b"), "lb")


def similar(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """(a, la, b, lb, score): all pairs of names (id, name) of x and y with a weighted score of `least` or more. Null and blank names are similar to
    none; repeated rows count once; empty tables give an empty one."""
    return written(scored(candidates(x, y, least), "la", "lb"), "scored").where(F.col("score") >= least)  # written: scores are computed once
