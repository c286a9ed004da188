"""URL filter: domain rules first, else gradient-boosted trees on lexical features. DataFrame operations only.

Training sums the labelled URLs into rows of equal binned features, so every level of a tree aggregates that table by (node,
feature, bin) and brings at most nodes x features x bins sums to the driver, whatever the number of URLs. The suffix statistic of
a training URL comes from the URLs of other folds of hosts, so no URL sees its own label in it. Hosts are dealt to folds evenly by label and
size. Besides the model of all URLs, one is grown without each fold, all in the same jobs; what these say of the hosts that they have
not seen tells how many trees of the whole model stay.

Where no labelled URLs are given, three weak labellers label them: a host word of a junk category says bad, a host of plain
words without any says good, and where neither speaks (joined or numbered host names without a listed word) the URL is left out of
the fit and is for the trees to judge.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import numbered
from ..operators.skew import spread_join
from ..operators.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 16
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "host_length", "suffix_rate")
FOLDS = 4
#: Trees that are grown before the held-out loss is looked at again, and the share of the first loss that they have to save for more to follow.
BATCH, WORTH = 5, 0.01
#: A suffix has a statistic of its own if it holds one of so many labelled URLs, so there are at most so many statistics.
SUFFIXES = 10_000
#: Words of a host, by junk category, for the first weak labeller.
JUNK_WORDS = {
    "gambling": ("casino", "bet", "bets", "betting", "poker", "slots", "jackpot", "lottery"),
    "pharmacy": ("pill", "pills", "pharma", "pharmacy", "viagra", "cialis"),
    "adult": ("adult", "porn", "sex", "xxx", "escort"),
    "advertising": ("ad", "ads", "adserver", "track", "tracker", "clicks", "banner"),
    "spam": ("spam", "linkfarm", "warez", "torrent", "payday", "replica"),
}

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: list[Rule], h: Column, p: Column) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none fits. A rule fits its host and all subdomains if the path
    starts with the rule's; of rules as long, the first in order of their text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in reversed(ordered):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, rh + rp).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _count(x: Column, characters: str) -> Column:
    return F.length(x) - F.length(F.translate(x, characters, ""))


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with the lexical features in columns f_*, host and suffix in columns of that name."""
    u = F.coalesce(F.col(url), F.lit(""))
    h, p = host(F.col(url)), path(F.col(url))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda s, c: s - F.when((c != "") & (share(c) > 0), share(c) * F.log2(share(c))).otherwise(0.0))
    return urls.withColumns(
        {
            "f_length": F.length(u).cast("double"), "f_depth": _count(p, "/").cast("double"), "f_digits": _count(u, "0123456789") / n, "f_entropy": entropy, "f_parameters": F.when(u.contains("?"), 1 + _count(u, "&")).otherwise(0).cast("double"),
            "f_hyphens": _count(h, "-").cast("double"), "f_labels": _count(h, ".").cast("double"), "f_host_length": F.length(h).cast("double"),
            "host": h, "suffix": F.substring_index(h, ".", -1),
        }
    )


@dataclass
class Model:
    base: float
    prior: float
    edges: dict[str, list[float]]
    suffixes: DataFrame  # suffix, f_suffix_rate: smoothed rate of bad URLs; at most SUFFIXES rows
    trees: list[dict] = field(default_factory=list)
    held: dict[str, float] = field(default_factory=dict)  # on hosts that a model has not seen: n, bad, recall, precision, loss

    def featured(self, urls: DataFrame, url: str = "url") -> DataFrame:
        out = lexical(urls, url).join(F.broadcast(self.suffixes), "suffix", "left")
        return out.withColumn("f_suffix_rate", F.coalesce("f_suffix_rate", F.lit(self.prior)))

    def margin(self) -> Column:
        """From the columns f_*."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + _leaf(t, lambda f, b: F.col(f"f_{f}") > self.edges[f][b])
        return out


def _leaf(node: dict, above) -> Column:
    if "value" in node:
        return F.lit(float(node["value"]))
    return F.when(above(node["feature"], node["bin"]), _leaf(node["right"], above)).otherwise(_leaf(node["left"], above))


def _suffix_rates(rows: DataFrame, prior: float, total: int, smooth: float) -> tuple[DataFrame, DataFrame]:
    """(suffix, f_suffix_rate) of all rows, and (suffix, fold, f_suffix_rate) with each fold's rate from the other folds; a suffix's rate is
    smoothed by `smooth` URLs of the prior."""
    each = rows.groupBy("suffix", "fold").agg(F.sum("label").alias("bad"), F.count("*").cast("double").alias("n"))
    every = each.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(F.col("n") * SUFFIXES >= total)
    every = written(every, "suffix")
    rate = lambda bad, n: ((bad + smooth * prior) / (n + smooth)).alias("f_suffix_rate")
    other = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).alias("x").join(each.alias("y"), ["suffix", "fold"], "left")
    other = other.select("suffix", "fold", rate(F.col("x.bad") - F.coalesce("y.bad", F.lit(0)), F.col("x.n") - F.coalesce("y.n", F.lit(0))))
    return every.select("suffix", rate(F.col("bad"), F.col("n"))), written(other, "suffix_folds")


def _folded(rows: DataFrame) -> DataFrame:
    """`rows` (host, label, ...) with fold: hosts in the order of their label (most of their URLs') and their number of URLs, dealt in turn."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    hosts = written(numbered(hosts.select("host", "n", (2 * F.col("bad") < F.col("n")).alias("good"), (-F.col("n")).alias("fewer")), ["good", "fewer", "host"]), "hosts")
    fold = hosts.select("host", (F.col("i") % FOLDS).cast("int").alias("fold"))
    return spread_join(rows, fold, "host", hosts.select("host", "n"), hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0], F.xxhash64("f_length", "f_entropy", "f_digits"))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", trees: int = 40, depth: int = 2, rate: float = 0.4, l2: float = 1.0, smooth: float = 20.0) -> Model | None:
    """From (url, label 0/1); rows with a null label or url are left out; None if no row is left. Repeated rows count as often as
    they stand there; URLs may be of any length; an empty table gives None. The model learns from all rows; how many trees it has, `trees` at
    most, and its record `held` come from the models that are grown without a fold. A recall below 0.9 there is logged."""
    rows = lexical(labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).dropna())
    rows = written(_folded(written(rows.select("label", "host", "suffix", *(f"f_{f}" for f in FEATURES[:-1])), "urls")), "folded")
    n, bad = rows.agg(F.count("*"), F.sum("label")).head()
    if not n:
        return None
    prior = (bad + 0.5) / (n + 1)
    suffixes, of_fold = _suffix_rates(rows, prior, n, smooth)
    rows = rows.join(F.broadcast(of_fold), ["suffix", "fold"], "left").withColumn("f_suffix_rate", F.coalesce("f_suffix_rate", F.lit(prior)))
    cuts = [i / BINS for i in range(1, BINS)]
    edges = rows.agg(*(F.percentile_approx(f"f_{f}", cuts, 1000).alias(f) for f in FEATURES)).head()
    edges = {f: sorted(set(edges[f])) for f in FEATURES}
    binned = [sum(((F.col(f"f_{f}") > e).cast("int") for e in edges[f]), F.lit(0)).alias(f) for f in FEATURES]
    table = written(rows.select("label", "fold", *binned).groupBy("fold", *FEATURES).agg(F.sum("label").alias("bad"), F.count("*").cast("double").alias("n")), "binned")
    models = [Model(math.log(prior / (1 - prior)), prior, edges, suffixes) for _ in range(FOLDS + 1)]  # the last learns from all folds
    base = F.lit(models[0].base)
    state = table.withColumns({"margins": F.array(*(base for _ in models)), "unseen": F.array(base)})
    held: list[dict] = []
    while len(models[-1].trees) < trees:
        for _ in range(min(BATCH, trees - len(models[-1].trees))):
            grown = _grown(state, depth, rate, l2)
            for model, tree in zip(models, grown, strict=True):
                model.trees.append(tree)
            now = F.array(*(F.get("margins", F.lit(m)) + _leaf(tree, lambda f, b: F.col(f) > b) for m, tree in enumerate(grown)))
            state = state.withColumn("margins", now).withColumn("unseen", F.array_append("unseen", F.get("margins", F.col("fold"))))
            state = written(state, "margins")
        held = _held_out(state)
        if held[-1 - min(BATCH, len(held) - 1)]["loss"] - held[-1]["loss"] < WORTH * held[0]["loss"]:
            break
    if held:
        k = min(range(len(held)), key=lambda i: (held[i]["loss"], i))
        models[-1].trees, models[-1].held = models[-1].trees[:k], held[k]
        if held[k]["recall"] < 0.9:
            logging.getLogger(__name__).warning("of the bad URLs of unseen hosts only %.2f are found", held[k]["recall"])
    return models[-1]


def _grown(state: DataFrame, depth: int, rate: float, l2: float) -> list[dict]:
    """The next tree of each model by Newton steps, a job a level: sums by (model, node, feature, bin) give the splits and the values of their
    sides. Model m does not see the rows of fold m. state: binned rows with each model's margin so far."""
    trees: list[dict] = [{"value": 0.0} for _ in range(FOLDS + 1)]
    open_nodes = [[(tree, F.lit(True))] for tree in trees]
    state = state.withColumn("p", F.transform("margins", lambda m: 1 / (1 + F.exp(-m))))
    for _ in range(depth):
        each = []
        for m, nodes in enumerate(open_nodes):
            node = F.lit(-1)
            for i, (_, where) in enumerate(nodes):
                node = F.when(where, i).otherwise(node)
            q = F.get("p", F.lit(m))
            each.append(F.struct(F.lit(m).alias("model"), F.when(F.col("fold") == m, -1).otherwise(node).alias("node"), (F.col("bad") - F.col("n") * q).alias("g"), (F.col("n") * q * (1 - q)).alias("h")))
        at = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES))
        rows = state.select(F.explode(F.array(*each)).alias("x"), at.alias("at")).where("x.node >= 0").select("x.*", F.explode("at").alias("at"))
        sums = rows.groupBy("model", "node", "at.feature", "at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # bounded: models x nodes x features x bins
        following: list[list] = [[] for _ in trees]
        for m, nodes in enumerate(open_nodes):
            for i, (at_node, where) in enumerate(nodes):
                best = _split([r for r in sums if r["model"] == m and r["node"] == i], l2)
                if best is None:
                    continue
                f, b, left, right = best
                at_node.pop("value")
                at_node |= {"feature": f, "bin": b, "left": {"value": rate * left}, "right": {"value": rate * right}}
                following[m] += [(at_node["left"], where & (F.col(f) <= b)), (at_node["right"], where & (F.col(f) > b))]
        open_nodes = following
        if not any(open_nodes):
            break
    return trees


def _split(sums: list, l2: float) -> tuple[str, int, float, float] | None:
    """(feature, bin, value at or below the bin, value above) of the largest gain, of equals the first; None if nothing gains."""
    best, least = None, 1e-6
    for f in FEATURES:
        own = sorted(((r["bin"], r["g"], r["h"]) for r in sums if r["feature"] == f))
        g, h = sum(x[1] for x in own), sum(x[2] for x in own)
        gl = hl = 0.0
        for b, gb, hb in own[:-1]:
            gl, hl = gl + gb, hl + hb
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
            if gain > least:
                best, least = (f, b, gl / (hl + l2), (g - gl) / (h - hl + l2)), gain
    return best


def _held_out(state: DataFrame) -> list[dict]:
    """For each number of trees: n, bad, recall, precision and mean loss over all rows, each judged by the model that has not seen its fold."""
    judged_ = state.select("n", "bad", F.posexplode("unseen").alias("k", "m"))
    loss = F.col("n") * F.log1p(F.exp(F.col("m"))) - F.col("bad") * F.col("m")
    rows = judged_.groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(loss).alias("loss"), F.sum(F.when(F.col("m") >= 0, F.col("bad")).otherwise(0)).alias("hit"), F.sum(F.when(F.col("m") >= 0, F.col("n")).otherwise(0)).alias("blocked"))
    return [{"n": r["n"], "bad": r["bad"], "recall": r["hit"] / r["bad"] if r["bad"] else 1.0, "precision": r["hit"] / r["blocked"] if r["blocked"] else 1.0, "loss": r["loss"] / r["n"]} for r in sorted(rows.collect(), key=lambda r: r["k"])]


def weakly_labelled(urls: DataFrame, url: str = "url", words: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(url, label) for want of labelled URLs: 1 where the host has one of `words` (default JUNK_WORDS) between dots, hyphens and digits;
    0 where the host is plain, i.e. of letters and dots only, and has none; null elsewhere (joined or numbered names without a listed
    word, no host)."""
    h = host(F.col(url))
    listed = sorted({w for ws in (JUNK_WORDS if words is None else words).values() for w in ws})
    junk = F.arrays_overlap(F.split(h, "[^a-z]+"), F.array(*(F.lit(w) for w in listed)).cast("array<string>"))
    return urls.select(F.col(url).alias("url"), F.when(junk, 1).when(h.rlike("^[a-z.]+$"), 0).alias("label"))


def judged(urls: DataFrame, rules: list[Rule], model: Model | None, url: str = "url", least: float = 0.5) -> DataFrame:
    """`urls` with host, path, rule, score (the trees' probability of a bad URL) and verdict: the rule's, else block where
    the score is at least `least`. Null urls and urls without :// have empty host and path, and are judged by the trees
    like any other. Without a model the score is 0. Repeated rows fare alike; an empty table gives an empty one; URLs may be of any
    length. New columns replace columns of the same name."""
    own = urls.select(F.struct(*(c for c in urls.columns if c.lower() not in ("host", "path", "rule", "score", "verdict"))).alias("row"), F.col(url).alias("url"))
    if model:  # the row is kept whole aside, so that no feature's name clashes with its columns
        scored = model.featured(own).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    else:
        scored = own.withColumn("score", F.lit(0.0))
    scored = scored.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = rule(rules, F.col("host"), F.col("path"))
    return scored.select("row.*", "host", "path", name.alias("rule"), "score", F.coalesce(verdict, F.when(F.col("score") >= least, "block").otherwise("allow")).alias("verdict"))
