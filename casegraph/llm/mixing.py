"""Mixing to target weights: token weights raked to source, language and topic marginals by iterative proportional fitting,
then documents sampled with calibrated probabilities. DataFrame operations only.

The rows are first summed into cells (source, language, topic); raking works on the cells. A hot source is a few cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.store import fresh_name, written

DIMENSIONS = ("source", "lang", "topic")
SWEEPS_A_ROUND = 4
BROADCAST_CELLS = 50_000
NONE = "(none)"


def form(text: Column) -> Column:
    """The default topic of a text, from its form: table, contact, else by length in characters."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("@"), "contact").when(F.length(t) < 1000, "note").when(F.length(t) < 4000, "article").otherwise("long")


def tokens(text: Column) -> Column:
    """Token weight of a text: its number of words between white space; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, source: str, lang: str, topic: Column, text: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the cell's keys and tokens under names that clash with none of its columns."""
    names: dict[str, str] = {}
    for c in (*DIMENSIONS, "tokens"):
        names[c] = fresh_name(f"_{c}", [*docs.columns, *names.values()])
    of = {"source": F.col(source), "lang": F.col(lang), "topic": topic}
    return docs.withColumns({**{names[c]: F.coalesce(v.cast("string"), F.lit(NONE)) for c, v in of.items()}, names["tokens"]: tokens(F.col(text))}), names


def raked(cells: DataFrame, flatten: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, sweeps: int = 12, tolerance: float = 0.0) -> DataFrame:
    """`cells` (source, lang, topic, tokens) with weight: tokens raked so that the marginal of each dimension has its target
    share of all tokens. targets[dimension]: (value, share), shares taken in proportion; values without a target, and
    dimensions not given, get the share tokens ** flatten[dimension] (1 keeps the corpus, 0 makes all values equal;
    default 0.5). Cells without tokens keep weight 0. Sweeps end when no marginal is off by more than `tolerance` of all tokens,
    or after `sweeps` sweeps: marginals that no weights can meet together stay approximate.
    """
    flatten, targets = flatten or {}, targets or {}
    state = cells.select(*DIMENSIONS, "tokens", F.col("tokens").cast("double").alias("weight"))
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("n"))
        want = F.pow(F.col("n").cast("double"), F.lit(float(flatten.get(d, 0.5))))
        if d in targets:
            given = targets[d].select(F.col("value").cast("string").alias(d), F.col("share").cast("double").alias("given"))
            sums, want = sums.join(given, d, "left"), F.coalesce("given", want)
        sums = sums.select(d, F.when(F.col("n") > 0, want).otherwise(0.0).alias(f"t_{d}"))
        total = sums.agg(F.sum(f"t_{d}").alias("t_all"))
        sums = sums.crossJoin(F.broadcast(total)).select(d, (F.col(f"t_{d}") / F.col("t_all")).alias(f"t_{d}"))  # one row: the total
        state = state.join(sums, d)
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    state = written(state.crossJoin(F.broadcast(total)), "cells")
    done = 0
    while done < sweeps:
        for _ in range(min(SWEEPS_A_ROUND, sweeps - done)):
            for d in DIMENSIONS:
                now = F.sum("weight").over(Window.partitionBy(d))
                state = state.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"t_{d}") * F.col("all") / now).otherwise(0.0))
            done += 1
        state = written(state, "raked")
        if tolerance > 0 and max(_off(state, d) for d in DIMENSIONS) <= tolerance:
            break
    return state.select(*DIMENSIONS, "tokens", "weight")


def _off(state: DataFrame, d: str) -> float:
    """By how much of all tokens the marginal of `d` misses its target at most."""
    now = state.groupBy(d).agg((F.sum("weight") / F.first("all")).alias("now"), F.first(f"t_{d}").alias("want"))
    return now.agg(F.max(F.abs(F.col("now") - F.col("want")))).head()[0] or 0.0


def probabilities(cells: DataFrame, keep: float = 0.5) -> DataFrame:
    """`cells` with probability: least(1, c * weight / tokens), c such that the expected tokens are `keep` of all
    (less only if cells without weight hold the rest). Cells without tokens get probability 1: they cost nothing."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    order = Window.orderBy(F.col("ratio").desc_nulls_last(), *DIMENSIONS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("ratio", ratio)
    c = c.withColumns({"t_above": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "w_above": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    sums = c.agg(F.sum("tokens").alias("t_all"), F.sum("weight").alias("w_all"))
    c = c.crossJoin(F.broadcast(sums))  # one row: the totals
    # the cells above are certain; c spreads what is left of the budget over the others
    c = c.withColumn("c", (keep * F.col("t_all") - F.col("t_above")) / (F.col("w_all") - F.col("w_above")))
    factor = c.where((F.col("tokens") > 0) & (F.col("weight") > 0) & (F.col("c") * F.col("ratio") <= 1) & (F.col("c") > 0)).agg(F.max("c").alias("factor"))
    chosen = c.crossJoin(F.broadcast(factor))
    p = F.when(F.col("tokens") == 0, 1.0).when(F.col("weight") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("factor") * F.col("ratio"), F.lit(1.0))))
    return chosen.select(*DIMENSIONS, "tokens", "weight", p.alias("probability"))


def draw(doc_id: str) -> Column:
    """A number in [0, 1) that is fixed by the document's id; of a null id: by the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mixed(
    docs: DataFrame, source: str = "source", lang: str = "lang", topic: Column | None = None, text: str = "text", doc_id: str = "doc_id", keep: float = 0.5, flatten: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, sweeps: int = 12, select_only: bool = False
) -> DataFrame:
    """`docs` with topic, tokens, weight (tokens wanted per token there), probability and sampled; with select_only just the
    sampled rows with their own columns. Null sources, languages and topics are a value of their own, "(none)". Rows that
    repeat a doc_id fare alike. An empty table gives an empty one; new columns replace columns of the same name."""
    topic = form(F.col(text)) if topic is None else topic
    keyed, n = _keyed(docs, source, lang, topic, text)
    cells = keyed.groupBy(*(F.col(n[d]).alias(d) for d in DIMENSIONS)).agg(F.sum(n["tokens"]).alias("tokens"))
    fitted = probabilities(raked(written(cells, "cells"), flatten, targets, sweeps), keep)
    wanted = {x: fresh_name(f"_{x}", [*keyed.columns, "_weight", "_probability"]) for x in ("weight", "probability")}
    fitted = written(fitted.select(*(F.col(d).alias(n[d]) for d in DIMENSIONS), F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias(wanted["weight"]), F.col("probability").alias(wanted["probability"])), "mix")
    if fitted.count() <= BROADCAST_CELLS:
        fitted = F.broadcast(fitted)
    own = keyed.join(fitted, [n[d] for d in DIMENSIONS])
    sampled = draw(doc_id) < F.col(wanted["probability"])
    if select_only:
        return own.where(sampled).select(*docs.columns)
    new = {"topic": F.col(n["topic"]), "tokens": F.col(n["tokens"]), "weight": F.col(wanted["weight"]), "probability": F.col(wanted["probability"]), "sampled": sampled}
    return own.select(*(c for c in docs.columns if c.lower() not in new), *(v.alias(k) for k, v in new.items()))
