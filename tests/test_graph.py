import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.operators import edges as E
from casegraph.operators import graph as G
from casegraph.operators.components import components
from casegraph.operators.skew import spread_join
from casegraph.plans import detectors as D
from casegraph.plans import scoring as S


def graph(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in rows], "a long, b long, weight double")


def barabasi(n=40, m=2, seed=1):
    r, ends, out = random.Random(seed), [0, 1], {(0, 1)}
    for v in range(2, n):
        for u in {r.choice(ends) for _ in range(m)}:
            out.add((u, v))
            ends += [u, v]
    return [(a, b, (a + b) % 5 + 1) for a, b in sorted(out)]


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1, 1) for i in range(60)] + [(100, 101 + i, 1) for i in range(40)] + [(500, 501, 1)]
    random.Random(1).shuffle(rows)
    got = {r["node"]: r["component"] for r in components(graph(spark, rows)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 141)}, 500: 500, 501: 500}
    assert components(graph(spark, []).limit(0)).collect() == []


def test_pagerank_is_the_power_iteration(spark):
    rows = barabasi()
    n = 40
    w = np.zeros((n, n))
    for a, b, x in rows:
        w[a, b] = w[b, a] = x
    p, x = w / w.sum(1, keepdims=True), np.full(n, 1 / n)
    for _ in range(200):
        x = 0.15 / n + 0.85 * x @ p
    got = {r["id"]: r["rank"] for r in G.pagerank(graph(spark, rows), rounds=60, tolerance=1e-10).collect()}
    assert max(abs(got[i] - x[i]) for i in range(n)) < 1e-6


def brute_betweenness(rows, n):
    inf = float("inf")
    near = {i: [] for i in range(n)}
    for a, b, _ in rows:
        near[a].append(b)
        near[b].append(a)
    score = dict.fromkeys(range(n), 0.0)
    for s, t in itertools.combinations(range(n), 2):
        paths, best = [], inf
        todo = [[s]]
        while todo:
            following = []
            for p in todo:
                for v in near[p[-1]]:
                    if v == t:
                        paths.append(p + [v])
                    elif v not in p:
                        following.append(p + [v])
            if paths:
                break
            todo = following
        for p in paths:
            for v in p[1:-1]:
                score[v] += 1 / len(paths)
    return {v: 2 * x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_and_closeness(spark):
    rows = barabasi(12, 2, 3)
    got = {r["id"]: r for r in G.path_centralities(graph(spark, rows), weighted=False).collect()}
    want = brute_betweenness(rows, 12)
    assert all(abs(got[i]["betweenness"] - want[i]) < 1e-9 for i in range(12))
    same = [(a, b, 1) for a, b, _ in rows]
    weighted = {r["id"]: r["betweenness"] for r in G.path_centralities(graph(spark, same), weighted=True).collect()}
    assert all(abs(weighted[i] - want[i]) < 1e-9 for i in range(12))


def test_eigenvector_by_component(spark):
    two = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (10, 11, 1), (11, 12, 1), (10, 12, 1), (20, 21, 1)]
    got = {r["id"]: r["eigenvector"] for r in G.eigenvector(graph(spark, two)).collect()}
    assert got[20] == 0 and got[0] == pytest.approx(3**-0.5 * 3 / 8, abs=1e-6) and got[10] == pytest.approx(got[0])


def test_protected_parties_are_in_no_community(spark):
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (9, 1), (9, 2), (9, 4), (9, 5), (9, 7)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, weight double")
    of = {r["id"]: r["community"] for r in G.louvain(e, protected=spark.createDataFrame([(9,)], "id long")).collect()}
    assert of[9] == -1 and of[1] == of[2] == of[3] and of[4] == of[5] == of[6] and len({of[1], of[4], of[7]}) == 3 and min(of[1], of[4], of[7]) == 0


def test_louvain_finds_planted_groups(spark):
    rows = [(g * 10 + i, g * 10 + j, 1) for g in range(4) for i in range(6) for j in range(i)] + [(g * 10, (g + 1) % 4 * 10, 1) for g in range(4)]
    of = G.louvain(graph(spark, rows))
    got = {}
    for r in of.collect():
        got.setdefault(r["community"], set()).add(r["id"] // 10)
    assert len(got) == 4 and all(len(v) == 1 for v in got.values())
    assert G.modularity(graph(spark, rows), of) > 0.65


def test_paths_are_shortest_and_simple(spark):
    rows = [(1, 2, 1), (2, 3, 1), (1, 4, 1), (4, 3, 1), (3, 5, 1), (2, 4, 1)]
    got = [(r["length"], r["path"]) for r in G.paths(graph(spark, rows), 1, 5).collect()]
    assert got == [(3, "1>2>3>5"), (3, "1>4>3>5"), (4, "1>2>4>3>5")]


def test_merge_is_the_whole_and_symmetric_ends_meet(spark):
    o = spark.createDataFrame([("b", "a", "MET", 1.0, None, 0.5, None, None, None, "x", 2), ("a", "b", "MET", 2.0, None, 0.9, 5.0, 3, True, "y", 1), ("a", "a", "MET", 1.0, None, 0.5, None, None, None, "z", 0)], "src string, dst string, rel_type string, weight double, at timestamp_ntz, confidence double, amount double, duration long, night boolean, attr string, order long")
    whole = E.accumulate(o).collect()
    assert len(whole) == 1 and (whole[0]["src"], whole[0]["weight"], whole[0]["count"], whole[0]["attr"]) == ("a", 3.0, 2, "y")
    both = E.merged(E.accumulate(o.where("order = 1")), E.accumulate(o.where("order = 2"))).collect()
    assert both == whole


def test_projection_folds_phones_and_leaves_banks_out(spark):
    ents = spark.createDataFrame([("p1", "PERSON", "A"), ("p2", "PERSON", "B"), ("o1", "ORGANIZATION", "State Bank"), ("n1", "PHONE", "1"), ("n2", "PHONE", "2"), ("c", "CASE", "C")], "id string, type string, label string")
    e = spark.createDataFrame([("p1", "n1", "USES_PHONE", 1, 0.0, 0), ("p2", "n2", "USES_PHONE", 1, 0.0, 0), ("n1", "n2", "CALLED", 9, 0.0, 4), ("p1", "o1", "OWNS", 1, 0.0, 0), ("p1", "c", "ACCUSED_IN", 1, 0.0, 0), ("p2", "c", "ACCUSED_IN", 1, 0.0, 0)], "src string, dst string, rel_type string, count long, total_amount double, night_count long")
    rows = E.projection(ents, e).collect()
    assert [(r["a"], r["b"], r["weight"], r["calls"], r["night_calls"], r["channels"]) for r in rows] == [("p1", "p2", 4.0, 9, 4, "calls=1,shared_case=1")]


def test_protected_parties_score_zero_everywhere(spark):
    s = spark.createDataFrame([(1, 5, True), (2, 5, False)], "id long, accused long, protected boolean").withColumns({c: F.lit(0) for c in ("surveillance", "intel", "unverified", "international", "anomaly", "wanted", "convicted", "offshore")}).withColumns({"watchlist": F.lit("wanted"), "non_subject": F.lit(False)})
    got = {r["id"]: r for r in S.suspicion(s).collect()}
    assert got[1]["suspicion"] == 0 and got[1]["reasons"] == [] and got[2]["suspicion"] == 1.0 and "named as accused" in got[2]["reasons"]
    m = S.suspicion(s).withColumn("priority", S.priority(F.lit(1.0), F.col("suspicion"), F.col("protected")))
    assert [r["id"] for r in S.key_players(m).collect()] == [2]


def test_clean_mule_near_three_offenders(spark):
    e = graph(spark, [(1, 9, 1), (2, 9, 1), (3, 9, 1), (1, 8, 1), (2, 8, 1), (3, 8, 1)]).withColumn("channels", F.lit("calls=1"))
    s = spark.createDataFrame([(1, 0.6, False), (2, 0.6, False), (3, 0.6, False), (9, 0.0, False), (8, 0.0, True)], "id long, suspicion double, protected boolean").withColumns({"accused": F.lit(0), "watchlist": F.lit(None).cast("string")})
    got = {r["id"]: r["risk"] for r in S.first_time_risk(e, s).collect()}
    assert got.get(9, 0) >= 0.85 and 8 not in got


def test_detectors_are_isolated_and_alerts_keep_status(spark):
    own = D.ownership_conflicts(spark.createDataFrame([("car", "a"), ("car", "b"), ("van", "a")], "asset string, owner string"))
    found, failed = D.run_all({"ok": lambda: D.alerts(own, "ownership_conflict", ["asset"], F.col("asset")), "bad": lambda: own.select("nope")})
    assert list(failed) == ["bad"] and found.where("kind = 'detector_error'").select("title", "score", "severity").collect() == [("bad failed", 0.1, "low")]
    found = found.where("kind <> 'detector_error'")
    assert found.count() == 1
    stored = found.withColumns({"status": F.lit("closed"), "review_status": F.lit("reviewed")})
    assert [(r["status"], r["review_status"]) for r in D.persisted(stored, found).collect()] == [("closed", "reviewed")]
    assert D.persisted(stored.withColumn("status", F.lit("open")), found.limit(0)).count() == 0 and D.persisted(stored, found.limit(0)).count() == 1
    assert D.anomaly_hits(found).head()["anomaly"] == pytest.approx(0.6)


def test_a_detector_that_fails_at_run_time_stops_no_other(spark):
    rows = spark.range(3).select(F.col("id").cast("string"), F.lit(0.5).alias("score"))
    ok = lambda: D.alerts(rows, "good", ["id"], F.col("id"))
    late = lambda: D.alerts(rows.withColumn("score", F.raise_error(F.lit("late")).cast("double")), "worse", ["id"], F.col("id"))
    found, failed = D.run_all({"late": late, "ok": ok})
    assert list(failed) == ["late"] and sorted(r["kind"] for r in found.collect()) == ["detector_error"] + ["good"] * 3
    assert found.select("id").distinct().count() == 4
    assert D.anomaly_hits(found).count() == 3


def test_burner_attribution_prefers_shared_handsets(spark):
    b = spark.createDataFrame([("x", "c1", "t1"), ("x", "c2", "t1")], "phone string, contact string, tower string")
    p = spark.createDataFrame([("ann", "c1", "t1"), ("ann", "c2", "t1"), ("bob", "c9", "t1")], "person string, contact string, tower string")
    none = spark.createDataFrame([], "phone string, person string")
    r = D.burner_attribution(b, p, none).head()
    assert (r["person"], r["score"]) == ("ann", pytest.approx(1.0))
    shared = spark.createDataFrame([("x", "zed")], "phone string, person string")
    assert D.burner_attribution(b, p, shared).head()["score"] == pytest.approx(1.0)


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([(i, 7 if i % 2 else i % 13) for i in range(3000)], "id long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(13)], "k long, v string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = spread_join(rows, table, "k", counts, 3000, F.xxhash64("id"))
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, rows.join(table, "k").select("id", "k", "v").collect()))


def test_isolation_forest_isolates():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(200, 3)), [[9, 9, 9]]])
    s = G.isolation_scores(x, trees=100)
    assert s.argmax() == 200 and s[200] > 0.6


def test_running_sums_over_ranges(spark):
    from casegraph.operators.prefix import numbered, running

    rows = [(i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = running(df, ["k"], {"s": "v"}).collect()
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert {r["k"]: r["s"] for r in got} == want
    assert sorted((r["k"], r["i"]) for r in numbered(df, ["k"]).collect()) == [(i, i) for i in range(1000)]
    assert numbered(df.limit(0), ["k"]).collect() == []
