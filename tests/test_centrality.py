"""Path centralities against plain searches from every node."""

import heapq
import math
import random
from collections import defaultdict

import pytest

from casegraph.operators import centrality as C


def graph(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in rows], "a long, b long, weight double")


def random_graph(n, m, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} | {(n + 1, n + 2), (n + 2, n + 3)}
    return [(a, b, r.choice([1, 2, 4])) for a, b in sorted(pairs)]


def search(near, s):
    """Distances, path counts and dependencies from one node; lengths are exact binary fractions, so ties are exact."""
    dist, sigma, order, before = {}, defaultdict(float), [], defaultdict(list)
    best, heap = {s: 0.0}, [(0.0, s)]
    sigma[s] = 1.0
    while heap:
        d, v = heapq.heappop(heap)
        if v in dist or d > best[v]:
            continue
        dist[v] = d
        order.append(v)
        for w, x in near[v]:
            if w not in dist and d + x < best.get(w, math.inf):
                best[w], before[w], sigma[w] = d + x, [v], sigma[v]
                heapq.heappush(heap, (d + x, w))
            elif w not in dist and d + x == best[w]:
                before[w].append(v)
                sigma[w] += sigma[v]
    delta = defaultdict(float)
    for w in reversed(order):
        for v in before[w]:
            delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
    delta.pop(s, None)
    return dist, delta


def brute(rows, weighted):
    near = defaultdict(list)
    for a, b, w in rows:
        near[a].append((b, 1 / w if weighted else 1.0))
        near[b].append((a, 1 / w if weighted else 1.0))
    hops = {v: [(w, 1.0) for w, _ in x] for v, x in near.items()}
    n, score, close = len(near), defaultdict(float), {}
    for s in near:
        for v, x in search(near, s)[1].items():
            score[v] += x / ((n - 1) * (n - 2))
        dist = search(hops, s)[0]
        r, total = len(dist) - 1, sum(dist.values())
        close[s] = r / total * r / (n - 1) if total else 0.0
    return {v: (score[v], close[v]) for v in near}


@pytest.mark.parametrize("weighted", [False, True])
def test_exact_centralities(spark, weighted):
    rows = random_graph(24, 40, 4)
    got = {r.id: (r.betweenness, r.closeness) for r in C.path_centralities(graph(spark, rows), weighted=weighted).collect()}
    want = brute(rows, weighted)
    assert got.keys() == want.keys()
    for v, x in want.items():
        assert got[v] == pytest.approx(x, abs=1e-12)


def test_sampled_betweenness_keeps_its_bound(spark):
    rows = random_graph(60, 110, 5)
    want = brute(rows, False)
    got = {r.id: r for r in C.path_centralities(graph(spark, rows), weighted=False, most_pivots=40).collect()}
    error = C.pivot_error(len(want), 40)
    assert 0 < error < 0.5 and all(abs(got[v].betweenness - x[0]) <= error for v, x in want.items())
    assert C.pivot_error(10, 10) == 0.0
    assert all(got[v].closeness == pytest.approx(x[1], rel=0.1) for v, x in want.items())


def test_hyperball_is_within_the_sketch_error(spark):
    rows = random_graph(400, 700, 6)
    want = brute(rows, False)
    got = {r.id: r.closeness for r in C.hyperball(graph(spark, rows), precision=10).collect()}
    assert got.keys() == want.keys()
    assert all(got[v] == pytest.approx(x[1], rel=4 * 1.04 / 2**5) for v, x in want.items())
    small = {r.id: r.closeness for r in C.hyperball(graph(spark, random_graph(24, 40, 4))).collect()}
    assert all(small[v] == pytest.approx(x[1], abs=1e-6) for v, x in brute(random_graph(24, 40, 4), False).items())  # such balls are counted


def test_loops_parallels_nulls_and_none(spark):
    rows = [(1, 2, 1), (1, 2, 3), (2, 3, 1), (3, 3, 1)]
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in [*rows, (None, 4, 1)]], "a long, b long, weight double")
    got = {r.id: (r.betweenness, r.closeness) for r in C.path_centralities(e).collect()}
    assert got == {1: (0.0, 2 / 3), 2: (1.0, 1.0), 3: (0.0, 2 / 3)}
    empty = e.limit(0)
    assert C.path_centralities(empty).count() == 0 and C.hyperball(empty).count() == 0
