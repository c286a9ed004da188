"""Cut nodes and removal impact against removal one by one."""

import random

import pytest

from casegraph.operators import blocks as B


def graph(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in rows], "a long, b long, weight double")


def parts_of(nodes, pairs):
    near = {v: set() for v in nodes}
    for a, b in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out, seen = [], set()
    for s in nodes:
        if s not in seen:
            todo, part = [s], {s}
            while todo:
                for w in near[todo.pop()] - part:
                    part.add(w)
                    todo.append(w)
            seen |= part
            out.append(part)
    return out


def joined(parts):
    return sum(len(p) * (len(p) - 1) // 2 for p in parts)


def brute(rows):
    nodes, pairs = {v for a, b, _ in rows for v in (a, b)}, [(a, b) for a, b, _ in rows]
    whole, out = parts_of(nodes, pairs), {}
    for v in nodes:
        comp = next(p for p in whole if v in p)
        after = parts_of(comp - {v}, pairs)
        out[v] = (len(whole), len(whole) - 1 + len(after), joined([comp]), joined(after), sum(len(p) == 1 for p in after))
    return out


CASES = {
    "star": [(1, i, 1) for i in range(2, 9)],
    "path": [(i, i + 1, 1) for i in range(9)],
    "bow tie": [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (5, 6, 1), (20, 21, 2)],
    "theta": [(0, 1, 1), (1, 2, 1), (0, 3, 1), (3, 2, 1), (0, 4, 1), (4, 2, 1), (2, 5, 1), (5, 6, 1), (6, 7, 1), (7, 5, 1)],
}
for _seed in range(3):
    _r = random.Random(_seed)
    CASES[f"random {_seed}"] = [(a, b, 1 + (a + b) % 3) for a, b in sorted({tuple(sorted(_r.sample(range(30), 2))) for _ in range(33)})]


def test_equals_removal_one_by_one(spark):
    rows = [(100 * i + a, 100 * i + b, w) for i, case in enumerate(CASES.values()) for a, b, w in case]
    got = B.removal_impact(graph(spark, rows)).collect()
    assert {r.id: (r.components_before, r.components_after, r.pairs_before, r.pairs_after, r.isolated) for r in got} == brute(rows)
    assert all(r.loss == pytest.approx(1 - r.pairs_after / r.pairs_before) for r in got)


def test_community_impact(spark):
    rows = CASES["random 1"] + [(100, 101, 3)]
    nodes = {v for a, b, _ in rows for v in (a, b)}
    of = {v: v % 3 for v in nodes} | {900: 1}
    community = spark.createDataFrame(list(of.items()), "id long, community long")
    got = {r.id: r for r in B.removal_impact(graph(spark, rows), community=community).collect()}
    for v in nodes:
        members, inner = {x for x in of if of[x] == of[v]}, [(a, b, w) for a, b, w in rows if of[a] == of[b] == of[v]]
        pairs = [(a, b) for a, b, _ in inner]
        before, after = joined(parts_of(members, pairs)), parts_of(members - {v}, pairs)
        alone = sorted(x for p in after if len(p) == 1 for x in p)
        total = sum(w for *_, w in inner)
        r = got[v]
        assert r.community_components_after == len(after) and r.isolated_after == alone[:10]
        assert r.community_loss == pytest.approx(1 - joined(after) / before if before else 0)
        assert r.flow_share == pytest.approx(sum(w for a, b, w in inner if v in (a, b)) / total if total else 0)


def test_targets_and_none(spark):
    e = graph(spark, CASES["star"])
    r = B.removal_impact(e, [1]).collect()
    assert len(r) == 1 and (r[0].components_after, r[0].isolated, r[0].loss) == (7, 7, 1.0)
    assert B.removal_impact(e.limit(0)).count() == 0
