"""Components of few links cost the driver few tasks, jobs and threads, however many partitions a shuffle has."""

import uuid

import pytest

from casegraph.operators import components as module
from casegraph.operators.components import components
from casegraph.operators.store import fixed_plans

ADAPTIVE = "spark.sql.adaptive.enabled"


def spent(spark, make):
    """(jobs, tasks) of `make`."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        make()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    return len(jobs), sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_few_links_take_few_tasks(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    expected = {(i, 0) for i in range(41)} | {(90, 90), (91, 90)}
    got = []
    settings = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in [*settings, ADAPTIVE]}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        few = spent(spark, lambda: got.append(components(links).collect()))
        assert spark.conf.get(ADAPTIVE) == before[ADAPTIVE]
        monkeypatch.setattr(module, "FEW", 0)
        many = spent(spark, lambda: got.append(components(links).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all({(x["node"], x["component"]) for x in rows} == expected for rows in got)
    assert few[0] < many[0] and few[1] < 1200 < many[1]  # the links come in by one shuffle of 100 and leave by another


def test_setting_comes_back_after_a_failure(spark):
    before = spark.conf.get(ADAPTIVE)
    with pytest.raises(KeyError), fixed_plans(spark, True):
        assert spark.conf.get(ADAPTIVE) == "false"
        raise KeyError
    with fixed_plans(spark, False):
        assert spark.conf.get(ADAPTIVE) == before
    assert spark.conf.get(ADAPTIVE) == before
