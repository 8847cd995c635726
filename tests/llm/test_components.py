"""Components of small graphs, in one task, and of large ones, by stars."""

import random

import pytest

from ctxloom.llm import simhash


def plain_roots(links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def graph(rng):
    """A chain, a star, a clique, pairs, loops and repeated links, over negative and large ids."""
    ids = list({rng.getrandbits(64) - (1 << 63) for _ in range(400)})
    chain = list(zip(ids[:120], ids[1:121], strict=True))
    star = [(ids[130], x) for x in ids[131:230]]
    clique = [(x, y) for x in ids[240:252] for y in ids[240:252] if x < y]
    pairs = list(zip(ids[260:320:2], ids[261:321:2], strict=True))
    links = chain + star + clique + pairs + [(ids[350], ids[350])] + pairs[:5] + [(b, a) for a, b in pairs[5:9]]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("bound", [0, 1 << 19])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "TASK_LINKS", bound)
    links = graph(random.Random(5))
    got = simhash.connected(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert {r.node: r.root for r in got} == plain_roots(links) and len(got) == len({r.node for r in got})


def test_small_graphs_take_few_stages(spark):
    """The stars took some ten stages a round, each of as many tasks as there are partitions."""
    tracker, links = spark.sparkContext.statusTracker(), graph(random.Random(6))
    frame = spark.createDataFrame(links, "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    simhash.connected(frame).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("components")) <= 8


def test_no_links(spark):
    assert simhash.connected(spark.createDataFrame([], "a long, b long")).collect() == []
