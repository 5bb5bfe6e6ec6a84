"""Cycles in lineage graphs against plain peeling; long chains in few rounds."""

import random

import pytest

from helpers import rows
from millrace.operators import lineage


def peeled(edges):
    edges = set(edges)
    while True:
        out, into = {a for a, _ in edges}, {b for _, b in edges}
        kept = {(a, b) for a, b in edges if b in out and a in into}
        if kept == edges:
            return sorted(edges, key=repr)
        edges = kept


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([12, 60])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n // 2, n, int(1.4 * n)]))] + [(n + k, n + k + 1) for k in range(9)] + [(n + 9, 0)]
    got = lineage.cyclic_core(spark.createDataFrame(edges + edges[:3], "src long, dst long"))
    assert rows(got) == peeled(edges)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 jobs, one that ends in a cycle of 50, one that comes out of it: a handful of steps, not thousands."""
    steps = []
    plain = lineage.chain_ends
    monkeypatch.setattr(lineage, "chain_ends", lambda edges: steps.append(1) or plain(edges))
    chain = [(k, k + 1) for k in range(10_000)]
    assert lineage.cyclic_core(spark.createDataFrame(chain, "src long, dst long")).isEmpty() and len(steps) <= 4
    ring = [(20_000 + k, 20_000 + (k + 1) % 50) for k in range(50)]
    both = ring + [(k, k + 1) for k in range(3000)] + [(3000, 20_007)] + [(20_011, 30_000)] + [(30_000 + k, 30_001 + k) for k in range(3000)]
    assert rows(lineage.cyclic_core(spark.createDataFrame(both, "src long, dst long"))) == sorted(ring) and len(steps) <= 10


def test_empty_graph(spark):
    assert lineage.cyclic_core(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_estimates_stay_in_proportion(spark):
    """A join's estimate is the product of its sides; handed on from step to step, its digits doubled until planning took longer than the work."""
    from millrace.session import plan_bytes
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "src long, dst long")
    assert plan_bytes(lineage.chain_ends(chain)) < 1_000_000


def test_cycles_where_every_node_has_several_ways(spark):
    """No chain to merge and no node without a way on; cycles of odd length; edges from and to null belong to no cycle."""
    full = [(a, b) for a in range(5) for b in range(5) if a != b]
    odd = [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(k, 100) for k in range(90, 93)]
    graph = full + odd + [(None, 3), (3, None), (103, 200)]
    assert rows(lineage.cyclic_core(spark.createDataFrame(graph, "src long, dst long"))) == sorted(full + odd[:7], key=repr)
