"""Connected components against a plain search, and the number of rounds that they take."""

import random

import pytest

from wearpath.llm import components as module


def _plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for first in sorted(near):
        todo = [] if first in found else [first]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = first
                todo += near[node]
    return found


def _edges():
    draw = random.Random(5)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 1000 + i) for i in range(50)]
    loose = [(draw.randrange(2000, 2100), draw.randrange(2000, 2100)) for _ in range(60)]
    edges = path + star + loose + [(-3, 5), (5, -3), (9, 9), (None, 4), (4, None), (1 << 62, -(1 << 62))]
    draw.shuffle(edges)
    return edges


@pytest.mark.parametrize("per_task", [8, 60, 1000])
def test_components_do_not_depend_on_what_a_task_holds(spark, per_task):
    edges = _edges()
    rows = module.components(spark.createDataFrame(edges, "a long, b long").repartition(5), per_task).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.component for r in rows} == _plain(edges)


def test_components_of_no_edges(spark):
    assert module.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_long_path_takes_no_rounds_of_joins(spark, monkeypatch):
    written = []
    monkeypatch.setattr(module, "materialise", lambda df, purpose, of=module.materialise: written.append(purpose) or of(df, purpose))
    found = module.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(301)} and len(written) == 2
