import random

import model
import pytest

from trialforge.operators import hierarchy as h


def links(spark, given):
    return spark.createDataFrame([(i, p) for i, p in given.items()], "id string, parent string")


def shapes():
    r = random.Random(5)
    yield "forest", {f"n{i}": f"n{r.randrange(i)}" if i > 3 else None for i in range(200)}
    yield "chain", {f"n{i}": f"n{i - 1}" if i else None for i in range(70)}
    yield "star", {"hub": "top", "top": None} | {f"n{i}": "hub" for i in range(300)}
    yield "anything", {f"n{i}": r.choice([None, "gone", *[f"n{r.randrange(120)}"] * 4]) for i in range(120)}
    yield "rings", {f"n{i}": f"n{(i + 1) % 37}" for i in range(37)} | {f"t{i}": f"t{i - 1}" if i else "n5" for i in range(50)} | {"self": "self", "under": "self"}
    yield "two", {"a": "b", "b": "a", "c": None}


@pytest.mark.parametrize("name, given", list(shapes()))
def test_matches_the_model(spark, name, given):
    got = {tuple(r) for r in h.hierarchy(links(spark, given)).collect()}
    assert got == model.tree(given)


@pytest.mark.parametrize("name, given", list(shapes())[:5])
def test_closure_and_paths(spark, name, given):
    nodes, paths = h.ancestor_paths(links(spark, given))
    want = {i: (root, d) for i, root, d, _, s in model.tree(given) if s == 0}
    full = {r.candidate_id: (r.node_depth, r.node_path) for r in h.full_paths(links(spark, given)).collect()}
    assert full.keys() == want.keys()
    for i, (d, p) in full.items():
        steps = p.split("/")
        assert len(steps) == d + 1 and d == want[i][1] and steps[0] == want[i][0] and steps[-1] == i
        assert all(given[b] == a for a, b in zip(steps, steps[1:]))
    assert h.closure(nodes, paths).count() == sum(d for _, d in want.values())


def test_empty_and_nulls(spark):
    schema = "candidate_id string, parent_ids array<string>, id string, parent string"
    assert h.hierarchy(h.first_parents(spark.createDataFrame([], schema))).count() == 0
    rows = [(" A", None, "x", "x"), ("a", [], "x", "x"), ("A\t", [None, " ", " B "], "x", "x"), ("b", ["a "], "x", "x"), (None, ["a"], "x", "x"), (" ", ["a"], "x", "x"), ("c", ["B", "zzz"], "x", "x"), ("c", ["B"], "x", "x")]
    got = {tuple(r) for r in h.hierarchy(h.first_parents(spark.createDataFrame(rows, schema))).collect()}
    assert got == {("a", "", -1, -1, 1), ("b", "", -1, -1, 1), ("c", "", -1, 0, 2)}
