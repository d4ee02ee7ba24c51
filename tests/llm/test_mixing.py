import random

import pytest

from trialforge.llm import mixing
from trialforge.llm.mixing import Leaf, allot, draw, plan, shares


def leaf(source, share, cap, tokens, domain="d", lang="en", mix="m"):
    return Leaf(mix, (domain, lang, source), share, cap, tokens)


def test_shortage_goes_to_siblings_before_ancestors():
    own = [leaf("a", 0.25, 1, 10), leaf("b", 0.25, 9, 1000), leaf("c", 0.5, 9, 1000, domain="e")]
    allot(own, 100)
    assert [x.budget for x in own] == [10, 40, 50]


def test_what_a_domain_cannot_hold_goes_on():
    own = [leaf("a", 0.25, 1, 10), leaf("b", 0.25, 1, 20), leaf("c", 0.3, 9, 1000, domain="e"), leaf("d", 0.2, 9, 1000, domain="f")]
    allot(own, 100)
    assert [round(x.budget, 6) for x in own] == [10, 20, 42, 28]


def test_default_total_is_the_largest_without_a_shortage():
    own = [leaf("a", 0.5, 2, 100), leaf("b", 0.3, 1, 1000), leaf("none", 0.2, 5, 0)]
    plan(own)
    assert own[0].budget == pytest.approx(200) and own[2].budget == 0
    assert own[1].budget == pytest.approx(200 * 0.3 / 0.5)


def test_nothing_to_draw():
    own = [leaf("a", 1.0, 3, 0)]
    plan(own)
    assert own[0].budget == 0
    plan([])


def docs(spark, sizes, seed=0):
    r = random.Random(seed)
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, r.choice([0, 1, 5, 20, 60, 200]), "en", "clash"))
            k += 1
    return rows, spark.createDataFrame(rows, "doc_id bigint, leaf string, n_tokens bigint, lang string, mix_id string").drop("mix_id")


def test_draw_against_brute_force(spark):
    rows, df = docs(spark, {"a": 300, "b": 40, "c": 7})
    tokens = {s: sum(n for _, x, n, *_ in rows if x == s) for s in "abc"}
    own = [leaf("a", 0.5, 1, tokens["a"]), leaf("b", 0.3, 4, tokens["b"], domain="e"), leaf("c", 0.2, 6, tokens["c"], domain="f")]
    plan(own)
    out = draw(df, own, seed=1).cache()
    size = {k: n for k, _, n, *_ in rows}
    got = {x.path[-1]: 0 for x in own}
    for r in out.collect():
        cap = next(x.cap for x in own if x.path[-1] == r.leaf)
        assert 1 <= r.n_repeats <= cap and r.n_tokens == size[r.doc_id] > 0
        got[r.leaf] += r.n_repeats * r.n_tokens
    assert len({(r.mix_id, r.doc_id) for r in out.collect()}) == out.count()
    total = sum(got.values())
    for x in own:
        assert got[x.path[-1]] <= x.budget + 1e-6
        assert got[x.path[-1]] / total == pytest.approx(x.share, abs=0.01)
    again = [leaf("a", 0.5, 1, tokens["a"]), leaf("b", 0.3, 4, tokens["b"], domain="e"), leaf("c", 0.2, 6, tokens["c"], domain="f")]
    plan(again)
    assert {tuple(r) for r in draw(df.repartition(7), again, seed=1).collect()} == {tuple(r) for r in out.collect()}
    table = {r.leaf: r for r in shares(out, own).collect()}
    assert {k: r.tokens for k, r in table.items()} == got and sum(r.actual_share for r in table.values()) == pytest.approx(1)


def test_one_text_that_is_most_of_a_source(spark):
    df = spark.createDataFrame([(0, "a", "en", 9000), *[(k, "a", "en", 10) for k in range(1, 100)], (500, "b", "en", 3000)], "doc_id bigint, leaf string, lang string, n_tokens bigint")
    own = [leaf("a", 0.5, 3, 9990), leaf("b", 0.5, 1, 3000, domain="e")]
    plan(own)
    out = draw(df, own)
    # the long text fits nowhere; the others are used once, and none twice before it, so the rest of the budget is the gap
    assert {r.doc_id: r.n_repeats for r in out.where("leaf = 'a'").collect()} == {k: 1 for k in range(1, 100)}
    assert {r.leaf: r.gap for r in shares(out, own).collect()} == {"a": 2010, "b": 0}


def test_languages_are_leaves_and_their_rests_are_drawn_together(spark):
    r = random.Random(8)
    rows = [(k, "a", lang, r.choice([3, 30, 90])) for k, lang in enumerate(["en"] * 200 + ["de"] * 60 + [""] * 3)]
    rows += [(k, "b", "fr", r.choice([3, 30, 90])) for k in range(1000, 1080)]
    df = spark.createDataFrame(rows, "doc_id bigint, leaf string, lang string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.7, 2), ("m", "b", 0.2, 9), ("m", "none", 0.1, 9)], "mix_id string, leaf string, target_share double, max_repeats bigint")
    own = mixing.leaves_of(targets, df.groupBy("leaf", "lang").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "tokens"))
    assert [x.path for x in own] == [("a", "", "a"), ("a", "de", "a"), ("a", "en", "a"), ("b", "fr", "b"), ("none", "", "none")]
    plan(own)
    table = {x.leaf: x for x in shares(draw(df, own, 2), own).collect()}
    for name in "ab":
        got = {x.doc_id: x.n_repeats for x in draw(df, mixing_again(targets, df), 2).where(f"leaf = '{name}'").collect()}
        unused = [n for k, s, _, n in rows if s == name and got.get(k, 0) == min(got.get(k2, 0) for k2, s2, *_ in rows if s2 == name)]
        assert 0 <= table[name].gap < min(unused) + 1 and max(got.values()) - min(got.get(k, 0) for k, s, *_ in rows if s == name) <= 1
    assert table["none"].tokens == 0


def mixing_again(targets, df):
    own = mixing.leaves_of(targets, df.groupBy("leaf", "lang").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "tokens"))
    plan(own)
    return own


def test_domains_come_from_a_table(spark):
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_id string, leaf string, target_share double, max_repeats bigint")
    sizes = spark.createDataFrame([("a", "en", 5), ("b", "en", 5)], "leaf string, lang string, tokens bigint")
    domains = spark.createDataFrame([("a", "web")], "leaf string, domain string")
    assert [x.path for x in mixing.leaves_of(targets, sizes, domains)] == [("b", "en", "b"), ("web", "en", "a")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, leaf string, lang string, n_tokens bigint")
    own = [leaf("a", 1.0, 3, 0)]
    plan(own)
    out = draw(none, own)
    assert out.collect() == [] and [r.tokens for r in shares(out, own).collect()] == [0]


def test_prefix_cuts_are_exact_over_slices(spark):
    rows, df = docs(spark, {"a": 3000}, 4)
    total = sum(n for _, _, n, *_ in rows)
    own = [Leaf("m", ("d", "en", "a"), 1.0, 1, total, budget=total * 0.37)]
    out = draw(df, own, seed=5)
    assert 0 <= total * 0.37 - sum(r.n_tokens for r in out.collect()) < 1
