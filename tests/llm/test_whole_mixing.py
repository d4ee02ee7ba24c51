"""A source that limits a mix is drawn exactly as often as its cap, whatever the rounding of its budget."""

import random

from trialforge.llm.mixing import Leaf, draw, plan


def test_limiting_source_gets_whole_epochs():
    r = random.Random(3)
    for _ in range(2000):
        sizes = [r.randrange(1, 10**6) for _ in range(5)]
        leaves = [Leaf("m", (k,), s, cap, n) for k, s, cap, n in zip("abcde", (0.1, 0.2, 0.3, 0.15, 0.25), (4, 3, 2, 5, 7), sizes)]
        plan(leaves)
        assert any(x.epochs == x.cap and x.rest == 0 for x in leaves)


def test_a_text_as_long_as_the_gap_is_drawn(spark):
    # the first text of the order fits, the second doesn't, and the third is longer than an eighth of what is left
    docs = spark.createDataFrame([(k, "a", "", n) for k, n in enumerate([40, 90, 50, 60, 70, 30, 80, 20, 45, 55])], "doc_id bigint, leaf string, lang string, n_tokens bigint")
    for budget in range(100, 500, 80):
        leaf = Leaf("m", ("a",), 1.0, 1, 540, float(budget))
        got = {x.doc_id: x.n_tokens * x.n_repeats for x in draw(docs, [leaf]).collect()}
        gap = budget - sum(got.values())
        assert 0 <= gap < min(n for k, n in ((r.doc_id, r.n_tokens) for r in docs.collect()) if k not in got)
