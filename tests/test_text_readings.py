"""Scores of the classifiers: in few readings of the texts, and those of the classifiers' own guesses."""

import pytest
from test_catalogue import FOLDER

from trialforge.plans import texts


def test_scores_in_few_readings(spark):
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    scores = {r.kind: r for r in texts.text_scores(spark, FOLDER).collect()}
    assert len(jobs() - before) < 80
    rows = texts.text_classifiers(spark, FOLDER).collect()
    for kind, score in scores.items():
        pairs = [(r.label, r.prediction) for r in rows if r.kind == kind]
        every = {x for p in pairs for x in p}
        f1 = [2 * sum(p == (y, y) for p in pairs) / sum(x == y for p in pairs for x in p) for y in every]
        assert score.macro_f1 == pytest.approx(sum(f1) / len(f1)) and score.n_rows == len(pairs)
        assert score.accuracy == pytest.approx(sum(x == y for x, y in pairs) / len(pairs))
