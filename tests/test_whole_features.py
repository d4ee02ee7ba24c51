"""The text queries use the reference's features: words, pairs of words and runs of 3 to 4 characters."""

import pytest
from test_catalogue import FOLDER

from trialforge.operators import text_ml
from trialforge.plans import texts


class Enough(Exception):
    pass


@pytest.mark.parametrize("name", ["text_classifiers", "calibrated_text"])
def test_features_of_the_reference(spark, monkeypatch, name):
    seen = {}

    def vectors(rows, fit_on, **options):
        seen.update(options)
        raise Enough

    monkeypatch.setattr(text_ml, "vectors", vectors)
    with pytest.raises(Enough):
        texts.QUERIES[name](spark, FOLDER)
    assert seen["words"] >= 800 and seen["n"] >= 2 and seen["min_df"] == 1
    assert seen["chars"][0] <= 3 and seen["chars"][1] >= 4
