"""Descendants of candidates below a ring are finite and count too."""

import pytest
from test_hierarchy import links, shapes

from trialforge.operators import hierarchy as h


def pairs(given):
    out = set()
    for i in given:
        seen, at = [i], given[i]
        while at in given and at not in seen:
            seen.append(at)
            at = given[at]
        # `at` is the first node met twice: from its place on, the nodes are a ring
        off = seen[: seen.index(at)] if at in seen else seen
        if off:
            out |= {(a, i, k) for k, a in enumerate(off) if k}
    return out


@pytest.mark.parametrize("name, given", list(shapes()))
def test_pairs_below_rings(spark, name, given):
    got = [tuple(r) for r in h.closure(*h.ancestor_paths(links(spark, given), below_rings=True)).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs(given)
