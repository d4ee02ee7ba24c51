"""All queries outside the subpackage for text problems."""

from __future__ import annotations

from trialforge.plans import general, lab, reference, texts

QUERIES = {**general.QUERIES, **reference.QUERIES, **lab.QUERIES, **texts.QUERIES}
ORACLE = {**general.ORACLE, **reference.ORACLE, **lab.ORACLE, **texts.ORACLE}
