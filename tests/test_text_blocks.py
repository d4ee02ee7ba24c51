"""Counts of terms: found once for each distinct word of many texts, kept in blocks of rows, equal to a plain count."""

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from test_catalogue import FOLDER

from trialforge.functions import linear, terms
from trialforge.operators import text_ml
from trialforge.plans import texts

TEXTS = [
    "the loss fell, the loss fell again", "", "  ", " größe a the loss\x1cfell\x85again. ", "損失が下がった。 the,loss", "x the x loss", "the", "loss",
    "fell the loss_1 a-b the=loss fell fell fell", "　the\0loss again again\n", "\U0001f600\U0001f600\U0001f600 the loss " * 40, "a b c",
]
KINDS = [terms.Kind("words", 9, 1, 3), terms.Kind("chars", 9, 3, 4)]


def plain(text):
    """Runs of 1 to 3 words and runs of 3 to 4 characters of a text, by slices."""
    words = terms.WORD.findall(text)
    padded = [f" {w} " for w in text.split()]
    chars = [w for w in padded if len(w) < 3] + [w[i : i + k] for w in padded for k in (3, 4) for i in range(len(w) - k + 1)]
    return Counter(" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)), Counter(chars)


@pytest.mark.parametrize(("docs", "size"), [(512, 1 << 20), (3, 40), (1, 1)], ids=["whole", "pieces", "single"])
def test_counts_as_of_a_plain_count(monkeypatch, docs, size):
    monkeypatch.setattr(terms, "DOCS", docs)
    monkeypatch.setattr(terms, "CHARS", size)
    monkeypatch.setattr(terms, "BYTES", size)
    monkeypatch.setattr(terms, "ROWS", size)
    wanted = [plain(t) for t in TEXTS]
    every = [sum((w[i] for w in wanted), Counter()) for i in range(2)]
    text = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["_text"])
    single, longer = [Counter(), Counter()], Counter()
    for x in terms._single(KINDS)([x.filter(pc.not_equal(x.column(0), "")) for x in terms._spaced([text])]):
        for kind, term, uses in zip(*[x.column(c).to_pylist() for c in ("kind", "term", "uses")]):
            single[kind][term] += uses
    assert single[0] == Counter({t: n for t, n in every[0].items() if " " not in t}) and single[1] == every[1]
    for x in terms._longer(list(single[0]), 1)([text]):
        longer.update(dict(zip(*[x.column(c).to_pylist() for c in ("term", "uses")])))
    assert longer == Counter({t: n for t, n in every[0].items() if t.count(" ") == 1})

    vocabulary = [sorted(x) for x in every]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array([i % 4 != 3 for i in range(len(TEXTS))]), pa.array(TEXTS)], names=["id", "_fit", "_text"])
    got = {}
    for x in terms._counted(KINDS, vocabulary, 1)([rows]):
        whole = pa.RecordBatch.from_arrays([x.column(c) for c in ["id", *terms.BLOCK]], names=["id", *terms.BLOCK])
        for fit, ((ids,), (of, places, uses)) in zip(x.column("_fit").to_pylist(), terms.blocks_of(whole, 1)):
            assert all((i % 4 != 3) == fit for i in ids.to_pylist()) and len(ids) <= docs
            for i in ids.to_pylist():
                got[i] = (Counter(), Counter())
            for r, p, n in zip(of.tolist(), places.tolist(), uses.tolist()):
                kind = int(p >= len(vocabulary[0]))
                got[ids[r].as_py()][kind][vocabulary[kind][p - kind * len(vocabulary[0])]] = n
    assert got == dict(enumerate(wanted))


def test_scores_read_blocks_of_rows(spark):
    docs = texts._labelled(spark, FOLDER)
    counts = text_ml.vectors(docs, F.col("train"), **texts.FEATURES, weigh=False)
    # before a row for each text, and ten thousand rows sent to Python at once
    assert counts.table.count() < docs.count() / 4
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), linear._kept(counts.table):
        assert int(spark.conf.get(key)) == linear.SENT
        1 / 0
    assert spark.conf.get(key) == before
