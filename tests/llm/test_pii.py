import pytest
import unseen

from trialforge.llm.pii import Finder, found, redact, redacted

CASES = [
    ("Contact: Dag Tindermoor <larkspurne-chidera@quell.example.org>, +44 (0)20 7946 0190.", [("name", "Dag Tindermoor"), ("email", "larkspurne-chidera@quell.example.org"), ("phone", "+44 (0)20 7946 0190")]),
    ("mailto:nimue [at] mail [dot] example; jo at lab dot example, x＠y.test", [("email", "nimue [at] mail [dot] example"), ("email", "jo at lab dot example"), ("email", "x＠y.test")]),
    ("SSN 914 01 4417 turned up in the sheet of Jörn T. Bergqvista.", [("id_number", "914 01 4417"), ("name", "Jörn T. Bergqvista")]),
    ("Home address on file: Flat 2, 344 Saint Orrin Ave, Tindermoor QX5 1QV", [("address", "Flat 2, 344 Saint Orrin Ave, Tindermoor QX5 1QV")]),
    ("Le disque part au 64 bis rue des Tisserands, 00383 Saint-Orens-le-Vieux. Le reste", [("address", "64 bis rue des Tisserands, 00383 Saint-Orens-le-Vieux")]),
    ("El disco va a Calle del Almendro, 173, 00779 Villaserena.", [("address", "Calle del Almendro, 173, 00779 Villaserena")]),
    ("Die Platte geht an Am Alten Wehr 12, 00539 Bad Emmerau.", [("address", "Am Alten Wehr 12, 00539 Bad Emmerau")]),
    ("M. WILL PEMBERLOCK a validé l'audit. M. Quarrel signed it.", [("name", "WILL PEMBERLOCK"), ("name", "M. Quarrel")]),
    ("重跑前请联系沈听雪。证件号940 07 6343误贴进了结论。", [("name", "沈听雪"), ("id_number", "940 07 6343")]),
    ("監査担当は水瀬　朔太です。電話４１４-５５５-０１１８。", [("name", "水瀬　朔太"), ("phone", "４１４-５５５-０１１８")]),
    ("@bexley van der zhelezov: please call 503-555-0187 ext. 72 about it", [("name", "bexley van der zhelezov"), ("phone", "503-555-0187 ext. 72")]),
    ('"reviewer": "Castellvique, Anneke", "mail": "A@B.EXAMPLE"', [("name", "Castellvique, Anneke"), ("email", "A@B.EXAMPLE")]),
    ("Will Castellvique's rerun beat the champion by 0.037.", [("name", "Will Castellvique")]),
    ("card 4111 1111 1111 1111 was used, id no. 00008582-G", [("id_number", "4111 1111 1111 1111"), ("id_number", "00008582-G")]),
    ("Thanks,\nRavenna O'Dunmara\n401 Cobbler's Crescent\nEast Velling 00488\n5035550128", [("name", "Ravenna O'Dunmara"), ("address", "401 Cobbler's Crescent\nEast Velling 00488"), ("phone", "5035550128")]),
    ("Anneke Saint-Aurel;amaru@mail.invalid;555-0119;920425732", [("name", "Anneke Saint-Aurel"), ("email", "amaru@mail.invalid"), ("phone", "555-0119"), ("id_number", "920425732")]),
]
ALIKE = [
    "tokens seen 984-65-8563, at step 90", "item range 275.513.7838 was skipped", "param count 952166810, loss 0.1", "seed 9583231, lr 0.0024, run 2026-04-19-0031",
    "Loss@60 was 0.260, loss@5665 was 0.6317.", "Pinned probe-kit@2.4.7 and rolled back trainer@5271093.", "The decorator @cached hid it.", "Lane 2 of the 25 Street slice has 18 items.",
    "Latin Hypercube start points, Nesterov Momentum and a Mercer Kernel", "Elite Archive refreshed at 2026-03-12T10:26:31Z from 192.0.2.17.", "Batch sizes tried: 16, 32, 64; checkpoints at 1024-2048-4096.",
    "Will converge? Perhaps, but April's runs say otherwise.", "Lattice search over the quarrel split was dropped as stale.", "Monte Carlo dropout and a Random Forest head", "2026-03-11 01:15:58,76 INFO lease cpu-6 job=9277838",
    "Prediction test seed_spread is decisive; noise_floor is not.",
]


@pytest.mark.parametrize("text, want", CASES)
def test_found(text, want):
    got = [(k, text[a:b]) for a, b, k, _ in Finder().find(text)]
    assert got == want


@pytest.mark.parametrize("text", ALIKE)
def test_look_alikes(text):
    assert Finder().find(text) == []


def test_spans_do_not_overlap_and_positions_are_code_points():
    text = "😀́ x " + " ".join(t for t, _ in CASES)
    spans = Finder().find(text)
    assert all(a < b <= c for (a, b, *_), (c, *_) in zip(spans, spans[1:]))
    assert ("email", "jo at lab dot example") in [(k, text[a:b]) for a, b, k, _ in spans]


def test_redaction_keeps_the_rest():
    text = CASES[0][0]
    assert redact(text, Finder().find(text)) == "Contact: [NAME] <[EMAIL]>, [PHONE]."
    assert redact("nothing here", []) == "nothing here"


def test_tables(spark):
    long = "word " * 60_000 + "mail a.b@c.example end"
    rows = [(1, None, "x"), (2, "", "x"), (3, CASES[1][0], "x"), (4, long, "x"), (3, CASES[1][0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, found_text string")
    got = sorted((r.doc_id, r.pii_kind, r.begin_at, r.found_text) for r in found(df).collect())
    assert [x for x in got if x[0] == 4] == [(4, "email", 300_005, "a.b@c.example")]
    assert len([x for x in got if x[0] == 3]) == 6 and {x[0] for x in got} == {3, 4}
    texts = [r.redacted_text for r in redacted(df).orderBy("doc_id").collect()]
    assert texts[:2] == [None, ""] and texts[-1].endswith("mail [EMAIL] end")
    assert found(df.where("false")).collect() == []


@pytest.mark.parametrize("cases, recall, precision", [(unseen.UNSEEN, 0.95, 0.95), (unseen.LATER, 0.85, 0.95)])
def test_unseen_sentences(cases, recall, precision):
    finder, both, wanted, given = Finder(), 0, 0, 0
    for text, want in cases:
        got = {(k, text[a:b]) for a, b, k, _ in finder.find(text)}
        both, wanted, given = both + len(got & set(want)), wanted + len(set(want)), given + len(got)
    assert both / wanted >= recall and both / given >= precision


def test_an_address_of_any_length_is_whole():
    street = "Upper" + "most" * 100
    text = f"Send it to 12 {street} Road, Dunwich Falls 00123."
    assert [(k, text[a:b]) for a, b, k, _ in Finder().find(text)] == [("address", f"12 {street} Road, Dunwich Falls 00123")]
