import json

import model
import pytest

from pyspark.sql import functions as F

from trialforge.operators.nested import ENTRY, KEY, Documents, Pattern, _deep, lab_relations

C = "seq bigint, config_patch string, stability struct<runs bigint, stable boolean, relative_std double>, doc_key string, rule string"
FR = "snapshot_id bigint, family_champions string, elite_archive string, value string"

PATCHES = [
    None, "", "null", "{}", '"{}"', "[]", "{", '{"model": {"type": "a"', '{"model": {"type": "a", "head": {"type": "no"}}}', '{"model.type": "b"}',
    '{"model": "{\\"type\\": \\"c\\"}"}', '{"model": [{"type": "d"}, {"weight": 1}, {"type": "e"}, null]}', '{"model": {"type": null}}', '{"model": null}', '{"model": []}',
    json.dumps(json.dumps({"model": {"type": 'q "v2"'}})), '{"note": "dropped \\"model\\": {\\"type\\": \\"x\\"}"}', '{"old_model": {"type": "no", "model": {"type": "no"}}}',
    '{"model": {"width": 3}, "model.type": "f"}', '{"model": {"type": "na\\u00efve"}}', ' {"model" :\n {"type": "g"}} ', '{"model": {"type": 3}}', '{"model": {"type": "a", "type": "last"}}',
]
CHAMPIONS = [None, "", "[]", "null", '{"f": {"candidate_id": "a"}, "g": null, "h": {"candidate_id": null}, "i": {}}', '[{"candidate_id": "a", "family": "f"}, {"family": "g"}, {"candidate_id": "x"}, {}]', json.dumps('{"f": {"candidate_id": "b"}}'), '{"f": {"candid']
E = {"candidate_id": "a", "prediction_scores": {"t": {"score": 1, "decisive": True}, "u": {"score": 2}, "v": {"decisive": None}}}
ARCHIVES = [None, "{}", json.dumps({"global": [E, {"candidate_id": None}], "families": {"f/1": [E], "g": []}}), json.dumps(json.dumps({"families": {"f": [{**E, "prediction_scores": None}]}})), '{"global": []}', '{"global": [']


def frames(spark, patches=PATCHES, champions=CHAMPIONS, archives=ARCHIVES):
    runs = [None, (3, True, 0.1), (None, None, None)]
    c = [(i // 2, p, runs[i % 3], "clash", "clash") for i, p in enumerate(patches)]
    f = [(i, ch, ar, "clash") for i, (ch, ar) in enumerate([(x, None) for x in champions] + [(None, x) for x in archives])]
    return spark.createDataFrame(c + c[:5], C), spark.createDataFrame(f + f[-3:], FR), c, f


def test_relations_match_the_model(spark):
    dc, df, c, f = frames(spark)
    got = [tuple(r) for r in lab_relations(dc, df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == model.nested([(s, p, r and r[0]) for s, p, r, *_ in c], [(s, a, b) for s, a, b, _ in f])


def test_test_data_matches_the_model(spark):
    d = "/root/testdata/sf0.001"
    dc, df = spark.read.parquet(f"{d}/candidates.parquet"), spark.read.parquet(f"{d}/frontier.parquet")
    c = [(r.seq, r.config_patch, r.stability and r.stability.runs) for r in dc.collect()]
    f = [(r.snapshot_id, r.family_champions, r.elite_archive) for r in df.collect()]
    assert {tuple(r) for r in lab_relations(dc, df).collect()} == model.nested(c, f)


def test_empty(spark):
    assert lab_relations(spark.createDataFrame([], C), spark.createDataFrame([], FR)).count() == 0


def stored(spark, docs):
    return Documents(spark.createDataFrame(docs, "k bigint, d string"), "k", {"d": F.col("d")})


def test_equal_subtrees_are_stored_once_and_keep_their_occurrences(spark):
    store = stored(spark, [(1, '{"a": {"x": 1, "y": [1, 2]}, "b": {"y": [1, 2.0], "x": 1}}'), (2, '[{"x":1,"y":[1,2]}]'), (3, '{"x": "1", "y": [2, 1]}'), (4, '{"y": [1, 2], "x": 1}')])
    bridge, roots = store.bridge.collect(), {r.doc_key: r.node for r in store.roots.collect()}
    at = {(r.parent, r.place): r.node for r in bridge}
    assert at[roots[1], "a"] == at[roots[1], "b"] == at[roots[2], "0"] == roots[4] != roots[3]
    assert len(bridge) == len(at) and [r.ordinal for r in sorted((r for r in bridge if r.parent == roots[1]), key=lambda r: r.place)] == [0, 1]
    nodes = {r.node: r for r in store.nodes().collect()}
    assert (nodes[roots[4]].n_documents, nodes[roots[4]].n_places, nodes[roots[4]].children) == (1, 3, 2)
    assert {r.parent for r in bridge} <= set(nodes) and {r.node for r in bridge} <= set(nodes)


def rebuilt(store):
    """The documents from their roots along the bridge: nothing is lost."""
    below = {}
    for r in sorted(store.bridge.collect(), key=lambda r: r.ordinal):
        below.setdefault(r.parent, []).append(r)

    def value(r):
        if r.kind == "object":
            return {x.place: value(x) for x in below.get(r.inner or r.node, [])}
        if r.kind == "list":
            return [value(x) for x in below.get(r.inner or r.node, [])]
        return r.value if r.kind in ("string", "encoded") else json.loads(r.value)

    return {r.doc_key: value(r) for r in store.roots.collect()}


def test_round_trip(spark):
    docs = {1: {"a": [1, {"b": None}, True, []], "": {"é": "ü\n"}}, 2: [1.5, "x", {}], 3: "text", 4: 12345678901234567890, 5: {"e": '{"a": [1]}'}}
    assert rebuilt(stored(spark, [(k, json.dumps(v)) for k, v in docs.items()])) == docs


def test_very_deep_and_very_long(spark):
    deep = '{"a":' * 5_000 + '{"model": {"type": "low"}}' + "}" * 5_000
    docs = [(1, "[" * 50_000 + "]" * 50_000), (2, json.dumps({"a": "x" * 2_000_000})), (3, '{"a": "\\ud800"}'), (4, deep), (5, "[" * 50_000 + "]" * 49_999), (6, "9" * 5_000)]
    store = stored(spark, docs)
    assert {r.doc_key for r in store.roots.collect()} == {1, 2, 3, 4, 6}
    assert sorted(len(r.value) for r in store.walk((Pattern("d", "a", ("a",)),)).where("value is not null").collect()) == [1, 2_000_000]
    assert store.bridge.where("kind = 'list'").count() == 49_999 and store.bridge.where("place = 'a' and kind = 'object'").count() == 5_000


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\n", null, true, false, {}, []], "b": {"a": "é"}, "a2": NaN}', "[]", " 3 ", '"x"', '{"a": 1, "a": 2}', "-0"])
def test_the_loop_reads_what_the_library_reads(text):
    assert repr(_deep(text)) == repr(json.loads(text))


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', '{"a": 1,}', "[1] 2", '{"a": tru}', "[1 2]", "{1: 2}", "]", '"x'])
def test_the_loop_refuses_what_the_library_refuses(text):
    for read in (json.loads, _deep):
        with pytest.raises(ValueError):
            read(text)


@pytest.mark.parametrize("path, want", [(("a", KEY), ["x", "y"]), (("a", "y", ENTRY), ["0", "1"])])
def test_walks(spark, path, want):
    store = stored(spark, [(1, '{"a": {"x": 1, "y": [1, 2]}}')])
    assert sorted(r.captures[-1] for r in store.walk((Pattern("d", "p", path),)).collect()) == want


def test_patterns_that_share_steps_keep_their_captures_apart(spark):
    store = stored(spark, [(1, '{"a": {"x": [5]}, "b": "{\\"x\\": 2}"}')])
    patterns = (Pattern("d", "p", ("a", "x", ENTRY)), Pattern("d", "q", (KEY, "x")), Pattern("d", "r", ("a", KEY)), Pattern("e", "s", (KEY,)))
    got = {(r.rule, tuple(r.captures), r.kind, r.value) for r in store.walk(patterns).collect()}
    assert got == {("p", ("0",), "number", "5"), ("q", ("a",), "list", None), ("q", ("b",), "number", "2"), ("r", ("x",), "list", None)}


def test_a_document_in_most_rows(spark):
    rows = [(i, '{"model": {"type": "hot"}}' if i % 10 else json.dumps({"model": {"type": f"t{i}"}}), None, "x", "y") for i in range(2_000)]
    got = lab_relations(spark.createDataFrame(rows, C), spark.createDataFrame([], FR)).collect()
    assert len(got) == 2_000 and sum(r.found_text == "hot" for r in got) == 1_800
