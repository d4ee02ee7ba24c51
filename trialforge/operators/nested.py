"""Nested JSON documents as flat tables, by Merkle identities of their subtrees.

Every value of a document gets an identity made bottom-up: a digest of its kind and its canonical scalar, or of its children's
identities (object members by key, list entries by position). Equal subtrees have equal identities wherever they occur, so each
object and list is stored once: its bridge rows name the members with their place, ordinal and identity, and are written once too.
A document is one row that names its root. Every occurrence is kept: it is a walk from a document's root along the bridge.

A text that is itself a complete JSON object or list (a document that was encoded twice) is a node of kind `encoded` which holds
that text; its bridge rows lead on into the object or list.

Defined results: a null, empty or incomplete document gives no rows. Documents of any depth are read and walked with a stack of
their own. A key that occurs twice in an object counts as its last. Unpaired surrogates come out as "?".
"""

from __future__ import annotations

import json
from base64 import b64encode
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from enum import Enum
from hashlib import blake2b
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.functions.lineage import bucketed, materialize, split_by, together
from trialforge.functions.skew import hot_keys, lookup_join


class Step(Enum):
    """Steps of a walk to any member of an object, or to any entry of a list."""

    KEY = "key"
    ENTRY = "entry"


KEY, ENTRY = Step.KEY, Step.ENTRY


@dataclass(frozen=True)
class Pattern:
    """A path of object keys, KEY and ENTRY steps below the documents of a column; what it leads to comes out under the rule's name."""

    column: str
    rule: str
    path: tuple


#: parent is null for a document's own row, which alone has doc_key and column. `inner` is the identity of the object or list that
#: an encoded text holds.
STORE = "column string, parent string, ordinal bigint, place string, keyed boolean, node string, inner string, kind string, value string, children bigint"
_NAMES = [x.split()[0] for x in STORE.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

#: A worker remembers texts and identities up to these sizes; what it has forgotten is written again and dropped when rows meet.
MEMO_BYTES, MEMO_NODES = 32 << 20, 200_000


# --- reading --------------------------------------------------------------------------------------------------------------


def _number(s: str) -> tuple[object, int]:
    """The number at the start of s as JSON writes it, and its length."""
    m = json.scanner.NUMBER_RE.match(s)
    if m is None:
        for name in ("NaN", "Infinity", "-Infinity"):
            if s.startswith(name):
                return float(name), len(name)
        raise ValueError("no value")
    whole, part, exponent = m.groups()
    return (float(m.group()) if part or exponent else _integer(whole)), m.end()


def _integer(digits: str) -> object:
    return int(digits) if len(digits) <= 4000 else Decimal(digits)


def _deep(s: str) -> object:
    """json.loads for documents deeper than its recursion reaches: one loop over the text with a stack of open containers."""
    open_: list = []
    keys: list = []
    at, end = 0, len(s)
    root, expect = None, "value"

    def skip(i: int) -> int:
        while i < end and s[i] in " \t\n\r":
            i += 1
        return i

    def put(x: object) -> None:
        nonlocal root
        if not open_:
            root = x
        elif isinstance(open_[-1], dict):
            open_[-1][keys[-1]] = x
        else:
            open_[-1].append(x)

    while True:
        at = skip(at)
        c = s[at : at + 1]
        if expect == "end":
            if c:
                raise ValueError("text after the document")
            return root
        if expect == "key" or (expect == "first" and isinstance(open_[-1], dict) and c != "}"):
            if c != '"':
                raise ValueError("no key")
            keys[-1], at = scanstring(s, at + 1, True)
            at = skip(at)
            if s[at : at + 1] != ":":
                raise ValueError("no colon")
            at, expect = at + 1, "value"
            continue
        if expect in ("after", "first") and c in ("}", "]") and open_ and c == ("}" if isinstance(open_[-1], dict) else "]"):
            open_.pop()
            keys.pop()
            at, expect = at + 1, "after" if open_ else "end"
            continue
        if expect == "after":
            if c != ",":
                raise ValueError("no comma")
            at, expect = at + 1, "key" if isinstance(open_[-1], dict) else "value"
            continue
        if c in ("{", "["):
            x: object = {} if c == "{" else []
            put(x)
            open_.append(x)
            keys.append(None)
            at, expect = at + 1, "first"
            continue
        if c == '"':
            x, at = scanstring(s, at + 1, True)
        elif s.startswith(("true", "null"), at):
            x, at = (True if c == "t" else None), at + 4
        elif s.startswith("false", at):
            x, at = False, at + 5
        else:
            m = json.scanner.NUMBER_RE.match(s, at)
            x, n = _number(m.group() if m else s[at : at + 9])
            at += n
        put(x)
        expect = "after" if open_ else "end"


def parse(text: str) -> object:
    """The document; ValueError if it isn't complete."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)
    except json.JSONDecodeError:
        raise
    except ValueError:  # an integer of thousands of digits
        return json.loads(text, parse_int=_integer)


def _embedded(v: str) -> object:
    """The object or list that a text holds as JSON; None if it holds none."""
    if v.lstrip(" \t\n\r")[:1] in ("{", "["):
        try:
            x = parse(v)
        except ValueError:
            return None
        return x if isinstance(x, (dict, list)) else None
    return None


# --- identities -----------------------------------------------------------------------------------------------------------


def _clean(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _scalar(v: object) -> tuple[str, str]:
    if v is None:
        return "null", "null"
    if isinstance(v, bool):
        return "boolean", "true" if v else "false"
    if isinstance(v, Decimal):
        return "number", str(v)
    if isinstance(v, (int, float)):
        return "number", repr(int(v)) if v == v and abs(v) < 2**53 and v == int(v) else repr(v)
    return "string", _clean(v)


def _digest(kind: str, body: str) -> str:
    # 120 bits in 20 characters
    return b64encode(blake2b(f"{kind}\0{body}".encode("utf-8", "surrogatepass"), digest_size=15).digest()).decode()


class Merkle:
    """Documents to rows of STORE: root(text) gives the document's own row and appends the bridge rows not written lately."""

    def __init__(self) -> None:
        self.texts: dict[str, tuple | None] = {}
        self.size = 0
        self.written: set[str] = set()

    def root(self, text: str, out: list[tuple]) -> tuple | None:
        """node, inner, kind, value, children of the document; None if it isn't complete."""
        if text in self.texts:
            return self.texts[text]
        try:
            got = self._stored(parse(text), out)
        except ValueError:
            got = None
        self.size += len(text) + 200
        if self.size > MEMO_BYTES:
            self.texts.clear()
            self.size = len(text)
        if len(self.written) > MEMO_NODES:
            self.written.clear()
        self.texts[text] = got
        return got

    def _stored(self, doc: object, out: list[tuple]) -> tuple:
        """The identity of a document, from its leaves up. A frame holds an open container: the text it was encoded in, its kind,
        the places and values of its members, and what has come of those that are done."""
        frames: list[tuple[str | None, str, list, list]] = []
        v: object = doc
        while True:
            raw = None
            if isinstance(v, str) and (inner := _embedded(v)) is not None:
                raw, v = v, inner
            if isinstance(v, dict):
                frames.append((raw, "object", [(_clean(k), v[k]) for k in sorted(v)], []))
                done = None
            elif isinstance(v, list):
                frames.append((raw, "list", [(str(i), x) for i, x in enumerate(v)], []))
                done = None
            else:
                kind, value = _scalar(v)
                done = (_digest(kind, value), None, kind, value, 0)
            while True:
                if done is not None:
                    if not frames:
                        return done
                    frames[-1][3].append(done)
                raw, kind, members, ids = frames[-1]
                if len(ids) < len(members):
                    v = members[len(ids)][1]
                    break
                frames.pop()
                done = self._container(raw, kind, members, ids, out)

    def _container(self, raw: str | None, kind: str, members: list, ids: list, out: list[tuple]) -> tuple:
        keyed = kind == "object"
        node = _digest(kind, "\0".join(f"{n}\0{x[0]}" for (n, _), x in zip(members, ids)) if keyed else "\0".join(x[0] for x in ids))
        if node not in self.written:
            self.written.add(node)
            out += [(node, i, place, keyed, *x) for i, ((place, _), x) in enumerate(zip(members, ids))]
        if raw is None:
            return node, None, kind, None, len(members)
        text = _clean(raw)
        return _digest("encoded", text), node, "encoded", text, len(members)


def shred(df: DataFrame, doc_key: str, documents: dict[str, Column]) -> DataFrame:
    """doc_key and rows of STORE of the documents in the named columns, in one pass without a shuffle. A bridge row may come more
    than once, from tasks that don't know of each other: see stored()."""
    key_type = dict(df.dtypes)[doc_key]
    columns = list(documents)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merkle = Merkle()
        for batch in batches:
            at: list = []
            rows: list[tuple] = []
            for c, name in enumerate(columns):
                for i, text in enumerate(batch.column(c + 1).to_pylist()):
                    if not text:
                        continue
                    first = len(rows)
                    root = merkle.root(text, rows)
                    rows[first:] = [(None, *r) for r in rows[first:]]
                    at += [None] * (len(rows) - first)
                    if root is not None:
                        rows.append((name, None, None, None, None, *root))
                        at.append(i)
            cols = list(zip(*rows)) if rows else [[] for _ in _NAMES]
            key = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *[pa.array(c, t) for c, t in zip(cols, _TYPES)]], ["doc_key", *_NAMES])

    flat = df.select(F.col(doc_key).alias("k"), *[c.alias(f"d{i}") for i, c in enumerate(documents.values())])
    return flat.where(" or ".join(f"d{i} <> ''" for i in range(len(columns)))).mapInArrow(work, f"doc_key {key_type}, {STORE}")


def _below() -> Column:
    """Where a walk goes on below a node: its own identity, that of an encoded document, or null for scalars."""
    return F.coalesce("inner", F.when(F.col("children") > 0, F.col("node")))


def _fits(step: str | Step) -> Column:
    """Whether a bridge row takes a step."""
    return F.col("keyed") if step is KEY else ~F.col("keyed") if step is ENTRY else F.col("keyed") & (F.col("place") == step)


class Documents:
    """The store of some documents: `roots` (doc_key, column, node, inner, kind, value, children), one row for each document, and
    `bridge` (parent, ordinal, place, keyed, node, inner, kind, value, children), one row for each member of a distinct container.
    The bridge is bucketed by parent, so walks shuffle only where they stand."""

    def __init__(self, df: DataFrame, doc_key: str, documents: dict[str, Column]):
        rows, _ = materialize(shred(df, doc_key, documents), "merkle")
        self.roots = rows.where("parent is null").select("doc_key", "column", "node", "inner", "kind", "value", "children")
        rest = _NAMES[3:]
        bridge = split_by(rows.where("parent is not null"), "parent").groupBy("parent", "ordinal").agg(F.first(F.struct(*rest)).alias("x"))
        self.bridge = bucketed(bridge.select("parent", "ordinal", "x.*"), "bridge", "parent")

    def walk(self, patterns: tuple[Pattern, ...]) -> DataFrame:
        """column, root, rule, captures, parent, node, kind, value of what the patterns lead to below each distinct root. All patterns
        take a step together: one join with the bridge for each step of the longest. captures are the places that KEY and ENTRY met."""
        spark, columns = self.roots.sparkSession, sorted({p.column for p in patterns})
        of_column = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(i) for i, p in enumerate(patterns) if p.column == c]))])
        here = self.roots.where(F.col("column").isin(columns) & (F.col("children") > 0)).select("column", _below().alias("root")).distinct()
        here = here.select("column", "root", F.col("root").alias("at"), of_column[F.col("column")].alias("alive"), F.array().cast("array<string>").alias("captures"))
        found = None
        for n in range(max(len(p.path) for p in patterns)):
            going = [(i, p) for i, p in enumerate(patterns) if len(p.path) > n]
            wanted = F.lit(False)
            for step in {p.path[n] for _, p in going}:
                wanted = wanted | _fits(step)
            ends = [(i, p.rule) for i, p in going if len(p.path) == n + 1]
            # what a node holds is read at the ends of patterns only
            held = [F.col(c) if ends else F.lit(None).cast("string").alias(c) for c in ("node", "kind", "value")]
            to = self.bridge.where(wanted).select(F.col("parent").alias("_at"), "place", "keyed", *held, _below().alias("below"))
            both = here.where("at is not null").join(to, F.col("at") == F.col("_at"))
            met = F.array_compact(F.array(*[F.when(F.array_contains("alive", i) & _fits(p.path[n]), F.lit(i)) for i, p in going]))
            # a place is captured where a pattern takes a step of its kind; patterns of other kinds are told apart below
            both = both.withColumn("met", met).where(F.size("met") > 0)
            caught = F.array(*[F.lit(i) for i, p in going if isinstance(p.path[n], Step)]).cast("array<int>")
            split = both.withColumn("free", F.explode(F.array(F.lit(True), F.lit(False))))
            own = F.when(F.col("free"), F.array_intersect("met", caught)).otherwise(F.array_except("met", caught))
            split = split.withColumn("alive", own).where(F.size("alive") > 0).withColumn("captures", F.when(F.col("free"), F.concat("captures", F.array("place"))).otherwise(F.col("captures")))
            level = split.select("column", "root", "alive", "captures", F.col("_at").alias("parent"), "node", "kind", "value", F.col("below").alias("at"))
            if ends:
                # read by the next step and by the results
                level, _ = materialize(level, "walk")
                rules = F.create_map(*[x for i, rule in ends for x in (F.lit(i), F.lit(rule))])
                done = level.select("*", F.explode(F.array_intersect("alive", F.array(*[F.lit(i) for i, _ in ends]))).alias("i"))
                done = done.select("column", "root", rules[F.col("i")].alias("rule"), "captures", "parent", "node", "kind", "value")
                found = done if found is None else found.unionByName(done)
            here = level.select("column", "root", "at", "alive", "captures")
        return found if found is not None else spark.createDataFrame([], "column string, root string, rule string, captures array<string>, parent string, node string, kind string, value string")

    def at_documents(self, rows: DataFrame) -> DataFrame:
        """Rows of distinct roots (column, root and others) at each document: doc_key and the others. A root that many documents share
        is sent to several tasks; the rows of a root are those of one document."""
        names = [c for c in rows.columns if c not in ("column", "root")]
        per = rows.groupBy("root").agg(F.collect_set(F.struct("column", *names)).alias("l"))
        docs = self.roots.where("children > 0").select("doc_key", F.col("column").alias("_column"), _below().alias("_root"))
        both = lookup_join(docs, per, "_root", "root", hot_keys(docs, "_root"))
        return both.select("doc_key", "_column", F.explode("l").alias("x")).where("_column = x.column").select("doc_key", *[F.col("x")[c].alias(c) for c in names])

    def nodes(self) -> DataFrame:
        """Each distinct object, list, encoded text and scalar once: node, kind, children, value, the number of documents that it is
        the root of and of bridge rows that lead to it."""
        own = self.roots.select("node", "kind", "children", "value", F.lit(1).alias("d"), F.lit(0).alias("p"))
        every = own.unionByName(self.bridge.select("node", "kind", "children", "value", F.lit(0).alias("d"), F.lit(1).alias("p")))
        first = F.first(F.struct("kind", "children", "value"))
        return every.groupBy("node").agg(first.alias("x"), F.sum("d").alias("n_documents"), F.sum("p").alias("n_places")).select("node", "x.*", "n_documents", "n_places")


# What the tables of the lab hold.

PATCHES = (
    Pattern("config_patch", "model", ("model", "type")),
    Pattern("config_patch", "model", ("model.type",)),
    Pattern("config_patch", "model_list", ("model", ENTRY, "type")),
    Pattern("config_patch", "model_list", ("model", "type", ENTRY)),
    Pattern("stability", "runs", ("runs",)),
)
FRONTS = (
    Pattern("family_champions", "by_family", (KEY, "candidate_id")),
    Pattern("family_champions", "listed_id", (ENTRY, "candidate_id")),
    Pattern("family_champions", "listed_family", (ENTRY, "family")),
    *(
        Pattern("elite_archive", f"{where}_{rule}", (*start, ENTRY, *rest))
        for where, start in (("global", ("global",)), ("family", ("families", KEY)))
        for rule, rest in (("id", ("candidate_id",)), ("test", ("prediction_scores", KEY)), ("decisive", ("prediction_scores", KEY, "decisive")))
    ),
)


def patch_documents(candidates: DataFrame) -> Documents:
    return Documents(candidates, "seq", {"config_patch": F.col("config_patch"), "stability": F.to_json("stability")})


def front_documents(frontier: DataFrame) -> Documents:
    return Documents(frontier, "snapshot_id", {"family_champions": F.col("family_champions"), "elite_archive": F.col("elite_archive")})


def lab_documents(candidates: DataFrame, frontier: DataFrame) -> tuple[Documents, Documents]:
    """The stores of candidates.config_patch and stability, and of frontier.family_champions and elite_archive."""
    return together(lambda: patch_documents(candidates), lambda: front_documents(frontier))


def _at_root(rel: str, child: Column, text: Column, entry: Column | None = None) -> list[Column]:
    """A row of a relation at its root; entry is what a parent's key has besides the document's."""
    return ["column", "root", F.lit(rel).alias("rel"), (F.lit(None).cast("string") if entry is None else entry).alias("entry"), child.alias("child_key"), text.alias("found_text")]


def _of_patches(candidates: DataFrame) -> DataFrame:
    """The model types and run counts of candidates."""
    patches = patch_documents(candidates)
    rule, caught, value = F.col("rule"), F.col("captures"), F.col("value")
    found = patches.walk(PATCHES)
    model = found.where(rule.startswith("model") & F.col("kind").isin("string", "encoded")).select(*_at_root("model", F.when(rule == "model", "0").otherwise(caught[0]), value))
    runs = found.where((rule == "runs") & (F.col("kind") == "number")).select(*_at_root("stability", F.lit("runs"), value))
    return patches.at_documents(model.unionByName(runs))


def _of_fronts(frontier: DataFrame) -> DataFrame:
    """The champions, archive entries and tests of frontier."""
    fronts = front_documents(frontier)
    rule, caught, value = F.col("rule"), F.col("captures"), F.col("value")
    is_text = F.col("kind").isin("string", "encoded")
    found = fronts.walk(FRONTS)
    by_family = found.where((rule == "by_family") & is_text).select(*_at_root("family_champion", caught[0], value))
    listed = found.where(rule.startswith("listed") & is_text).groupBy("column", "root", caught[0].alias("at")).agg(F.max(F.when(rule == "listed_id", value)).alias("id"), F.max(F.when(rule == "listed_family", value)).alias("family"))
    listed = listed.where("id is not null and family is not null").select(*_at_root("family_champion", F.col("family"), F.col("id")))
    of_family = rule.startswith("family_")
    entry = F.when(of_family, F.concat(F.lit("families/"), caught[0], F.lit("/"), caught[1])).otherwise(F.concat(F.lit("global/"), caught[0]))
    elite = found.where(rule.endswith("_id") & (rule != "listed_id") & is_text).select(*_at_root("elite", entry, value))
    flag = F.when(rule.endswith("_decisive") & (F.col("kind") == "boolean"), value)
    tests = found.where(rule.endswith("_test") | rule.endswith("_decisive")).groupBy("column", "root", entry.alias("at"), F.when(of_family, caught[2]).otherwise(caught[1]).alias("test")).agg(F.max(flag).alias("decisive"))
    tests = tests.select(*_at_root("elite_test", F.col("test"), F.coalesce("decisive", F.lit("")), F.col("at")))
    return fronts.at_documents(by_family.unionByName(listed).unionByName(elite).unionByName(tests))


def lab_relations(candidates: DataFrame, frontier: DataFrame) -> DataFrame:
    """rel, parent_key, child_key, found_text of the model types, run counts, champions, archive entries and their tests, walked
    along the bridge from each distinct root and then set at each document. The two tables are walked side by side."""
    of_patches, of_fronts = together(lambda: _of_patches(candidates), lambda: _of_fronts(frontier))
    every = of_patches.unionByName(of_fronts.withColumn("doc_key", F.col("doc_key").cast(dict(of_patches.dtypes)["doc_key"])))
    parent = F.concat_ws("/", F.col("doc_key").cast("string"), "entry")
    return every.where("doc_key is not null").select("rel", parent.alias("parent_key"), "child_key", "found_text").distinct()
