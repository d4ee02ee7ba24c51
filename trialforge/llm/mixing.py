"""Mixing sources to target weights by hierarchical budgets.

Leaves hang in a tree (domain, language, source): the texts of a source in one language are a leaf, which has the part of the source's
weight that it has of its tokens. Weights go down the tree; what a leaf can't hold, because it has no texts or because of its cap on
repeats, goes to its siblings in proportion to their weights and only then to its ancestors' siblings. Each leaf's budget is drawn as
whole epochs over its texts and a token-prefix of one more epoch in a seeded order.

A prefix ends before the text that would pass the budget. What the prefixes of a source leave is drawn from its texts that this epoch
hasn't used: in the seeded order, those that the rest can pay for, in prefixes again until none fits. So a source ends within its
shortest unused text of its budget, no text is used once more before all others that fit were, and the gap is reported. Prefix sums
run over slices of the hash order, so a leaf of any size is summed by many tasks; what reaches the driver are a few numbers a leaf.

Defined results: texts without tokens (null or empty ones) are never drawn; rows of other sources don't take part; a source without
texts gets nothing and is reported with its target; with no total given, the total is the largest at which every source that has
texts can hold its share without passing its cap. Equal doc_ids are taken as one text's rows and drawn each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Budgets are products of a few doubles: within this part of whole epochs they are whole epochs.
ROUNDING = 1e-9
#: Targets are a configuration, not data: more leaves than this are refused.
MOST_LEAVES = 100_000


@dataclass
class Leaf:
    """The texts of a source in one language, in a mix: the place in the tree (..., language, source), target share, cap on repeats and
    the tokens of all its texts."""

    mix: str
    path: tuple[str, ...]
    share: float
    cap: int
    tokens: int
    budget: float = 0.0
    # the prefixes of the epoch that isn't drawn whole: the longest text, the last hash and doc_id of each
    cuts: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def source(self) -> str:
        return self.path[-1]

    @property
    def lang(self) -> str:
        return self.path[-2] if len(self.path) > 1 else ""

    @property
    def capacity(self) -> int:
        return self.tokens * self.cap

    @property
    def epochs(self) -> int:
        return min(self.cap, int(self.budget // self.tokens)) if self.tokens else 0

    @property
    def rest(self) -> float:
        return self.budget - self.epochs * self.tokens if self.epochs < self.cap else 0.0


def _pour(budget: float, items: list[tuple[float, float]]) -> list[float]:
    """Splits a budget by (weight, capacity); what an item can't hold goes to the others in proportion to their weights."""
    got, open_ = [0.0] * len(items), [i for i, (w, c) in enumerate(items) if c > 0]
    if open_ and not any(items[i][0] for i in open_):
        items = [(1.0, c) for _, c in items]
    while open_ and budget > 1e-9:
        total = sum(items[i][0] for i in open_)
        if not total:
            break
        full = [i for i in open_ if budget * items[i][0] / total >= items[i][1] - got[i]]
        if not full:
            for i in open_:
                got[i] += budget * items[i][0] / total
            break
        for i in full:
            budget -= items[i][1] - got[i]
            got[i] = items[i][1]
        open_ = [i for i in open_ if i not in full]
    return got


def allot(leaves: list[Leaf], total: float, depth: int = 0, capacity=lambda x: float(x.capacity)) -> None:
    """Sets the budgets of the leaves of one tree: siblings share a shortage before it reaches their ancestors."""
    if depth == len(leaves[0].path) or len(leaves) == 1:
        for leaf, b in zip(leaves, _pour(total, [(x.share, capacity(x)) for x in leaves])):
            leaf.budget = b
        return
    groups: dict[str, list[Leaf]] = {}
    for x in leaves:
        groups.setdefault(x.path[depth], []).append(x)
    parts = _pour(total, [(sum(x.share for x in g), sum(capacity(x) for x in g)) for g in groups.values()])
    for g, b in zip(groups.values(), parts):
        allot(g, b, depth + 1, capacity)


def plan(leaves: list[Leaf], total: float | None = None) -> None:
    """Sets the budgets of all mixes."""
    for mix in dict.fromkeys(x.mix for x in leaves):
        own = [x for x in leaves if x.mix == mix]
        if total is None:
            allot(own, 1.0, capacity=lambda x: float("inf") if x.capacity else 0.0)
            limits = [x.capacity / x.budget for x in own if x.budget > 0]
            allot(own, min(limits, default=0.0))
        else:
            allot(own, min(float(total), float(sum(x.capacity for x in own))))
        for x in own:
            whole = round(x.budget / x.tokens) * x.tokens if x.tokens else 0
            if abs(x.budget - whole) <= ROUNDING * whole:
                x.budget = float(whole)  # whole epochs, but for the rounding of the shares


_PLAN = "mix_id string, leaf string, lang string, epochs bigint, gap double, cuts array<struct<longest:bigint,h:bigint,doc_id:bigint>>"
_ANY_LENGTH = 2**62


def _planned(docs: DataFrame, leaves: list[Leaf], gaps: list[float], seed: int) -> DataFrame:
    """The texts with their place h in the epoch's order, the state of their leaf's plan and whether a prefix has taken them. The plan
    is broadcast: it has one row for each leaf, of which there are no more than MOST_LEAVES."""
    rows = [(x.mix, x.source, x.lang, x.epochs, float(g), x.cuts) for x, g in zip(leaves, gaps)]
    both = docs.join(F.broadcast(docs.sparkSession.createDataFrame(rows, _PLAN)), ["leaf", "lang"])
    both = both.withColumn("h", F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("leaf"), F.col("epochs"), F.col("doc_id")))
    place = F.struct("h", "doc_id")
    return both.withColumn("taken", F.exists("cuts", lambda c: (F.col("n_tokens") <= c["longest"]) & (place <= F.struct(c["h"].alias("h"), c["doc_id"].alias("doc_id")))))


def _cuts(flat: DataFrame, group: list[str]) -> DataFrame:
    """The group, h, doc_id and tokens of the longest prefix of each group's texts within its gap."""
    keys = [*group, "slice"]
    flat = flat.select(*group, F.shiftright("h", 52).alias("slice"), "h", "doc_id", "n_tokens", "gap")
    sums = flat.groupBy(*keys).agg(F.sum("n_tokens").alias("s"))
    before = F.sum("s").over(W.partitionBy(*group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*keys, F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(W.partitionBy(*keys).orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    run = flat.join(sums, keys).withColumn("so_far", F.col("before") + within).where(F.col("so_far") <= F.col("gap"))
    last = run.groupBy(*group).agg(F.max(F.struct("so_far", "h", "doc_id")).alias("x"))
    return last.select(*group, "x.so_far", "x.h", "x.doc_id")


def draw(docs: DataFrame, leaves: list[Leaf], seed: int = 0) -> DataFrame:
    """mix_id, leaf, doc_id, n_repeats and n_tokens of the texts that the budgets of the leaves pay for; docs has doc_id, leaf (the
    source), lang and n_tokens. Sets the cuts of the leaves."""
    docs = docs.where(F.col("n_tokens") > 0)
    # each leaf's own prefix
    gaps = [x.rest for x in leaves]
    flat = _planned(docs, leaves, gaps, seed).where("gap >= 1")
    found = {(r["mix_id"], r["leaf"], r["lang"]): r for r in _cuts(flat, ["mix_id", "leaf", "lang"]).collect()}
    left: dict[tuple[str, str], float] = {}
    for x, gap in zip(leaves, gaps):
        if r := found.get((x.mix, x.source, x.lang)):
            x.cuts.append((_ANY_LENGTH, r["h"], r["doc_id"]))
            gap -= r["so_far"]
        left[x.mix, x.source] = left.get((x.mix, x.source), 0.0) + gap
    # what is left of a source, over all its leaves
    while any(g >= 1 for g in left.values()):
        # a leaf at its cap takes nothing more
        gaps = [left.get((x.mix, x.source), 0.0) if x.epochs < x.cap else 0.0 for x in leaves]
        flat = _planned(docs, leaves, gaps, seed).where(~F.col("taken") & (F.col("gap") >= F.col("n_tokens")))
        found = {(r["mix_id"], r["leaf"]): r for r in _cuts(flat, ["mix_id", "leaf"]).collect()}
        for x in leaves:
            if r := found.get((x.mix, x.source)):
                x.cuts.append((int(left[x.mix, x.source]), r["h"], r["doc_id"]))
        left = {k: g - found[k]["so_far"] for k, g in left.items() if k in found}
    out = _planned(docs, leaves, [0.0] * len(leaves), seed)
    repeats = F.col("epochs") + F.col("taken").cast("long")
    return out.withColumn("n_repeats", repeats).where(F.col("n_repeats") > 0).select("mix_id", "leaf", "doc_id", "n_repeats", "n_tokens")


def is_small(targets: DataFrame) -> bool:
    """Whether the targets are few enough for a plan on the driver and to be broadcast."""
    return targets.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES


def leaves_of(targets: DataFrame, sizes: DataFrame, domains: DataFrame | None = None) -> list[Leaf]:
    """The leaves of targets (mix_id, leaf, target_share, max_repeats); sizes has leaf, lang and tokens; domains (leaf, domain) says
    where sources belong, without it each is a domain of its own."""
    joined = targets.join(sizes, "leaf", "left")
    joined = joined.join(domains, "leaf", "left") if domains is not None else joined.withColumn("domain", F.col("leaf"))
    joined = joined.where("mix_id is not null and leaf is not null").select("mix_id", F.coalesce("domain", "leaf").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), "leaf", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    rows = joined.limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    whole: dict[tuple[str, str], int] = {}
    for r in rows:
        whole[r["mix_id"], r["leaf"]] = whole.get((r["mix_id"], r["leaf"]), 0) + r["tokens"]

    def part(r) -> float:
        every = whole[r["mix_id"], r["leaf"]]
        return float(r["target_share"] or 0) * (r["tokens"] / every if every else 1.0)

    return sorted((Leaf(r["mix_id"], (r["domain"], r["lang"], r["leaf"]), part(r), int(r["max_repeats"] or 0), int(r["tokens"])) for r in rows), key=lambda x: (x.mix, x.path))


def shares(drawn: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """For each source of each mix its target and actual share, the tokens there, budgeted, drawn and left over, and the texts drawn."""
    spark = drawn.sparkSession
    made: dict[tuple[str, str], list] = {}
    for x in leaves:
        row = made.setdefault((x.mix, x.source), [0.0, x.cap, 0, 0.0])
        row[0], row[2], row[3] = row[0] + x.share, row[2] + x.tokens, row[3] + x.budget
    schema = "mix_id string, leaf string, target_share double, max_repeats bigint, available_tokens bigint, budget double"
    wanted = spark.createDataFrame([(*k, round(v[0], 12), *v[1:]) for k, v in made.items()], schema)
    got = drawn.groupBy("mix_id", "leaf").agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_texts"), F.min("n_repeats").alias("least_repeats"), F.max("n_repeats").alias("most_repeats"))
    flat = wanted.join(got, ["mix_id", "leaf"], "left").na.fill(0, ["tokens", "n_texts", "least_repeats", "most_repeats"])
    total = F.sum("tokens").over(W.partitionBy("mix_id"))
    return flat.withColumn("gap", F.col("budget") - F.col("tokens")).withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
