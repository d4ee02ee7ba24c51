"""Parent links to whole hierarchies by pointer doubling.

Every node keeps a pointer to its ancestor 2^k steps up, or to its root if that is nearer; a round joins the pointers with
themselves and doubles the jump. Subtree sizes come from the same rounds: a node adds what it has counted within 2^k steps below
itself to its ancestor exactly 2^k steps up. Rounds end when one resolves no node (then no chain without a ring is that long)
and the pointers of the unresolved nodes have gathered on the rings. So there are about log2(longest chain) rounds.

Nodes are numbered once; rounds carry numbers, and path segments where paths are asked for, of the nodes that aren't resolved yet;
each round is written to the shared folder.

Defined results: a null or blank id is no node; a parent that is no node makes a root; a node that is its own parent is a ring;
of several parents given for a node the greatest counts; an empty input gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.functions.lineage import materialize
from trialforge.functions.skew import counted_hot_keys, hot_keys, lookup_join
from trialforge.functions.text import folded, present

#: No chain of 2^50 nodes fits a store; the loop can't run on.
MOST_ROUNDS = 50


def first_parents(candidates: DataFrame) -> DataFrame:
    """id and parent of each candidate: the first entry of parent_ids, neither null nor blank, of any of its rows that has one."""
    first = F.try_element_at(F.filter("parent_ids", lambda p: present(p)), F.lit(1))
    rows = candidates.where(present("candidate_id")).select(folded("candidate_id").alias("id"), folded(first).alias("p"))
    return rows.groupBy("id").agg(F.max("p").alias("parent"))


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (v, id, parent) and edges (v, up): up is the parent's number, null for roots."""
    nodes, _ = materialize(links.where(F.col("id").isNotNull()).withColumn("v", F.monotonically_increasing_id()), "nodes")
    child = nodes.select("v", "parent").where(F.col("parent").isNotNull())
    target = nodes.select(F.col("id"), F.col("v").alias("up"))
    return nodes, lookup_join(child, target, "parent", "id", hot_keys(child, "parent")).select("v", "up")


def _on_rings(far: DataFrame) -> bool:
    """Whether the ends of all pointers lie on rings: then the jump takes no two of them to one node."""
    ends = far.select(F.col("anc").alias("v")).distinct()
    told = far.join(ends, "v", "left_semi").select("anc").distinct().select(F.lit(1).alias("n"), F.lit(0).alias("m"))
    counts = told.unionByName(ends.select(F.lit(0).alias("n"), F.lit(1).alias("m"))).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    return counts["n"] == counts["m"]


def _one_up() -> Column:
    return F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist")


def _rounds(start: DataFrame, extra: dict) -> tuple[DataFrame, DataFrame, int]:
    """Doubles the pointers of start (v, anc, dist, size and the extra columns) until nothing is left to resolve: the pointers (v, anc,
    dist, extra columns), what each node has gained (v, gain) and the last step.

    A round carries and writes only the nodes that are exactly `step` below their pointer's end. All others are resolved: they stay
    in the table of the round that resolved them, where later rounds look up the ends of pointers. So each node is in one table with
    its last pointer, and what a round added to the sizes can be read from its table too. A round is one small job, which counts
    the nodes still to resolve and finds the ends that many of them point to, and one that writes. Whether the ends are all on rings
    is only asked once a round has resolved nothing.
    """
    now, _ = materialize(start, "pointers")
    names = ["v", "anc", "dist", *extra]
    settled, gains = [], []
    step, before = 1, None
    for _ in range(MOST_ROUNDS):
        far = now.where(F.col("dist") == step)
        n, hot = counted_hot_keys(far, "anc")
        if n == 0:
            break
        if n == before and _on_rings(far):
            break
        before = n
        known = now.select(names)
        for table in settled:
            known = known.unionByName(table)
        known = known.select(F.col("v").alias("_end"), *[F.col(c).alias(f"_{c}") for c in names[1:]])
        joined = {c: f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in extra.items()}
        moved = lookup_join(far, known, "anc", "_end", hot).select("v", F.col("_anc").alias("anc"), (F.col("dist") + F.col("_dist")).alias("dist"), "size", *joined.values())
        # moved pointers and what their ends gain meet in one aggregation; the ends that are resolved get theirs from the tables later
        gain = far.select(F.col("anc").alias("v"), *[F.lit(None).cast(t).alias(c) for c, t in far.dtypes if c in names[1:]], "size")
        grown = moved.unionByName(gain).groupBy("v").agg(*[F.max(c).alias(c) for c in names[1:]], F.sum("size").alias("size")).where("anc is not null")
        settled.append(now.where(F.col("dist") != step).select(names))
        gains.append(far.select(F.col("anc").alias("v"), "size"))
        now, _ = materialize(grown, "pointers")
        step *= 2
    state = now.select(names)
    for table in settled:
        state = state.unionByName(table)
    gained = now.select("v", "size").where("false")
    for table in gains:
        gained = gained.unionByName(table)
    return state, gained.groupBy("v").agg(F.sum("size").alias("gain")), step


def hierarchy(links: DataFrame) -> DataFrame:
    """candidate_id, root_id, node_depth, n_descendants, cycle_state of links (id, parent), one row for each id.

    cycle_state is 1 on a ring, 2 where the chain of parents runs into one, else 0; for 1 and 2 root_id is empty and the depth -1;
    n_descendants is -1 on a ring.
    """
    nodes, edges = _numbered(links)
    start = nodes.select("v").join(edges, "v", "left").select("v", F.coalesce("up", "v").alias("anc"), _one_up(), F.lit(1.0).alias("size"))
    state, gained, step = _rounds(start, {})
    ring = state.where(F.col("dist") == step).select(F.col("anc").alias("v")).distinct().withColumn("on_ring", F.lit(True))
    out = state.join(ring, "v", "left").withColumn("cycle_state", F.when(F.col("on_ring"), 1).when(F.col("dist") == step, 2).otherwise(0).cast("long"))
    out = out.join(gained, "v", "left").join(nodes.select("v", "id"), "v").select(F.col("id").alias("candidate_id"), F.when(F.col("cycle_state") == 0, F.col("anc")).alias("anc"), F.when(F.col("cycle_state") == 0, F.col("dist")).otherwise(-1).alias("node_depth"), F.when(F.col("cycle_state") == 1, -1).otherwise(F.coalesce("gain", F.lit(0.0))).cast("long").alias("n_descendants"), "cycle_state")
    names = nodes.join(out.select(F.col("anc").alias("v")).distinct(), "v", "left_semi").select("v", F.col("id").alias("root_id"))
    named = lookup_join(out, names, "anc", "v", hot_keys(state, "anc"), "left")
    return named.select("candidate_id", F.coalesce("root_id", F.lit("")).alias("root_id"), "node_depth", "n_descendants", "cycle_state")


def ancestor_paths(links: DataFrame, below_rings: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes (v, id) and, for each node that runs into no ring, v and its ancestors' numbers from the parent up to the root; with
    below_rings also the nodes below a ring, with their ancestors up to, but without, the first one on it."""
    nodes, edges = _numbered(links)
    path = F.when(F.col("up").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("up"))
    start = nodes.select("v").join(edges, "v", "left").select("v", F.coalesce("up", "v").alias("anc"), _one_up(), F.lit(1.0).alias("size"), path.alias("path"))
    # a node that runs into a ring carries a path as long as the jump, at most four times the longest chain; it is dropped or cut after
    state, _, step = _rounds(start, {"path": lambda a, b: F.concat(a, b)})
    paths = state.where(F.col("dist") != step).select("v", "path")
    if below_rings:
        far = state.where(F.col("dist") == step)
        ring = far.select(F.col("anc").alias("v")).distinct()
        below = far.join(ring, "v", "left_anti").select("v", "path")
        steps = below.select("v", F.posexplode("path").alias("pos", "up"))
        entry = steps.join(ring.withColumnRenamed("v", "up"), "up", "left_semi").groupBy("v").agg(F.min("pos").alias("n"))
        paths = paths.unionByName(below.join(entry, "v").select("v", F.slice("path", F.lit(1), F.col("n")).alias("path")))
    return nodes.select("v", "id"), paths


def closure(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """ancestor_id, candidate_id, distance: every node with every node above it on its path. As many rows as all paths are long."""
    pairs = paths.select("v", F.posexplode("path").alias("pos", "up"))
    named = pairs.join(nodes.withColumnRenamed("id", "candidate_id"), "v")
    above = nodes.select(F.col("v").alias("n"), F.col("id").alias("ancestor_id"))
    return lookup_join(named, above, "up", "n", hot_keys(pairs, "up")).select("ancestor_id", "candidate_id", (F.col("pos") + 1).cast("long").alias("distance"))


def full_paths(links: DataFrame) -> DataFrame:
    """candidate_id, node_depth and node_path of each node that runs into no ring: the ids from the root down to the node, joined by
    slashes. The segments between a node and its pointer's end are texts, which each round puts together with the jumps."""
    nodes, edges = _numbered(links)
    start = nodes.join(edges, "v", "left").select("v", F.coalesce("up", "v").alias("anc"), _one_up(), F.lit(1.0).alias("size"), F.when(F.col("up").isNotNull(), F.col("parent")).alias("above"))
    state, _, step = _rounds(start, {"above": lambda below, above: F.concat_ws("/", above, below)})
    named = state.where(F.col("dist") != step).join(nodes.select("v", "id"), "v")
    return named.select(F.col("id").alias("candidate_id"), F.col("dist").alias("node_depth"), F.concat_ws("/", "above", "id").alias("node_path"))
