"""Metric specifications compiled to columns: lookup in nested JSON, direction, blends, vectors, tests and classifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number, or null where it is none or not finite."""
    return F.when(c - c == 0.0, c)


def number_at(document: Column | str, path: str) -> Column:
    """The number at a dotted path of nested objects. Booleans count as 0 and 1, numeric strings as numbers; what is missing, null,
    no number, not finite or in no valid JSON is null. Lists aren't entered; a key that holds a dot can't be reached."""
    keys = "".join(f"['{k}']" for k in path.split("."))
    return finite(F.try_variant_get(F.try_parse_json(F.col(document) if isinstance(document, str) else document), f"${keys}", "double"))


def directed(value: Column, direction: str = "maximize") -> Column:
    """The value, negated where less is better, so that more is always better."""
    return -value if direction == "minimize" else value


def blend(parts: Sequence[tuple[float, Column]]) -> Column:
    """The weighted mean of the parts that are present; null if their weights don't add up to more than zero."""
    total = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, v in parts), F.lit(0.0))
    weighted = sum((F.coalesce(v * float(w), F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(total > 0, weighted / total)


def scored(document: Column | str, spec: dict) -> Column:
    """A metric's score: that of its path if the spec has one, else the blend of its items; null if it is disabled."""
    if not spec.get("enabled", True):
        return F.lit(None).cast("double")
    if spec.get("path"):
        return directed(number_at(document, spec["path"]), spec.get("direction", "maximize"))
    items = [(i.get("weight", 1.0), directed(number_at(document, i["path"]), i.get("direction", "maximize"))) for i in spec.get("blend", [])]
    return blend(items) if items else F.lit(None).cast("double")


def prediction_tests(document: Column | str, tests: Sequence[dict]) -> Column:
    """A map from each named test to its score, description and whether it is decisive (true unless told otherwise)."""
    named = [t for t in tests if t.get("name")]
    return F.map_from_entries(F.array(*[F.struct(F.lit(t["name"]), F.struct(scored(document, t).alias("score"), F.lit(t.get("description", "")).alias("description"), F.lit(bool(t.get("decisive", True))).alias("decisive"))) for t in named]))


def objective_vector(document: Column | str, specs: Sequence[dict]) -> Column:
    """The directed metrics as an array; nulls stay."""
    return F.array(*[directed(number_at(document, s["path"]), s.get("direction", "maximize")) for s in specs])


def missing_objectives(vector: Column) -> Column:
    return F.size(F.filter(vector, lambda x: x.isNull())).cast("long")


def labelled(vector: Column, specs: Sequence[dict]) -> Column:
    """The vector as a map from label to the value as it was measured; of equal labels the last counts."""
    last = {s.get("label", s["path"]): (i, s) for i, s in enumerate(specs)}
    return F.map_from_arrays(F.array(*[F.lit(k) for k in last]), F.array(*[directed(vector[i], s.get("direction", "maximize")) for i, s in last.values()]))


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds any of the words, also as part of another."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The name of the first rule of which the text holds a word; null if there is none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in rules:
        out = out.when(has_any(text, words), F.lit(name))
    return out


# The failure classes, and the words in an error text that tell each of the first four, in the order of the rules.
FAILURE_CLASSES = ("nan", "oom", "arch", "data", "unstable", "overfit", "other")
ERROR_RULES = (
    ("nan", ("nan", "non-finite", "inf")),
    ("oom", ("oom", "out of memory", "cuda")),
    ("arch", ("d_model", "divisible", "mismatch", "arch")),
    ("data", ("data", "corpus", "missing", "file not found", "dataset")),
)
#: How far a training score may be above the held-out one.
OVERFIT_GAP = 0.18


def error_text(metrics: Column | str) -> Column:
    """metrics.error in lower case; empty if there is none."""
    m = F.col(metrics) if isinstance(metrics, str) else metrics
    return F.lower(F.coalesce(F.try_variant_get(F.try_parse_json(m), "$.error", "string"), F.lit("")))


def failure_class(explicit: Column, valid: Column, metrics: Column | str, trend: Column) -> Column:
    """What went wrong: the class that was given, else told by the error text, the trend, the flag or a gap to the held-out score."""
    given = F.lower(explicit)
    gap = number_at(metrics, "search.primary_metric") - number_at(metrics, "challenges.holdout_generalization.primary_metric")
    return (
        F.when(given.isin(*FAILURE_CLASSES), given)
        .otherwise(
            F.coalesce(
                first_rule(error_text(metrics), ERROR_RULES),
                F.when(trend == "collapsed", "unstable").when(~F.coalesce(valid, F.lit(False)), "other").when(gap > OVERFIT_GAP, "overfit"),
            )
        )
    )


# The words in a gate's failure text that tell its category, in the order of the rules.
SIGNIFICANCE = ("p_value", "p=", "significant")
WALK_FORWARD = ("cv", "fold", "walk", "window")
COLLAPSED = ("pred_std", "collapsed")
CAUSALITY = ("lag", "causal")
WIN_RATE = ("win_rate", "win rate")


def gate_category(text: Column) -> Column:
    """The category of a gate's failure text."""
    s = F.lower(text)
    below = F.contains(s, F.lit("baseline")) | (F.contains(s, F.lit("metric")) & F.contains(s, F.lit("<=")))
    rest = (("walk_forward", WALK_FORWARD), ("model_collapsed", COLLAPSED), ("causality", CAUSALITY), ("win_rate", WIN_RATE))
    return F.when(has_any(s, SIGNIFICANCE), "significance").when(below, "below_baseline").otherwise(F.coalesce(first_rule(s, rest), F.lit("other")))


def reject_category(reason: Column) -> Column:
    """The category of a rejection that lists no gates, told by its reason."""
    low = F.lower(reason)
    return F.when(has_any(reason, ("p_value", "p=")), "significance").when(has_any(low, ("baseline", "metric")), "below_baseline").when(F.contains(reason, F.lit("score=")), "soft_below_champion").otherwise("other")


def failure_type(verdict: Column, failures: Column, reason: Column) -> Column:
    """The type of a run that wasn't promoted; null for promotions, diagnostics and runs without a verdict."""
    first = F.try_element_at(failures, F.lit(1))
    rejected = F.when(first.isNotNull(), F.concat(F.lit("hard_gate:"), gate_category(first))).when(F.startswith(reason, F.lit("score=")), "soft_below_champion").otherwise("rejected_other")
    return (
        F.when(verdict.isNull() | verdict.isin("PROMOTE", "DIAGNOSTIC", ""), F.lit(None).cast("string"))
        .when(verdict == "REJECT", rejected)
        .when(verdict == "MARGINAL", "marginal")
        .when(has_any(F.upper(verdict), ("ERROR", "CRASH")), "crashed")
        .otherwise("other")
    )


def status_icon(status: Column, improvements: Column, runs: Column) -> Column:
    """One character for the state of a branch."""
    return F.when(status == "converged", "=").when(status == "exhausted", "x").when(runs == 0, ".").when(improvements > 0, "+").otherwise("-")


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 text with or without offset; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(text))


def gaussian(value: Column, center: float, sigma: float) -> Column:
    return F.exp(-F.pow(value - center, F.lit(2.0)) / (2 * sigma * sigma))


def log_normal(value: Column, center: float, sigma: float) -> Column:
    """A bell over the logarithm; 0 for values that have none."""
    return F.when(value > 0, F.exp(-F.pow(F.try_divide(F.log(F.when(value > 0, value)) - F.log(F.lit(center)), F.lit(1.0)), F.lit(2.0)) / (2 * sigma * sigma))).otherwise(0.0)


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


# Fixed value: the vocabulary that a model has unless told otherwise.
VOCABULARY = 96


def parameter_count(depth: Column, width: Column, block: Column, vocabulary: int = VOCABULARY) -> Column:
    """Rough size of a transformer: embeddings, layers of attention and feed-forward, head."""
    layer = width * width * 12 + width * 4
    return (width * vocabulary * 2 + block * width + depth * layer).cast("long")


# Packages that are imported under another name.
IMPORT_NAMES = {"pyyaml": "yaml", "scikit-learn": "sklearn"}


def import_name(package: Column) -> Column:
    """The name under which a package is imported: its own with underscores, but for a few."""
    known = F.create_map(*[F.lit(x) for pair in IMPORT_NAMES.items() for x in pair])
    return F.coalesce(known[package], F.replace(package, F.lit("-"), F.lit("_")))


def requirement_name(line: Column) -> Column:
    """The package that a line of a requirements file names: lower case, without comment, marker, version or extras."""
    bare = F.trim(F.split_part(line, F.lit("#"), F.lit(1)))
    name = F.trim(F.split_part(F.regexp_extract(F.trim(F.split_part(bare, F.lit(";"), F.lit(1))), r"^[^=<>~!]*", 0), F.lit("["), F.lit(1)))
    skip = (bare == "") | bare.rlike(r"^[-.]") | F.startswith(bare, F.lit("git+")) | (F.contains(bare, F.lit("@")) & F.contains(bare, F.lit("://")))
    return F.when(~skip & (name != ""), F.lower(name))
