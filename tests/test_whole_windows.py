"""Walk-forward windows reach to the last cycle of the log."""

from test_catalogue import FOLDER

from trialforge.plans import catalogue
from trialforge.sources.adapters import view


def test_every_whole_fold(spark):
    runs = [(r.cycle, r.composite_score) for r in view(spark, FOLDER, "experiments").select("cycle", "composite_score").collect()]
    first, last = min(c for c, _ in runs), max(c for c, _ in runs)
    mean = lambda a, b: (lambda x: round(sum(x) / len(x), 5) if x else None)([v for c, v in runs if a <= c < b])
    want, k = {}, 0
    while first + 24 + 12 * k + 1 + 6 <= last + 1:
        cut = first + 24 + 12 * k
        want[k], k = (mean(first, cut), mean(cut + 1, cut + 7)), k + 1
    got = {r.fold: (round(r.train_mean, 5), round(r.test_mean, 5)) for r in catalogue.QUERIES["walk_forward"](spark, FOLDER).collect()}
    assert len(want) == 5 and got == want


def test_no_rows(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/orders.parquet").where("false").write.parquet(str(tmp_path / "orders.parquet"))
    assert catalogue.QUERIES["walk_forward"](spark, str(tmp_path)).count() == 0
