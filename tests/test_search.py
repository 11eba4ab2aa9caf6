"""A race finds what the full search finds with fewer fits; broken candidates drop for the reason they have."""

import pytest
from lodestone.functions.signals import ipw_signal
from lodestone.operators import learners as L
from lodestone.operators.curves import normalised_area
from lodestone.operators.sampling import holdout_split
from lodestone.operators.search import Race, release
from lodestone.sources.snapshots import Snapshots
from pyspark.sql import functions as F
from test_learners import planted


def signal():
    return ipw_signal("conversion", "treatment", 0.5)


def cells(*columns):
    return lambda train: L.cell_scorer(train, list(columns), "conversion")


def constant(value):
    return lambda train: lambda d: d.withColumn("score", F.lit(value))


@pytest.fixture(scope="module")
def data(spark):
    """The effect hangs on x0; of the six candidates one cuts there."""
    half = lambda c: (F.col(c) > 0.5).cast("int")
    noise = lambda k: F.pmod(F.xxhash64("row_id", F.lit(k)), F.lit(4))
    return planted(spark, 12000, seed=5).withColumns({"right": half("x0"), "other": half("x1"), "n1": noise(1), "n2": noise(2), "n3": noise(3)}).cache()


CANDIDATES = {"right": cells("right"), "other": cells("other"), "n1": cells("n1"), "n2": cells("n2"), "n3": cells("n3"), "flat": constant(0.1)}


def full_search(df, seeds, share):
    """Mean Qini score of every candidate fitted on all training rows, without a race."""
    total = dict.fromkeys(CANDIDATES, 0.0)
    for seed in seeds:
        d = holdout_split(df, share, seed)
        for name, build in CANDIDATES.items():
            s = build(d.where("split = 'train'"))(d.where("split = 'test'")).withColumn("outcome", F.col("conversion"))
            total[name] += normalised_area(s, "qini").first()[0]
    return max(total, key=total.get)


def test_the_winner_of_the_full_search_with_under_half_its_rows(data):
    race = Race(shares=(0.2, 1.0), seeds=(101, 202), keep=3)
    got = race.run(data, CANDIDATES, "other", signal())
    assert got.winner == full_search(data, race.seeds, race.held_out) == "right"
    fits = got.fits.collect()
    assert sum(r["rung"] == 1 for r in fits) < 0.5 * len(CANDIDATES) * 2 + 1
    assert sum(r["share"] for r in fits) < 0.6 * len(CANDIDATES) * 2
    assert len(fits) == len({(r["rung"], r["candidate"], r["validation_seed"]) for r in fits})
    gone = {r["candidate"]: (r["rung"], r["reason"]) for r in got.dropped.collect()}
    assert set(gone) == set(CANDIDATES) and gone["right"] == (1, None) and gone["other"] == (1, None)
    assert gone["flat"] == (0, "too_few_values")
    assert {reason for _, reason in gone.values()} <= {None, "too_few_values", "dominated", "outranked"}


def test_odd_candidates(data):
    race = Race(shares=(0.5, 1.0), seeds=(7,), keep=1.5)
    odd = {"base": cells("other"), "nan": constant(float("nan")), "none": lambda train: lambda d: d.withColumn("score", F.lit(None).cast("double"))}
    got = race.run(data, odd, "base", signal())
    assert got.winner == "base"
    assert {(r["candidate"], r["reason"]) for r in got.dropped.collect()} == {("base", None), ("nan", "not_finite"), ("none", "not_finite")}
    for wrong in ({"shares": (0.5, 0.2, 1.0)}, {"shares": (0.5,)}, {"keep": 1.0}):
        with pytest.raises(ValueError):
            Race(**wrong)
    with pytest.raises(ValueError, match="no candidate"):
        race.run(data, odd, "absent", signal())


def test_cell_scorer_scores_unseen_cells(spark):
    rows = [(1, "a", 1, 1), (2, "a", 0, 0), (3, "b", 1, 0), (4, "b", 0, 0), (5, None, 1, 1), (6, None, 0, 0)]
    d = spark.createDataFrame(rows, "row_id long, c string, treatment int, conversion int")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "row_id long, c string")
    got = {r["row_id"]: r["score"] for r in L.cell_scorer(d, ["c"], "conversion")(new).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: pytest.approx(2 / 3), 4: 1.0}


def test_release_confirms_on_rows_that_no_fit_saw(spark, data, tmp_path):
    lot = F.pmod(F.col("row_id"), F.lit(5))
    d = data.withColumn("split", F.when(lot == 0, "confirmation").when(lot == 1, "validation").otherwise("fit"))
    number = release(spark, f"{tmp_path}/r", d, "right", CANDIDATES["right"], signal(), [0.1, 0.5])
    kept = Snapshots(spark, f"{tmp_path}/r")
    facts = kept.current()["facts"]
    assert number == 1 and facts["rows_fit"] == 9600 and facts["rows_confirmed"] == 2400 and facts["qini_score"] > 0.2
    assert kept.read(verify=True).where("row_id % 5 <> 0").isEmpty() and set(facts["policy_value"]) == {"0.1", "0.5"}
    with pytest.raises(Exception, match="not finite"):
        release(spark, f"{tmp_path}/r", d, "nan", constant(float("nan")), signal(), [0.1])
    with pytest.raises(ValueError, match="rows to confirm"):
        release(spark, f"{tmp_path}/r", d.where("split = 'fit'"), "right", CANDIDATES["right"], signal(), [0.1])
    assert kept.current()["number"] == 1
