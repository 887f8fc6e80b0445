"""Classification and validation tables."""

import pytest

from oncolattice.operators import cases as c
from oncolattice.sources import vocabulary as v

TABLE = [
    ("3+", None, "HER2_Positive", "HIGH", "PASS", False),
    ("3+", "Group1", "HER2_Positive", "HIGH", "PASS", False),
    ("3+", "Group5", "HER2_Positive", "HIGH", "FAIL", True),
    ("2+", None, "HER2_Equivocal", "MEDIUM", "FAIL", True),
    ("2+", "", "HER2_Equivocal", "MEDIUM", "FAIL", True),
    ("2+", "Group1", "HER2_Positive", "HIGH", "PASS", False),
    ("2+", "Group3", "HER2_Equivocal", "MEDIUM", "PASS", False),
    ("2+", "Group5", "HER2_Low", "HIGH", "PASS", False),
    ("1+", None, "HER2_Low", "HIGH", "PASS", False),
    ("0+", None, "HER2_Ultralow", "HIGH", "PASS", False),
    ("0", None, "HER2_Null", "HIGH", "PASS", False),
    ("bad_value", None, "UNKNOWN", "LOW", "WARN", True),
    ("IHC2Plus", "Group2", "HER2_Equivocal", "MEDIUM", "WARN", True),
    (None, None, "UNKNOWN", "LOW", "PASS", False),
]
SCHEMA = "case_id int, ihc_score string, ish_group string, ish_ratio double, signals_per_cell double, fractal_d0 double"


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(n, ihc, ish, None, None, 1.5) for n, (ihc, ish, *_) in enumerate(TABLE)]
    return {r["case_id"]: r for r in c.validate(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("n", range(len(TABLE)))
def test_table(checked, n):
    _, _, category, confidence, status, review = TABLE[n]
    r = checked[n]
    assert (r["classification"], r["confidence"], r["status"], r["needs_review"]) == (category, confidence, status, review)


def test_steps_and_guideline(checked):
    assert checked[3]["pathway_steps"][0] == "IHC_ENTRY"
    assert "Reflex ISH" in checked[3]["action_required"]
    assert checked[7]["pathway_steps"][-1] == c.STEP_GROUP5
    assert checked[9]["applicable_guideline"] == "Rakha_International_2026"
    assert checked[11]["applicable_guideline"] is None and checked[11]["pathway_steps"] == []


@pytest.mark.parametrize("ratio,signals,group", [(2.0, 4.0, 1), (2.0, 3.9, 2), (1.9, 6.0, 3), (1.9, 4.0, 4), (1.9, 5.9, 4), (1.9, 3.9, 5)])
def test_group_bounds(spark, ratio, signals, group):
    df = spark.createDataFrame([(ratio, signals)], "r double, s double")
    assert df.select(c.ish_group(df.r, df.s)).first()[0] == f"Group{group}"


def test_workup(spark):
    rows = [(n, s, None, r, g, None) for n, (s, r, g) in enumerate([("3+", 2.1, 3.0), ("2+", 1.5, 6.5), ("1+", 1.5, 5.0), ("3+", 2.5, 5.0), ("x", 2.1, 3.0)])]
    out = {r["case_id"]: r for r in c.group_workup(spark.createDataFrame(rows, SCHEMA), v.decision_nodes_df(spark)).collect()}
    assert out[0]["outcome"] == "HER2_Positive" and out[0]["group"] == "Group2"
    assert out[1]["workup_action"] == v.RECOUNT_ACTION and out[1]["outcome"] is None
    assert out[2]["outcome"] == "HER2_Negative"
    assert 3 not in out and 4 not in out


def test_d0_range(spark):
    rows = [(1, "0", None, None, None, 1.9), (2, "0", None, None, None, 1.4), (3, "0", None, None, None, None)]
    corr = spark.createDataFrame([("HER2_Null", "D0", 1.0, 1.45)], "category_id string, metric_label string, d0_low double, d0_high double")
    out = c.fractal_issues(c.classify(spark.createDataFrame(rows, SCHEMA)), corr).collect()
    assert [r["case_id"] for r in out] == [1]
    assert out[0]["description"] == "Fractal D0=1.9 is outside expected range [1.0, 1.45] for HER2_Null (metric: D0)"
