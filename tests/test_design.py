import sys

import numpy as np
import pandas as pd
import pytest

from detectra.operators import adaptive, design
from detectra.operators.executors import CLIExecutor, MatlabExecutor, PythonExecutor


def test_lhs_has_one_point_in_each_stratum(spark):
    pdf = design.generate_lhs(spark, 40, {"a": (0, 10), "b": (-1, 1)}, seed=3).toPandas()
    assert sorted(np.floor(pdf.a / 10 * 40).astype(int)) == list(range(40))
    assert sorted(np.floor((pdf.b + 1) / 2 * 40).astype(int)) == list(range(40))
    again = design.generate_lhs(spark, 40, {"a": (0, 10), "b": (-1, 1)}, seed=3).toPandas()
    pd.testing.assert_frame_equal(pdf.sort_values("id").reset_index(drop=True), again.sort_values("id").reset_index(drop=True))


def test_max_min_order():
    points = np.array([[0.0, 0.0], [0.1, 0.1], [10.0, 10.0], [9.9, 9.9]])
    assert design.reorder_max_min(points).tolist()[:2] == [0, 2]
    assert design.reorder_max_min(points[:2]).tolist() == [0, 1]


@pytest.mark.parametrize(
    ("ranges", "error"),
    [({"a": (1, 1)}, ValueError), ({"a": ("x", 2)}, ValueError), (pd.DataFrame({"Name": ["a"], "Min": [0]}), ValueError), (pd.DataFrame({"Name": [1], "Min": [0], "Max": [1]}), ValueError), ([1, 2], TypeError)],
)
def test_bad_ranges(ranges, error):
    with pytest.raises(error):
        design.check_ranges(ranges)


def test_empty_ranges(spark):
    assert design.generate_lhs(spark, 5, pd.DataFrame()).count() == 0


def test_graveyard(spark):
    c = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 9.0)], "id long, A double")
    bad = spark.createDataFrame([(4.9,), (float("nan"),)], "A double")
    assert sorted(r["A"] for r in adaptive.graveyard_filter(c, bad, ["A"]).collect()) == [1.0, 9.0]
    text = spark.createDataFrame([("broken",)], "A string")
    assert adaptive.graveyard_filter(c, text, ["A"]).count() == 3


def test_gap_is_filled(spark):
    df = spark.createDataFrame([(float(x), float(10 * x), 1.0 * x) for x in (0, 1, 2, 8, 9, 10)], "Length double, Angle double, Signal double")
    pdf = adaptive.fill_gaps(df, "Length", ["Length", "Angle"], 7).toPandas()
    assert len(pdf) == 7 and pdf.Length.between(2, 8).all() and pdf.Angle.between(0, 100).all()


def test_uncertainty(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"x": r.uniform(0, 10, 40), "y": r.normal(0, 1, 40)}))
    assert adaptive.sample_uncertainty(df, ["x"], "y", 6).count() == 6
    assert adaptive.sample_uncertainty(df, ["x"], "y", 0).count() == 0


def test_targeted_samples(spark):
    x = np.concatenate([np.linspace(0, 2, 30), np.linspace(8, 10, 30)])
    noise = np.random.default_rng(2).normal(0, 10, 60)
    out = adaptive.generate_targeted_samples(spark.createDataFrame(pd.DataFrame({"x": x, "y": noise})), ["x"], "y", 5).toPandas()
    assert out.Refinement_Reason.value_counts().to_dict() == {"Gap in x": 5, "High Model Uncertainty": 5}
    line = np.linspace(0, 10, 200)
    assert adaptive.generate_targeted_samples(spark.createDataFrame(pd.DataFrame({"x": line, "y": 3 * line + 5})), ["x"], "y", 5) is None


def batch(spark):
    return spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "Length double, Angle double")


def test_python_executor(spark):
    assert sorted(r["Signal"] for r in PythonExecutor(lambda r: r["Length"] + r["Angle"]).run(batch(spark)).collect()) == [11.0, 22.0]
    assert PythonExecutor(lambda r: r["Nope"]).run(batch(spark)).count() == 0
    assert PythonExecutor(lambda r: 1 / int(r["Length"] - 1)).run(batch(spark)).count() == 0


def solver(tmp_path, body: str) -> str:
    path = tmp_path / "solver.py"
    path.write_text("import sys, pandas as pd\nd = pd.read_csv(sys.argv[1])\n" + body)
    return f"{sys.executable} {path} {{input}} {{output}}"


def test_cli_executor(spark, tmp_path):
    stitched = CLIExecutor(solver(tmp_path, "pd.DataFrame({'Signal': d.Length * 2}).to_csv(sys.argv[2], index=False)")).run(batch(spark)).toPandas()
    assert stitched.sort_values("Length").values.tolist() == [[1.0, 10.0, 2.0], [2.0, 20.0, 4.0]]
    assert CLIExecutor(solver(tmp_path, "pd.DataFrame({'Signal': [1.0]}).to_csv(sys.argv[2], index=False)")).run(batch(spark)).count() == 0
    assert CLIExecutor(solver(tmp_path, "sys.exit(3)")).run(batch(spark)).count() == 0
    assert CLIExecutor(solver(tmp_path, "")).run(batch(spark)).count() == 0


def test_matlab_command():
    assert MatlabExecutor("solve.m").command("i.csv", "o.csv") == ["matlab", "-batch", "solve('i.csv','o.csv')", "-nosplash", "-nodesktop"]


def test_executor_contract(spark):
    with pytest.raises(ValueError, match="rows"):
        adaptive.check_output(batch(spark).limit(1).selectExpr("*", "1D AS y"), batch(spark), ["Length"], "y")
    with pytest.raises(ValueError, match="lacks"):
        adaptive.check_output(batch(spark), batch(spark), ["Length"], "y")


def test_search_converges_and_keeps_failures_out(spark, tmp_path):
    out = adaptive.run_adaptive_search(spark, PythonExecutor(lambda r: None if r["x"] > 9.5 else 3 * r["x"] + 1, "y"), {"x": (0.0, 10.0)}, ["x"], "y", n_start=30, n_step=5, max_iter=2, output_csv=str(tmp_path / "out"))
    pdf = out.toPandas()
    assert len(pdf) >= 28 and (pdf.x <= 9.5).all() and np.allclose(pdf.y, 3 * pdf.x + 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == len(pdf)
