import os
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest

import __spark_entry__ as entry
from detectra.sources import csv, xlsx
from detectra.plans.study import SimulationStudy

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text(" Crack Length ,Crack Length,Signal (dB)\n1,2,3\nx,5,6\n")
    df = csv.read_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["Crack_Length", "Crack_Length_1", "Signal_dB"] and csv.default_outcome(df) == "Signal_dB"
    csv.write_csv(df, str(tmp_path / "out"))
    csv.write_csv(df.limit(1), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_report(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(float(x), float(3 * x + e)) for x, e in zip(r.uniform(0, 10, 1200), r.normal(0, 1, 1200))]
    st = SimulationStudy(spark)
    st.add_data(spark.createDataFrame(rows, "x double, y double"), "y")
    st.pod("x", 15.0, n_boot=0, model_override="polynomial", force_degree=1)
    csv.write_report(st.report(), str(tmp_path / "report"), "csv")
    assert set(os.listdir(tmp_path / "report")) == {"summary", "curve", "reliability"}
    st.save_report(str(tmp_path / "report.xlsx"))
    assert "worksheets/sheet3.xml" in " ".join(zipfile.ZipFile(tmp_path / "report.xlsx").namelist())
    moved = st.update_slice({})
    assert moved.threshold == 15.0 and moved.n_boot == 0


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    odd = spark.createDataFrame([(1, "a<b>&\x01 ", None, float("nan"), True), (-2, None, 1.5, 2e300, False)], "i long, s string, d double, e double, b boolean")
    xlsx.write_xlsx({"one/two": odd, "one:two": odd.limit(0), "x" * 40: odd.select("i")}, path)
    space = {"m": xlsx.MAIN}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", space)]
        cells = {c.get("r"): "".join(c.itertext()) for c in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iterfind(".//m:c", space)}
        empty = list(ElementTree.fromstring(z.read("xl/worksheets/sheet2.xml")).iterfind(".//m:row", space))
    assert names == ["one_two", "one_two_2", "x" * 31] and len(empty) == 1
    assert cells == {"A1": "i", "B1": "s", "C1": "d", "D1": "e", "E1": "b", "A2": "1", "B2": "a<b>& ", "E2": "1", "A3": "-2", "C3": "1.5", "D3": "2e+300", "E3": "0"}
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def values(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(None if r[i] is None else r[i] for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not re.match(r"op\d+_|pipeline", k)))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert values([tuple(r) for r in df.collect()], df.columns) == values(cur.fetchall(), names)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
