import math

import pytest
from pyspark.sql import functions as F

from rillwork.functions import formula, scalar
from rillwork.functions.formula import FormulaError, Sheet, compile_formula, evaluate, parse
from rillwork.plans.graph import Runtime

VALUES = {"A1": 2.0, "B1": 0.0, "C1": math.nan, "A2": -3.5, "B2": 7.0, "C2": 1e-17}
TEXTS = ["1+2*3", "-(A1 - 4) * B2", "A1 / B1", "-1 / 0", "0/0", "B1 / A1", "A1 = 2", "A1 == 2.0", "A1 < B2 = 1", "C1 > 1", "C1 = C1", "A1 >= 2", "A1 <= 1.5", "SUM(A1:B2)", "SUM(A1, B2, 3)",
         "sum(A1:A2, 10)", "AVG(A1:A2)", "AVG()", "SUM()", "MIN(A1:C2)", "MAX(A1:C2)", "MIN()", "MAX()", "MIN(C1)", "IF(A1 > 1, 10, 1/0)", "IF(C1, 1, 2)", "IF(B1, 1, 2)", "IF(1, 2)", "NOPE(1)", "D9 + 1",
         "C2 = B1", "SUM(B2:A1)", "IF(A1 < 1, 1, IF(A2 < 0, 5, 6))", "2 - -2"]


def test_columns_agree_with_the_driver(spark):
    cells = {c: F.lit(v) for c, v in VALUES.items()}
    got = spark.range(1).select(*[compile_formula(t, cells).alias(f"c{i}") for i, t in enumerate(TEXTS)]).first()
    for i, t in enumerate(TEXTS):
        want = evaluate(parse(t), lambda c: VALUES.get(c, math.nan))
        assert got[i] == want or math.isnan(got[i]) and math.isnan(want), t


@pytest.mark.parametrize("text, value", [("-1/0", math.inf), ("0/0", math.inf), ("1+2*3", 7), ("(1+2)*3", 9), ("IF(1>2, 1/0, 4)", 4), ("SUM()", 0), ("MIN()", math.inf), ("AVG(1,2,6)", 3)])
def test_values(text, value):
    assert evaluate(parse(text), lambda c: math.nan) == value


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 2", "SUM(1", "A1:B2", "1 $ 2", ")", "SUM(,)"])
def test_bad_formulas(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_ranges_and_names():
    assert formula.cell_range("B2", "A1").cells == ("A1", "B1", "A2", "B2")
    assert [formula.cell_name(c, 3) for c in (0, 25, 26, 701, 702)] == ["A3", "Z3", "AA3", "ZZ3", "AAA3"]
    assert formula.cell_place("AB12") == (27, 12)


def test_sheet():
    sheet = Sheet(Runtime(), 3, 4)
    sheet.set("A1", "10")
    sheet.set("A2", "=A1 * 2")
    sheet.set("B1", "text")
    sheet.set("B2", "=SUM(A1:A4)")
    assert sheet.value("B2") == 30 and math.isnan(sheet.value("B1")) and sheet.value("C4") == 0
    assert sheet.update("A1", "1") == {"A1": 1.0, "A2": 2.0, "B2": 3.0}
    sheet.set("C1", "=C2")
    sheet.set("C2", "=C1")
    assert math.isnan(sheet.value("C1"))
    sheet.set("C2", "5")
    assert sheet.value("C1") == 5
    sheet.set("C3", "=1 +")
    assert math.isnan(sheet.value("C3"))


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.haversine_km(F.lit(52.52), F.lit(13.405), F.lit(48.137), F.lit(11.575)).alias("km"),
        *[scalar.travel_premium(F.lit(x)).alias(f"p{i}") for i, x in enumerate((5.0, 20.0, 21.0))],
        scalar.place_key(F.lit(1.0005), F.lit(2.0015)).alias("key"), scalar.ratio(F.lit(5.0), F.lit(0)).alias("r"),
        scalar.health(F.lit(4), F.lit(100.0), F.lit(100)).alias("ok"), scalar.health(F.lit(5), F.lit(100.0), F.lit(100)).alias("worse"), scalar.health(F.lit(15), F.lit(1.0), F.lit(100)).alias("bad")).first()
    assert abs(row["km"] - 504) < 1 and row["p0"] == 0 and abs(row["p1"] - 6.75) < 1e-9 and abs(row["p2"] - 7.4) < 1e-9
    assert row["r"] == 5 and [row["ok"], row["worse"], row["bad"]] == ["healthy", "degraded", "critical"]
