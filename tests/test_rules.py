import pytest
from pyspark.sql import functions as F

from tessella.functions import missing, numeric, text
from tessella.functions.rules import Rule, compile_rule, compile_rules, failed_mechanisms, failed_names, set_verdict, verdict

A = Rule("a", "x", "le", 1.0, mechanism="m1")
G = Rule("g", "y", "ge", 2.0, guard_feature="z", guard_op="gt", guard_threshold=0.0, mechanism="m2")


@pytest.fixture(scope="module")
def d(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.5, 3.0, 1.0), (2, 2.0, 1.0, 1.0), (3, nan, 1.0, -1.0), (4, inf, nan, 1.0), (5, 0.0, 1.0, None), (6, None, None, None)]
    return missing.clean_columns(spark.createDataFrame(rows, "i int, x double, y double, z double"), ["x", "y", "z"])


def col(d, c):
    return {r["i"]: r["v"] for r in d.select("i", c.alias("v")).collect()}


def test_missing_is_null(d):
    assert {r["i"] for r in d.filter("x is null").collect()} == {3, 4, 6}


def test_fail_open(d):
    assert col(d, compile_rule(A)) == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    assert col(d, compile_rule(G)) == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}


def test_three_valued_is_kleene(d):
    assert col(d, compile_rule(A, "three_valued")) == {1: True, 2: False, 3: None, 4: None, 5: True, 6: None}
    assert col(d, compile_rule(G, "three_valued")) == {1: True, 2: False, 3: True, 4: None, 5: None, 6: None}
    both = compile_rules([A, G], "three_valued")
    assert col(d, both) == {1: True, 2: False, 3: None, 4: None, 5: None, 6: None}


def test_nan_violates(d):
    assert col(d, compile_rule(A, "nan_violates")) == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_verdicts(d):
    assert col(d, verdict(G)) == {1: "pass", 2: "fail", 3: "not triggered", 4: "no verdict", 5: "no verdict", 6: "no verdict"}
    assert col(d, set_verdict([A, G]))[2] == "implausible" and col(d, set_verdict([A, G]))[1] == "plausible" and col(d, set_verdict([A, G]))[3] == "no verdict"
    assert col(d, F.array_join(failed_names([G, A]), ",")) [2] == "a,g"
    assert col(d, F.array_join(failed_mechanisms([A, G]), ","))[2] == "m1,m2"


def test_unknown_mode():
    with pytest.raises(ValueError):
        compile_rule(A, "maybe")


@pytest.mark.parametrize("formula, key", [("Fe4O6", "Fe2|O3"), ("NaCl", "Cl1|Na1"), ("Na2Cl2", "Cl1|Na1"), ("Li2O2", "Li1|O1"), ("Li2O", "Li2|O1"), ("O", "O1"), ("", None), (None, None), ("C2H6C2", "C2|H3")])
def test_composition_key(spark, formula, key):
    df = spark.createDataFrame([(formula,)], "f string")
    assert df.select(text.composition_key("f")).first()[0] == key


def test_key_values(spark):
    df = spark.createDataFrame([('a=1 b="two words" a=3 junk c=x',), (None,), ("",)], "c string")
    got = [r[0] for r in df.select(text.key_values("c")).collect()]
    assert got[0] == {"a": "3", "b": "two words", "c": "x"} and not got[2]


def test_numeric(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(numeric.ionicity(F.lit(0.0))) == 0.0
    assert v(numeric.radius_ratio_number(F.lit(0.5))) == 6 and v(numeric.radius_ratio_number(F.lit(None).cast("double"))) is None
    assert v(numeric.guarded_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert v(numeric.lower_inclusive_stratum(F.lit(1.0), [1.0, 2.0])) == 0 and v(numeric.lower_inclusive_stratum(F.lit(None).cast("double"), [1.0])) == -1
    lo, hi = numeric.wilson(F.lit(8), F.lit(10))
    assert abs(v(lo) - 0.490162) < 1e-5 and abs(v(hi) - 0.943318) < 1e-5 and v(numeric.wilson(F.lit(0), F.lit(0))[0]) is None


def test_binomial():
    assert abs(numeric.binomial_cdf(2, 4, 0.5) - 11 / 16) < 1e-12 and numeric.binomial_cdf(-1, 3, 0.5) == 0
    assert abs(numeric.clopper_pearson_upper(0, 10) - (1 - 0.05**0.1)) < 1e-9 and numeric.clopper_pearson_upper(5, 5) == 1
    assert abs(numeric.mcnemar_exact(5, 0) - 1 / 32) < 1e-12 and numeric.mcnemar_exact(0, 0) == 1
