"""Reading, checking and printing formulas."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorspark.plans.formula import COMMON_ALIASES, Days, FormulaError, FormulaOptions, call, feature, is_valid, parse, reach
from factorspark.plans.operators import Elementwise, Rolling, register_operator, unregister_operator

GOOD = [
    "Div(Mean($volume,10d),Greater(Mul(0.5,$low),-1.0))", "Abs(Sub(EMA($close,40d),Ref($open,10d)))", "Corr($close,$volume,20d)",
    "CSRank(Delta($vwap,5d))", "Mul(-30.0,Std($close,1d))", "Add(Constant(2),$high)", "Ref($close,-20d)", "Log($pe_ratio)",
]
BAD = [
    "Mean($close", "Mean($close,10d))", "Foo($close)", "Mean($nothing,5d)", "Mean($close,$open)", "Add($close,5d)", "Sub(1.0,2.0)",
    "Abs(3.0)", "Mean($close,2.5d)", "Corr($close,$open)", "", "5d", "$close $open", "Add(close,)close", "lambda: 1", "Mean(close,5,d)",
]


@pytest.mark.parametrize("text", GOOD)
def test_round_trip(text):
    node = parse(text)
    assert parse(str(node)) == node


@pytest.mark.parametrize("text", BAD)
def test_rejected(text):
    if text == "5d":
        assert isinstance(parse(text), Days)
    else:
        assert not is_valid(text)


def test_plain_numbers_and_names():
    assert str(parse("Mean(close,10)")) == "Mean($close,10d)"
    assert not is_valid("Mean(close,10)", FormulaOptions(need_suffix=True))
    assert not is_valid("Mean(close,10d)", FormulaOptions(need_dollar=True))
    assert not is_valid("Ref($close,-1d)", FormulaOptions(allow_non_positive=False))
    assert str(parse("mean(CLOSE,3d)", FormulaOptions(ignore_case=True))) == "Mean($close,3d)"


def test_aliases_choose_by_fit():
    o = FormulaOptions(aliases=COMMON_ALIASES)
    assert str(parse("Max($close,$open)", o)) == "Greater($close,$open)"
    assert str(parse("Max($close,5d)", o)) == "Max($close,5d)"
    assert str(parse("Delta($close,$open)", o)) == "Sub($close,$open)"


def test_feature_mask_and_slow_features():
    assert not is_valid("Abs($low)", FormulaOptions(features=frozenset(["close"])))
    assert is_valid("Abs($anything)", FormulaOptions(features=None))
    strict = FormulaOptions(strict_slow_features=True)
    assert not is_valid("Mean($pe_ratio,5d)", strict)
    assert is_valid("Mean(Mul($pe_ratio,$close),5d)", strict)


def test_dsl():
    c = feature("close")
    assert str(-abs(c - 2) / (1 + c)) == "Div(Sub(0.0,Abs(Sub($close,2.0))),Add(1.0,$close))"
    assert str(call("Mean", c**2, 5)) == "Mean(Pow($close,2.0),5d)"
    with pytest.raises(FormulaError):
        call("Mean", c)


def test_reach():
    assert reach(parse("Mean(Ref(Std($close,5d),3d),4d)")) == (4 + 3 + 3, 0)
    assert reach(parse("Sub(Ref($close,-20d),Delta($close,7d))")) == (7, 20)


def test_registered_operators(spark):
    from pyspark.sql import functions as F

    register_operator(Elementwise("Half", lambda x: x / 2.0), spark)
    register_operator(Rolling("Span", lambda x, n, f: F.max(x).over(f.last(n)) - F.min(x).over(f.last(n))))
    try:
        assert str(parse("Half(Span($close,5d))")) == "Half(Span($close,5d))"
        with pytest.raises(ValueError):
            register_operator(Elementwise("Broken", lambda x: F.ln(x) / F.lit(0.0) if False else F.lit(float("nan")) * x), spark)
        with pytest.raises(ValueError):
            register_operator(Elementwise("Mean", lambda x: x))
    finally:
        unregister_operator("Half")
        unregister_operator("Span")


leaf = st.sampled_from(["$close", "$volume", "0.5", "-30.0"])
tree = st.recursive(
    leaf,
    lambda t: st.one_of(
        st.builds("{}({})".format, st.sampled_from(["Abs", "Log", "CSRank"]), t),
        st.builds("{}({},{})".format, st.sampled_from(["Add", "Div", "Greater"]), t, t),
        st.builds("{}({},{}d)".format, st.sampled_from(["Mean", "Std", "Ref"]), t, st.integers(1, 50)),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(tree)
def test_any_legal_formula_round_trips(text):
    if is_valid(text):
        node = parse(text)
        assert str(parse(str(node))) == str(node)
