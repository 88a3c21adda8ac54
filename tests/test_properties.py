"""Property tests (hypothesis): Python-exact formatting/rounding and score bounds."""

from hypothesis import given, settings
from hypothesis import strategies as st

from queryforge.functions import scalar as S

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(finite, min_size=1, max_size=300), st.integers(min_value=0, max_value=4))
def test_py_fixed_and_round_match_python(spark, vals, digits):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = df.select(S.py_fixed("x", digits).alias("f"), S.py_round("x", digits).alias("r")).collect()
    for v, r in zip(vals, got):
        exp_f = f"{v:.{digits}f}"
        if exp_f.startswith("-") and float(exp_f) == 0.0:
            exp_f = exp_f[1:]  # Spark text has no negative zero
        assert r["f"] == exp_f, (v, digits)
        assert r["r"] == round(v, digits) or (r["r"] == 0.0 and round(v, digits) == 0.0), (v, digits)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=-5, max_value=5, allow_nan=False), min_size=1, max_size=200))
def test_clamped_scores_stay_in_bounds(spark, vals):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    out = [r[0] for r in df.select(S.py_clamp_round("x").alias("s")).collect()]
    assert all(0.001 <= s <= 0.999 for s in out)
    assert out == [round(min(0.999, max(0.001, v)), 3) for v in vals]
