"""Property tests: the three rounding rules against their ground truths on random doubles
(Python's round, numpy's round, JavaScript's Math.round(x * 10^d) / 10^d)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from baleprice.functions.numeric import round_even, round_js, round_py

values = st.lists(
    st.one_of(
        st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False),
        st.integers(min_value=-2_000_000, max_value=2_000_000).map(lambda k: k / 2000.0),  # many ties
        st.integers(min_value=0, max_value=100_000).map(lambda k: k / 1000.0 * 0.15),
    ),
    min_size=50, max_size=200)


@settings(max_examples=8, deadline=None)
@given(values, st.integers(min_value=0, max_value=4))
def test_rounding_rules(spark, xs, d):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = df.select("x", round_py("x", d).alias("py"), round_even("x", d).alias("np"),
                    round_js("x", d).alias("js")).collect()
    for r in got:
        assert r.py == round(r.x, d), (r.x, d)
        assert r.np == float(np.round(r.x, d)), (r.x, d)
        assert r.js == math.floor(r.x * 10 ** d + 0.5) / 10 ** d, (r.x, d)
