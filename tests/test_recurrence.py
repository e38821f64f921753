"""The block-wise recursion against a plain forward and backward loop."""
import numpy as np
import pandas as pd
import pytest

from kinetide.functions import dsp
from kinetide.operators import intervals
from kinetide.operators.recurrence import Filter, butterworth_low, zero_phase


def whole(sections):
    """The sections as one recursion."""
    b, a = [1.0], [1.0]
    for u, v in sections:
        b, a = np.polymul(b, u), np.polymul(a, v)
    return b, a


def loop(x, b, a, state):
    y = []
    for v in x:
        out = b[0] * v + state[0]
        state = [b[k] * v - a[k] * out + (state[k] if k < len(a) - 1 else 0.0) for k in range(1, len(a))]
        y.append(out)
    return np.array(y)


def plain(x, sections):
    edge = 3 * (sum(len(a) - 1 for _, a in sections) + 1)
    y = np.r_[2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2:-edge - 2:-1]]
    for _ in range(2):
        first = y[0]
        for b, a in sections:  # each starts at rest on the first value, which it lets pass
            rest = [sum(b[k:]) - sum(a[k:]) for k in range(1, len(a))]
            y = loop(y, b, a, [r * first for r in rest])
        y = y[::-1]
    return y[edge:-edge]


def test_design_equals_fixed_coefficients():
    b, a = whole(butterworth_low(4, 10.0, 500.0))
    np.testing.assert_allclose(b, dsp.MUSCLE_LOW[0], rtol=1e-9)
    np.testing.assert_allclose(a, dsp.MUSCLE_LOW[1], rtol=1e-10)
    for order, cutoff in ((1, 3.0), (2, 40.0), (5, 100.0)):  # half the power at the cut-off, all at rest, none at the top
        b, a = whole(butterworth_low(order, cutoff, 500.0))
        z = np.exp(2j * np.pi * cutoff / 500.0)
        assert abs(np.polyval(b, z) / np.polyval(a, z)) == pytest.approx(0.5 ** 0.5, rel=1e-9)
        assert np.polyval(b, 1) / np.polyval(a, 1) == pytest.approx(1) and abs(np.polyval(b, -1)) < 1e-9
    with pytest.raises(ValueError):
        butterworth_low(4, 300.0, 500.0)


@pytest.mark.parametrize("order, cutoff", [(4, 10.0), (2, 0.5), (1, 60.0), (3, 2.0)])
@pytest.mark.parametrize("block", [50, 333, 100_000])
def test_blocks_equal_a_plain_loop(spark, order, cutoff, block):
    rng = np.random.default_rng(order)
    f_ = butterworth_low(order, cutoff, 500.0)
    edge = 3 * (order + 1)
    frames = [pd.DataFrame({"session_id": s, "t": np.arange(n) * 2, "v": rng.normal(100, 40, n)}) for s, n in (("long", 1999), ("even", 1000), ("edge", edge + 1), ("tiny", edge))]
    got = zero_phase(spark.createDataFrame(pd.concat(frames)).repartition(3), "v", Filter(f_), 700, block=block).orderBy("session_id", "t").toPandas()
    assert sorted(got.session_id.unique()) == ["edge", "even", "long"]
    for f in frames[:3]:
        mine = got[got.session_id == f.session_id.iloc[0]]
        np.testing.assert_allclose(mine.filtered, plain(f.v.to_numpy(), f_), rtol=1e-8, atol=1e-8)


def test_slow_filter_is_not_cut_off(spark):
    """At 0.05 Hz the response lasts far longer than a block."""
    f_ = butterworth_low(2, 0.05, 500.0)
    x = np.r_[np.zeros(3000), np.full(3000, 50.0)]
    df = spark.createDataFrame(pd.DataFrame({"session_id": "s", "t": np.arange(6000) * 2, "emg_raw": x}))
    got = intervals.envelope(df, "emg_raw", 5000, chunk=400, lowpass_hz=0.05, lowpass_order=2).orderBy("t").toPandas()
    np.testing.assert_allclose(got.envelope, plain(x, f_), rtol=1e-7, atol=1e-7)
