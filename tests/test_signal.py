import numpy as np
import pytest

from heldout.operators import signal as G


def reference_power(x, fs, window_s):
    n = min(len(x), round(window_s * fs))
    step = n - n // 2
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    spectra = []
    for start in range(0, len(x) - n + 1, step):
        w = x[start:start + n]
        w = (w - w.mean()) * hann
        t = np.arange(n)
        p = np.array([abs(np.sum(w * np.exp(-2j * np.pi * f * t / n))) ** 2 for f in range(n // 2 + 1)]) / (fs * (hann**2).sum())
        p[1:(None if n % 2 else -1)] *= 2
        spectra.append(p)
    freq, p = np.arange(n // 2 + 1) * fs / n, np.mean(spectra, axis=0)
    out = {}
    for name, low, high in G.BANDS:
        pick = (freq >= low) & (freq < high)
        out[name] = np.log(np.trapezoid(p[pick], freq[pick]))
    return out


@pytest.mark.parametrize("length", [128, 257, 1000])
def test_band_power_is_welch(spark, length):
    rng = np.random.default_rng(length)
    x = rng.normal(size=length) + np.sin(np.arange(length) / 3)
    df = spark.createDataFrame([("t", "c", i, float(v)) for i, v in enumerate(x)], "trial_uid string, channel string, position int, value double")
    got = {r.band: r.value for r in G.log_bandpower(df, fs=128.0, window_s=2.0).collect()}
    want = reference_power(x, 128.0, 2.0)
    assert got.keys() == want.keys()
    for band in got:
        assert got[band] == pytest.approx(want[band], abs=1e-9)


def test_epoch_bounds_are_errors(spark):
    s = spark.range(10).selectExpr("'r' AS recording", "'c' AS channel", "id AS sample_idx", "1D AS value")
    t = spark.createDataFrame([("r", "t", 5, 11)], "recording string, trial_uid string, start bigint, stop bigint")
    with pytest.raises(ValueError, match="bounds"):
        G.cut_epochs(s, t)


def test_regions_must_partition(spark):
    with pytest.raises(ValueError, match="partition"):
        G.enumerate_views(spark, ["a", "b"], ["x"], {"r": ["a"]})


def test_pooling_of_uneven_vectors_and_gaps(spark):
    """One vector of each key is shuffled, not one row per entry; lengths may differ and entries may be null."""
    rows = [("a", 1.0, [1.0, 2.0]), ("a", 3.0, [5.0, None, 7.0]), ("b", 2.0, [None]), ("c", None, [4.0]), ("c", 2.0, [8.0])] + [("d", 1.0, [float(i)]) for i in range(100)]
    got = {r.k: r.vector for r in G.pool_vectors(spark.createDataFrame(rows, "k string, w double, vector array<double>").repartition(5), weight="w", key="k").collect()}
    assert got == {"a": [4.0, 0.5, 7.0], "b": [None], "c": [8.0], "d": [49.5]}
    plan = G.pool_vectors(spark.createDataFrame(rows, "k string, w double, vector array<double>"), weight="w", key="k")._jdf.queryExecution().toString()
    assert "posexplode" not in plan
