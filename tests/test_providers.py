"""Extension points."""
import numpy as np
import pandas as pd
import pytest

from modalframe.functions import providers


def test_peak_provider_finds_resonances(spark):
    f = np.arange(5, 105, 0.5)
    lines = []
    for node in (1, 2, 3):
        h = sum(a / (p * p - f * f + 2j * 0.01 * p * f) for p, a in ((30.0, node), (70.0, 2.0 - node)))
        lines += [(1, node, -3 if node == 2 else 3, 9, 3, i, float(x), float(v.real), float(v.imag)) for i, (x, v) in enumerate(zip(f, h))]
    df = spark.createDataFrame(pd.DataFrame(lines, columns=["dataset_id", "rsp_node", "rsp_dir", "ref_node", "ref_dir", "line", "f_hz", "re", "im"]))
    got = providers.fit_modes("frf_peaks", df).toPandas()
    assert sorted(got.f_hz.unique()) == [30.0, 70.0]
    low = got[got.f_hz == 30.0].set_index("node_id")
    assert low.im[1] * low.im[3] > 0 and low.im[1] * low.im[2] < 0  # a negative direction turns the sign
    with pytest.raises(KeyError):
        providers.fit_modes("missing", df)


def test_failed_realisations_are_kept_as_text(spark):
    df = spark.createDataFrame([(i, float(i - 1)) for i in range(4)], "draw long, x double")

    def runner(pdf):
        if pdf.x.iloc[0] <= 0:
            raise ValueError("not positive")
        return {"root": pdf.x.iloc[0] ** 0.5}

    out = providers.run_realisations(df, ["draw"], runner, ["root"])
    got = {r.draw: r for r in out.collect()}
    assert got[0].failure == "ValueError: not positive" and got[3].root == 2 ** 0.5
    assert tuple(providers.realisation_summary(out, ["root"]).first())[:2] == (2, 2)
