"""Single-ticker samples (F10, F16, M18) and the significance filter."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ticklens.operators import compare, container, models
from ticklens.plans import queries as Q


@pytest.fixture(scope="module")
def cont(spark):
    return Q.container_lineitem(spark, SF001)


def test_single_ticker_plot_variables(spark, cont):
    one = container.plot_variables(cont, ticker="ADSGn.DE").collect()
    assert one and {r.ticker for r in one} == {"ADSGn.DE"}
    w = [r.W for r in one]
    w_star = sum(w) / len(w)
    import math
    for r in one:
        if r.W and r.W > 0:
            assert r.log_w_over_w_star_plot == pytest.approx(math.log(r.W) / w_star)
    every = {r.date: r.log_w_over_w_star_plot
             for r in container.plot_variables(cont).filter(F.col("ticker") == "ADSGn.DE").collect()}
    for r in one:   # W* is per ticker, so sampling one ticker changes nothing
        assert (r.log_w_over_w_star_plot is None and every[r.date] is None) or \
            r.log_w_over_w_star_plot == pytest.approx(every[r.date])


def test_single_ticker_fitted_line(spark, cont):
    one = models.fitted_line(cont, ticker="ADSGn.DE", log=False).collect()
    assert one and {r.ticker for r in one} == {"ADSGn.DE"}
    import numpy as np
    x = np.array([r.x for r in one])
    y = np.array([r.y for r in one])
    slope, intercept = np.polyfit(x, y, 1)
    for r in one:
        assert r.fitted == pytest.approx(intercept + slope * r.x, rel=1e-8)


def test_significance_filter(spark, cont):
    coef = models.per_ticker(cont)
    sig = compare.significant(coef, 0.05)
    assert sig.filter(F.col("p") > 0.05).count() == 0
    assert sig.count() == coef.filter(F.col("p") <= 0.05).count()
