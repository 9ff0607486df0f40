import itertools
import math

import numpy as np
import pytest

from driftspan.functions import pvalues as P


def test_chi_square_tables():
    for x, df, p in ((3.841459, 1, 0.05), (9.487729, 4, 0.05), (23.209251, 10, 0.01), (124.342113, 100, 0.05)):
        assert P.chi2_survival(x, df) == pytest.approx(p, abs=1e-7)
    assert P.chi2_survival(0, 3) == 1.0
    for df in (2, 4, 6):
        assert P.chi2_survival(7.5, df) == pytest.approx(math.exp(-3.75) * sum(3.75**k / math.factorial(k) for k in range(df // 2)), abs=1e-12)


def test_kolmogorov_and_cvm_limits():
    assert P.kolmogorov_survival(1.3581) == pytest.approx(0.05, abs=1e-4)
    assert 1 - P.cvm_limit_cdf(0.46136) == pytest.approx(0.05, abs=1e-5)
    assert 1 - P.cvm_limit_cdf(0.74346) == pytest.approx(0.01, abs=1e-5)


def _orders(n, m):
    for own in itertools.combinations(range(n + m), n):
        x = np.zeros(n + m)
        x[list(own)] = 1
        yield x


@pytest.mark.parametrize(("n", "m"), [(3, 4), (5, 5), (2, 6)])
def test_exact_laws_by_enumeration(n, m):
    ks, cvm = [], []
    for x in _orders(n, m):
        gap = np.cumsum(x) / n - np.cumsum(1 - x) / m
        ks.append(np.abs(gap).max())
        cvm.append(n * m / (n + m) ** 2 * (gap**2).sum())
    for d in sorted(set(np.round(ks, 12))):
        assert P.ks_exact(n, m, d) == pytest.approx(np.mean(np.array(ks) >= d - 1e-9), abs=1e-12)
    for t in sorted(set(np.round(cvm, 12)))[::3]:
        assert P.cvm_pvalue(n, m, t) == pytest.approx(np.mean(np.array(cvm) >= t - 1e-9), abs=1e-12)


def test_exact_and_limit_agree_on_large_samples():
    d = 1.2 / math.sqrt(2000)
    assert P.ks_exact(4000, 4000, d) == pytest.approx(P.kolmogorov_survival(d * math.sqrt(2000)), abs=0.01)
