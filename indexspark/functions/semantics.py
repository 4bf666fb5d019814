"""R-compatible NA semantics as Spark column expressions.

The scoring models were written against R's NA rules, which differ from SQL NULL rules in a handful of places.
Every helper here returns a plain ``Column`` (scalar or aggregate) so that it stays inside whole-stage codegen;
none of them is a UDF. Numbering follows the semantic contract N1-N18.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _null_d() -> Column:
    return F.lit(None).cast("double")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- scalar rules


def r_ifelse(cond, yes, no) -> Column:
    """``ifelse(NA, a, b)`` is NA, not ``b``."""
    cond = _c(cond)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def clamp(x, lo=None, hi=None) -> Column:
    """``pmin/pmax`` keep NA; Spark's ``least/greatest`` would skip it."""
    x = _c(x)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        y = F.least(y, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(x.isNull(), _null_d()).otherwise(y)


def isin_safe(x, values: Iterable) -> Column:
    """``x %in% S`` is FALSE (never NA) for an NA ``x``."""
    return F.coalesce(_c(x).isin(list(values)), F.lit(False))


def not_in_safe(x, values: Iterable) -> Column:
    """``!x %in% S`` keeps rows whose ``x`` is NA."""
    return ~isin_safe(x, values)


def nan_to_null(x) -> Column:
    """R treats NaN as NA; Spark's NaN would poison sums and win max/percentile."""
    return F.nanvl(_c(x), _null_d())


def safe_div(a, b) -> Column:
    """Division by zero gives NULL (R gives +-Inf/NaN; both are 'no value' for scoring)."""
    return nan_to_null(F.try_divide(_c(a), _c(b)))


def r_round(x, digits: int = 0) -> Column:
    """R rounds half to even."""
    return F.bround(_c(x), digits)


def row_mean(*cols) -> Column:
    """``rowMeans(cbind(...), na.rm=TRUE)``; all-NA rows give NULL (R: NaN)."""
    cs = [_c(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.when(n > 0, total / n).otherwise(_null_d())


def row_sum(*cols) -> Column:
    """``sum(c(...), na.rm=TRUE)``; all-NA rows give 0."""
    return sum((F.coalesce(_c(c), F.lit(0.0)) for c in cols), F.lit(0.0))


def piecewise_score(x, lower=0.95, upper=1.05, alpha=0.5, beta=0.25) -> Column:
    """P10: buffered score: below ``lower`` linear, above ``upper`` declining by ``alpha`` with floor ``beta``."""
    x = _c(x)
    over = F.lit(1.0) - F.lit(alpha) * (x - F.lit(upper))
    return (
        F.when(x.isNull(), _null_d())
        .when(x < lower, x)
        .when(x > upper, F.when(over > beta, over).otherwise(F.lit(beta)))
        .otherwise(F.lit(1.0))
    )


def log_rescale(x, peak) -> Column:
    """``min(1, ln(x+1)/ln(peak+1))``."""
    return clamp(safe_div(F.log1p(_c(x)), F.log1p(_c(peak))), hi=1.0)


def rescale(x, lo, hi) -> Column:
    """Affine map of [lo, hi] to [0, 1]."""
    return (_c(x) - F.lit(lo)) / F.lit(hi - lo)


def recode(x, mapping: dict) -> Column:
    """Value recode from a literal map; unmapped values pass through."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.element_at(m, _c(x)), _c(x)) if mapping else _c(x)


def format_g(x) -> Column:
    """``sprintf('%g', x)`` for the small decimals used in labels (1, 1.1, 100): drops a trailing ``.0``."""
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


# ---------------------------------------------------------------- aggregate rules


def strict(agg: Column, x) -> Column:
    """An aggregate written without ``na.rm`` is NA as soon as one input is NA."""
    return F.when(F.count(_c(x)) == F.count(F.lit(1)), agg)


def sum0(x) -> Column:
    """``sum(x, na.rm=TRUE)`` over no values is 0."""
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))


def weighted_mean(x, w, na_rm: bool = True) -> Column:
    """``weighted.mean(x, w, na.rm)``.

    With ``na_rm`` rows with NA ``x`` are removed first. Any remaining NA weight makes the result NA. Rows with weight 0
    do not reach the numerator, so an NA ``x`` with weight 0 is harmless even without ``na_rm``. Sum of weights 0 gives
    NULL (R: NaN).
    """
    x, w = _c(x), _c(w)
    keep = x.isNotNull() if na_rm else F.lit(True)
    bad_w = F.sum(F.when(keep & w.isNull(), 1).otherwise(0)) > 0
    bad_x = F.lit(False) if na_rm else F.sum(F.when(x.isNull() & (F.coalesce(w, F.lit(1.0)) != 0), 1).otherwise(0)) > 0
    num = F.sum(F.when(keep & (w != 0), x * w))
    den = F.sum(F.when(keep, w))
    return F.when(bad_w | bad_x, _null_d()).otherwise(safe_div(F.coalesce(num, F.lit(0.0)), den))


def wmean_fallback(x, w) -> Column:
    """Weighted mean (strict on x) when defined, else the simple mean."""
    return F.coalesce(weighted_mean(x, w, na_rm=False), strict(F.avg(_c(x)), x))


def geo_mean(x) -> Column:
    """``exp(mean(log(x), na.rm=TRUE))``.

    A zero gives 0 (R: log(0) = -Inf); a negative value is dropped (R: log is NaN, which na.rm drops); no values
    give NULL.
    """
    x = _c(x)
    n_zero = F.sum(F.when(x == 0, 1).otherwise(0))
    return F.when(n_zero > 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.when(x > 0, F.ln(x)))))


def geo_wmean(s, w) -> Column:
    """A5: ``prod(s ^ w)`` written without ``na.rm``: NA if any factor is NA."""
    s, w = _c(s), _c(w)
    f = F.pow(s, w)
    return strict(F.product(f), f)


def trend_slope(y, x, years: float = 5.0) -> Column:
    """OLS slope of ``y`` on ``x`` times ``years``; NA pairs dropped, one distinct ``x`` gives NULL."""
    return F.regr_slope(nan_to_null(y), _c(x).cast("double")) * F.lit(years)


def latest(v, year) -> Column:
    """Value at the greatest year (may be NULL if that year's value is NULL)."""
    return F.max_by(_c(v), _c(year))


def mean_strict(x) -> Column:
    """``mean(x)`` without ``na.rm``."""
    return strict(F.avg(_c(x)), x)


def sum_strict(x) -> Column:
    """``sum(x)`` without ``na.rm``."""
    return strict(F.sum(_c(x)), x)


def quantile(x, p: float) -> Column:
    """R type-7 quantile (``na.rm=TRUE``), exact: it counts the group's distinct values."""
    return F.percentile(nan_to_null(x), F.lit(p))


def concat_members(key, cond=None, sep: str = ",") -> Column:
    """``paste(key[cond], collapse=',')`` in key order; empty string when none."""
    k = _c(key)
    v = k if cond is None else F.when(cond, k)
    return F.array_join(F.array_sort(F.collect_list(v)), sep)
