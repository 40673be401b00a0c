"""Vector expressions over array columns. Elements are widened to double before they are multiplied, and sums fold from the left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def prefix(v: Column | str, m: Column | int) -> Column:
    """The first m components."""
    return F.slice(_col(v), F.lit(1), F.lit(m) if isinstance(m, int) else m)


def suffix(v: Column | str, m: Column | int) -> Column:
    """The components after the first m."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.slice(_col(v), m + 1, F.greatest(F.size(_col(v)) - m, F.lit(0)))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str, p: int = 2) -> Column:
    if p not in (1, 2):
        raise ValueError("norms are 1 or 2")
    x = F.transform(_col(v), lambda e: F.abs(e.cast("double")) if p == 1 else e.cast("double") * e.cast("double"))
    return _sum(x) if p == 1 else F.sqrt(_sum(x))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def similarity(a: Column | str, b: Column | str, kind: str = "dot") -> Column:
    """Of two vectors already cut to one width: cosine normalises what it is given, dot doesn't."""
    if kind not in ("dot", "cosine"):
        raise ValueError(f"similarity is dot or cosine, not {kind}")
    return dot(a, b) if kind == "dot" else cosine(a, b)


def normalized(v: Column | str) -> Column:
    n = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(_col(v), lambda x: x.cast("double") / n)


def residual_norm(v: Column | str, m: Column | int, p: int = 2) -> Column:
    """What a prefix of m components leaves out."""
    return norm(suffix(v, m), p)


def residual_utility(v: Column | str, m: Column | int, p: int = 2, epsilon: float = 1e-12) -> Column:
    """1 - |v[m:]| / |v|, within 0 and 1; 1 for the full width and for vectors of no length."""
    n = norm(v, p)
    m_ = F.lit(m) if isinstance(m, int) else m
    return F.when((n <= epsilon) | (m_ >= F.size(_col(v))), 1.0).otherwise(
        F.least(F.greatest(1 - residual_norm(v, m, p) / F.greatest(n, F.lit(epsilon)), F.lit(0.0)), F.lit(1.0))
    )


def padding_quality(v: Column | str, m: Column | int) -> Column:
    """Cosine between a vector and its prefix filled up with zeros."""
    head = prefix(v, m)
    square = _sum(F.transform(head, lambda x: x.cast("double") * x.cast("double")))
    return F.least(F.greatest(square / (F.greatest(norm(v), F.lit(NORM_FLOOR)) * F.greatest(norm(head), F.lit(NORM_FLOOR))), F.lit(0.0)), F.lit(1.0))


def pooled(rows: Column | str, width: int, how: str = "mean") -> Column:
    """One vector of an array of token vectors: their mean, or the first one (`cls`)."""
    r = _col(rows)
    if how == "cls":
        return F.transform(F.element_at(r, 1), lambda x: x.cast("double"))
    if how != "mean":
        raise ValueError(f"pooling is mean or cls, not {how}")
    return F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: F.aggregate(r, F.lit(0.0), lambda a, t: a + F.element_at(t, i).cast("double")) / F.size(r)
    )


#: Significant bits of types.
PRECISION = {"float16": 11, "bfloat16": 8, "float32": 24}


def rounded(v: Column | str, dtype: str) -> Column:
    """Components rounded to the significant bits of a type (its exponent range isn't imitated)."""
    if dtype not in PRECISION:
        raise ValueError(f"the type is one of {sorted(PRECISION)}, not {dtype}")

    def one(x: Column) -> Column:
        e = F.floor(F.log2(F.abs(x.cast("double"))))
        step = F.pow(F.lit(2.0), e - (PRECISION[dtype] - 1))
        return F.when(x == 0, 0.0).otherwise(F.rint(x.cast("double") / step) * step)

    return F.transform(_col(v), one)
