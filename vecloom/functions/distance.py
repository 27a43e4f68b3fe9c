"""Vector distances as column expressions: dot, norm, cosine, L2, and how scores order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(Enum):
    COSINE = "COSINE"
    L2 = "EUCLIDEAN_L2"

    @classmethod
    def of(cls, name: "Metric | OwnMetric | str") -> "Metric | OwnMetric":
        """Accepts the enum, its value, ``cosine``, ``l2``, ``euclidean`` and registered names; else ``ValueError``."""
        if isinstance(name, (cls, OwnMetric)):
            return name
        known = {"COSINE": cls.COSINE, "EUCLIDEAN_L2": cls.L2, "L2": cls.L2, "EUCLIDEAN": cls.L2} | _OWN
        if str(name).upper() not in known:
            raise ValueError(f"unknown distance metric: {name}")
        return known[str(name).upper()]


@dataclass(frozen=True)
class OwnMetric:
    """A metric by a column expression of two vectors; it serves every search that scores by columns."""

    value: str
    expression: Callable[[Column, Column], Column]
    higher_is_better: bool


_OWN: dict[str, OwnMetric] = {}


def register_metric(name: str, expression: Callable[[Column, Column], Column], higher_is_better: bool) -> OwnMetric:
    """Make ``name`` a metric that :meth:`Metric.of` knows; the built-in names cannot be taken."""
    if name.upper() in ("COSINE", "EUCLIDEAN_L2", "L2", "EUCLIDEAN"):
        raise ValueError(f"'{name}' is built in")
    _OWN[name.upper()] = OwnMetric(name.upper(), expression, higher_is_better)
    return _OWN[name.upper()]


def higher_is_better(metric: "Metric | OwnMetric | str") -> bool:
    metric = Metric.of(metric)
    return metric.higher_is_better if isinstance(metric, OwnMetric) else metric is Metric.COSINE


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if a side is null or the lengths differ."""
    total = F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def finite(value: Column) -> Column:
    """``value``, null where it is NaN or infinite: the one rule for scores that compare with nothing."""
    return F.when(F.abs(value) < float("inf"), value)


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Similarity in [-1, 1]; 0 where a vector is all zero. Pass ``norm_b`` to compute it once.

    Null where the vectors cannot be compared: null, of different lengths, or not finite.
    """
    product = norm(a) * (norm(b) if norm_b is None else norm_b)
    ratio = finite(F.when(product == 0, dot(a, b)).otherwise(dot(a, b) / F.nullif(product, F.lit(0.0))))
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0)))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance (not squared); null where the vectors cannot be compared."""
    total = F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return finite(F.when(F.size(a) == F.size(b), F.sqrt(total)))


def score(metric: Metric | str, a: Column, b: Column) -> Column:
    metric = Metric.of(metric)
    if isinstance(metric, OwnMetric):
        return finite(metric.expression(a, b))
    return cosine(a, b) if metric is Metric.COSINE else l2(a, b)


def best_first(metric: Metric | str, column: str = "score") -> list[Column]:
    """Sort keys: similarities fall, distances rise, NaN and null come last."""
    clean = F.nanvl(F.col(column), F.lit(None).cast("double"))
    return [clean.desc_nulls_last() if higher_is_better(metric) else clean.asc_nulls_last()]


def heap_score(metric: Metric | str, value: Column) -> Column:
    """The score turned so that higher is better; its own inverse."""
    return value if higher_is_better(metric) else -value


def band(value: Column) -> Column:
    """Display band of a similarity."""
    return F.when(value > 0.75, "success").when(value > 0.5, "warning").otherwise("error")


def percent(value: Column) -> Column:
    return F.least(F.greatest(value * 100, F.lit(0.0)), F.lit(100.0))
