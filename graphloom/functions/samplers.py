"""Seeded samples as columns: a value depends on its key and the parameters alone, so nothing is drawn twice.

Parameters may be columns themselves: a two-level sampler draws them by a key of the group and then values by a
key of the row (``meta_choice``, or any function here given drawn parameters). Rejection methods look at TRIES
draws of one key and take the first that fits; the chance that none does is under 1e-12 for gamma and beta.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import uniform

TRIES = 12
Key = tuple[Column | str | int, ...]


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def between(key: Key, low: Column | float, high: Column | float) -> Column:
    return _col(low) + uniform(*key) * (_col(high) - _col(low))


def log_between(key: Key, low: Column | float, high: Column | float) -> Column:
    """Uniform in the logarithm."""
    return F.exp(between(key, F.log(_col(low)), F.log(_col(high))))


def whole_between(key: Key, low: Column | int, high: Column | int) -> Column:
    """Whole numbers from ``low`` to ``high``, both included."""
    low, high = _col(low), _col(high)
    return (low + F.least(F.floor(uniform(*key) * (high - low + 1)), high - low)).cast("long")


def whole_or_default(key: Key, low: int, high: int, default: int, chance: float) -> Column:
    return F.when(uniform(*key, "|default") < chance, F.lit(default)).otherwise(whole_between(key, low, high)).cast("long")


def whole_log_between(key: Key, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round(log_between(key, low, high)))).cast("long")


def mixed_log_between(key: Key, first: tuple[float, float], second: tuple[float, float], chance: float) -> Column:
    """From the first range with ``chance``, else from the second."""
    return F.when(uniform(*key, "|which") < chance, log_between(key, *first)).otherwise(log_between(key, *second))


def choice(key: Key, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(*key) * len(values)) + 1).cast("int"))


def weighted_choice(key: Key, values: list, weights: list[Column | float]) -> Column:
    """A value by weights, which need not sum to one."""
    ws = [_col(w) for w in weights]
    total = sum(ws[1:], ws[0])
    x, upto, out = uniform(*key) * total, F.lit(0.0), None
    for value, w in zip(values[:-1], ws[:-1], strict=True):
        upto = upto + w
        out = F.when(x < upto, F.lit(value)) if out is None else out.when(x < upto, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def meta_choice(key: Key, group: Key, values: list, low: float, high: float) -> Column:
    """A value by the softmax of logits that the group draws uniformly."""
    return weighted_choice(key, values, [F.exp(between((*group, f"|logit{k}"), low, high)) for k in range(len(values))])


def normal(key: Key, mean: Column | float = 0.0, deviation: Column | float = 1.0) -> Column:
    radius = F.sqrt(-2.0 * F.log1p(-uniform(*key, "|r")))
    return _col(mean) + _col(deviation) * radius * F.cos(2 * F.pi() * uniform(*key, "|a"))


def truncated_normal(key: Key, mean: Column | float, deviation: Column | float, low: Column | float, high: Column | float = 1e308) -> Column:
    """The first of TRIES normal draws within the bounds, else the nearer bound's side of the mean."""
    low, high = _col(low), _col(high)
    tries = [normal((*key, f"|t{k}"), mean, deviation) for k in range(TRIES)]
    return F.coalesce(*[F.when((x >= low) & (x <= high), x) for x in tries], F.greatest(low, F.least(high, _col(mean))))


def bimodal_normal(key: Key, first: tuple[float, float], second: tuple[float, float], chance: float, low: float, high: float) -> Column:
    """A truncated normal of one of two (mean, deviation)."""
    one = uniform(*key, "|which") < chance
    return truncated_normal(key, F.when(one, first[0]).otherwise(second[0]).cast("double"), F.when(one, first[1]).otherwise(second[1]).cast("double"), low, high)


def gamma(key: Key, shape: Column | float, scale: Column | float = 1.0) -> Column:
    """By squeezed cubes of normals (Marsaglia and Tsang); shapes under one by the power of one more draw."""
    shape = _col(shape)
    lifted = F.when(shape < 1, shape + 1).otherwise(shape)
    d = lifted - 1.0 / 3
    found = []
    for k in range(TRIES):
        x = normal((*key, f"|g{k}"))
        v = F.pow(1 + x / F.sqrt(9 * d), F.lit(3.0))
        fits = (v > 0) & (F.log1p(-uniform(*key, f"|u{k}")) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        found.append(F.when(fits, d * v))
    power = F.when(shape < 1, F.pow(1 - uniform(*key, "|p"), 1 / shape)).otherwise(1.0)
    return F.coalesce(*found, d) * power * _col(scale)


def whole_gamma(key: Key, shape: float, scale: float, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(gamma(key, shape, scale)))).cast("long")


def beta(key: Key, a: Column | float, b: Column | float, place: float = 0.0, scale: Column | float = 1.0) -> Column:
    x, y = gamma((*key, "|x"), a), gamma((*key, "|y"), b)
    return _col(place) + _col(scale) * x / (x + y)
