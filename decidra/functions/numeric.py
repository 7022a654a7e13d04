"""Numbers: logistic, softmax, confidence, entropy-like losses and schedules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def sigmoid(z: Column) -> Column:
    """Logits beyond 30 count as 30; results stay 1e-9 away from 0 and 1."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return F.greatest(F.least(1 / (1 + F.exp(-z)), F.lit(1 - 1e-9)), F.lit(1e-9))


def logit(p: Column, floor: float = 1e-6) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return F.ln(p / (1 - p))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Shares of an array of logits at a temperature; the largest is taken off first."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp((z - top) / t)))
    return let(powers, lambda p: let(total(p), lambda s: F.transform(p, lambda x: x / s)))


def log_sum_exp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: top + F.ln(total(F.transform(values, lambda x: F.exp(x - top)))))


def renormalised(p: Column) -> Column:
    """Shares that add up to 1; all zero stays zero."""
    return let(total(p), lambda s: F.transform(p, lambda x: x / F.when(s == 0, F.lit(1.0)).otherwise(s)))


def yes_confidence(p: Column) -> Column:
    """Distance from undecided, 0 to 1."""
    return F.abs(p - 0.5) * 2


def top_confidence(p: Column) -> Column:
    """Share of the likelier of two answers."""
    return F.greatest(p, 1 - p)


def choice_confidence(p: Column) -> Column:
    """Largest share above chance, 1 where there is one option only."""
    chance = 1.0 / F.size(p)
    return F.when(F.size(p) <= 1, F.lit(1.0)).otherwise((F.array_max(p) - chance) / (1 - chance))


def power_mod(base: Column, exponent: Column, modulus: Column) -> Column:
    """base ** exponent % modulus by squaring; for moduli below 2 ** 31 and exponents from 0 on."""
    start = F.struct((F.lit(1).cast("long") % modulus).alias("out"), (base % modulus).cast("long").alias("square"), exponent.cast("long").alias("left"))
    step = lambda a, _: F.struct(F.when(a["left"] % 2 == 1, a["out"] * a["square"] % modulus).otherwise(a["out"]).alias("out"), (a["square"] * a["square"] % modulus).alias("square"), F.floor(a["left"] / 2).alias("left"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step, lambda a: a["out"])


def arg_max(p: Column) -> Column:
    """Place of the largest value from 0 on; of equal ones the first."""
    return F.array_position(p, F.array_max(p)) - 1


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def brier(p: Column, gold: Column) -> Column:
    """Sum of squares against the place of the right option."""
    return total(F.transform(p, lambda x, i: (x - F.when(i == gold, 1.0).otherwise(0.0)) * (x - F.when(i == gold, 1.0).otherwise(0.0))))


def nll(p: Column) -> Column:
    return -F.ln(F.greatest(p, F.lit(1e-9)))


def log_odds(a: Column, b: Column, floor: float = 0.005) -> Column:
    return F.ln(F.greatest(a, F.lit(floor)) / F.greatest(b, F.lit(floor)))


def smoothed(target: Column, s: float) -> Column:
    return target * (1 - s) + 0.5 * s


def learning_rate(step: Column, warmup: int, steps: int) -> Column:
    """Linear warm-up times cosine decay."""
    return F.least(F.lit(1.0), (step + 1) / F.lit(float(warmup))) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(step, F.lit(steps)) / F.lit(float(steps))))


def binary_loss(z: Column, y: Column) -> Column:
    """Cross-entropy from a logit, without overflow."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def choice_loss(logits: Column, target: Column) -> Column:
    """Cross-entropy of a distribution over the options."""
    return let(log_sum_exp(logits), lambda top: total(F.zip_with(logits, target, lambda z, t: (top - z) * t)))


def pointer_score(q: Column, k: Column) -> Column:
    """Scaled inner product of two arrays."""
    return total(F.zip_with(q, k, lambda a, b: a.cast("double") * b.cast("double"))) / F.sqrt(F.size(q))


def fit_inside(width: Column, height: Column, side: float = 1024.0) -> Column:
    """Factor by which an image shrinks to fit a square."""
    return F.least(F.lit(1.0), F.lit(side) / F.greatest(width, height))


def hash_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) from MD5 of seed and key, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
