"""Scalar expressions on jets, tracks and scores; all stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The missing-value marker and its comparison tolerance.
SENTINEL, SENTINEL_TOLERANCE = -999.0, 1e-8 + 1e-5 * 999.0
#: Background fractions of the two tagger discriminants.
GN2_FRACTIONS = {"pc": 0.20, "ptau": 0.05, "pu": 0.75}
DL1_FRACTIONS = {"pc": 0.018, "pu": 0.982}


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def signed_log1p(x: Column, scale: float = 1.0) -> Column:
    """sign(x s) ln(1 + |x s|)."""
    return F.signum(x * scale) * F.log1p(F.abs(x * scale))


def clean_sentinel(x: Column) -> Column:
    """Null for the missing-value marker and for anything not finite."""
    x = x.cast("double")
    return F.when(finite(x) & (F.abs(x - SENTINEL) > SENTINEL_TOLERANCE), x)


def wrap_angle(x: Column) -> Column:
    """An angle brought into [-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def binary_score(pb: Column, pu: Column) -> Column:
    """pb / (pb + pu) in [0, 1]; one half where the sum is not positive."""
    both = pb + pu
    return clip(F.when(both > 0, pb / F.nullif(both, F.lit(0.0))).otherwise(F.lit(0.5)), 0.0, 1.0)


def discriminant(pb: Column, others: dict[str, Column], fractions: dict[str, float]) -> Column:
    """Log ratio of the b probability to the weighted background, both at least 1e-12."""
    mixed = sum((others[k] * w for k, w in fractions.items()), F.lit(0.0))
    return F.ln(F.greatest(pb, F.lit(1e-12)) / F.greatest(mixed, F.lit(1e-12)))


def pair_kinematics(pt1: Column, eta1: Column, phi1: Column, pt2: Column, eta2: Column, phi2: Column) -> dict[str, Column]:
    """Angles, distance, massless invariant mass and log momentum ratio of two objects."""
    dphi, deta = wrap_angle(phi1 - phi2), eta1 - eta2
    mass2 = 2 * pt1 * pt2 * (F.cosh(clip(deta, -20.0, 20.0)) - F.cos(dphi))
    return {
        "abs_dphi": F.abs(dphi),
        "cos_dphi": F.cos(dphi),
        "deta": deta,
        "dr": F.sqrt(dphi * dphi + deta * deta),
        "mass": F.sqrt(F.greatest(mass2, F.lit(0.0))),
        "log_pt_ratio": F.ln(F.greatest(pt1, F.lit(1e-12)) / F.greatest(pt2, F.lit(1e-12))),
    }


def met_pair(pt: Column, phi: Column, met: Column, met_phi: Column) -> dict[str, Column]:
    """Angle to the missing momentum and transverse mass."""
    dphi = wrap_angle(phi - met_phi)
    return {"abs_dphi": F.abs(dphi), "cos_dphi": F.cos(dphi), "mt": F.sqrt(F.greatest(2 * pt * met * (1 - F.cos(dphi)), F.lit(0.0)))}


def topology(n_jets: Column) -> Column:
    """Jet-count category: 0, 1, or 2 for two and more."""
    return F.when(n_jets < 0.5, 0).when(n_jets < 1.5, 1).otherwise(2)


def sigmoid(x: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -limit, limit)))


def hard_concrete(x: Column, temperature: float = 2 / 3, low: float = -0.1, high: float = 1.1, limit: float = 25.0) -> Column:
    """A gate in [0, 1]: the sigmoid of x / temperature, stretched to (low, high) and cut."""
    return clip(sigmoid(x / temperature, limit) * (high - low) + low, 0.0, 1.0)


def expected_open(x: Column, temperature: float = 2 / 3, low: float = -0.1, high: float = 1.1, limit: float = 25.0) -> Column:
    """The probability that a hard-concrete gate is not 0."""
    return sigmoid(x - temperature * math.log(-low / high), limit)


def finite_ratio(a: Column, b: Column) -> Column:
    """a / b if finite, else null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(finite(out), out)


def log_odds_field(p1: Column, prior1: Column) -> Column:
    """Log odds of a probability, corrected by the log odds of the prior."""
    return F.ln(p1 / prior1) - F.ln((1 - p1) / (1 - prior1))


def information(p1: Column, prior1: Column) -> Column:
    """Kullback-Leibler information of (1 - p1, p1) over the priors."""
    return p1 * F.ln(p1 / prior1) + (1 - p1) * F.ln((1 - p1) / (1 - prior1))


def information_bound(prior1: Column) -> Column:
    """The largest information, that of a certain label of the rarer class."""
    return -F.ln(F.least(prior1, 1 - prior1))


# -- SplitMix64 by 16-bit limbs, as 64-bit products would overflow ------------

_LIMB = 65536


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(_LIMB - 1)) for k in range(4)]


def _join(limbs: list[Column]) -> Column:
    out = limbs[0]
    for k in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(limbs[k], 16 * k))
    return out


def wrapping_add(x: Column, y: int) -> Column:
    """x + y modulo 2^64."""
    out, carry = [], F.lit(0).cast("long")
    for k, a in enumerate(_limbs(x)):
        s = a + F.lit((y >> (16 * k)) & (_LIMB - 1)) + carry
        out.append(s.bitwiseAND(F.lit(_LIMB - 1)))
        carry = F.shiftright(s, 16)
    return _join(out)


def wrapping_multiply(x: Column, y: int) -> Column:
    """x * y modulo 2^64."""
    a, b = _limbs(x), [(y >> (16 * k)) & (_LIMB - 1) for k in range(4)]
    out, carry = [], F.lit(0).cast("long")
    for k in range(4):
        s = carry
        for i in range(k + 1):
            s = s + a[i] * F.lit(b[k - i])
        out.append(s.bitwiseAND(F.lit(_LIMB - 1)))
        carry = F.shiftright(s, 16)
    return _join(out)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: written out, every use of x would repeat its expression."""
    return F.transform(F.array(x), f)[0]


def splitmix64(x: Column, seed: int = 0) -> Column:
    """The SplitMix64 value of x + seed, as a signed 64-bit number."""

    def shifted(z: Column, k: int, f: Callable[[Column], Column]) -> Column:
        return bound(z, lambda a: bound(a.bitwiseXOR(F.shiftrightunsigned(a, k)), f))

    start = bound(x.cast("long"), lambda a: wrapping_add(a, (seed + 0x9E3779B97F4A7C15) % (1 << 64)))
    last = lambda a: shifted(wrapping_multiply(a, 0x94D049BB133111EB), 31, lambda z: z)
    return shifted(start, 30, lambda a: shifted(wrapping_multiply(a, 0xBF58476D1CE4E5B9), 27, last))


def unsigned_mod(x: Column, n: int) -> Column:
    """The unsigned 64-bit value of x modulo n (below 2^31)."""
    return bound(x, lambda v: ((F.shiftrightunsigned(v, 32) % n) * ((1 << 32) % n) + v.bitwiseAND(F.lit(0xFFFFFFFF))) % n)
