"""Scalar building blocks as Column expressions: nothing here leaves whole-stage code generation."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column) -> Column:
    """Rounding halves toward plus infinity, unlike ``round`` (away from zero) and ``bround`` (to even)."""
    return F.floor(x + 0.5)


def finite(x: Column, default: float | None = None) -> Column:
    """``x`` where it is a finite number, else ``default``: NaN and infinities become a defined value at the boundary."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default).cast("double")).otherwise(x)


def per_game(total: Column, games: Column) -> Column:
    return total / F.greatest(F.lit(1.0), games)


def weighted_present(values: list[Column], weights: list[float]) -> Column:
    """Weighted mean over the values that are present, their weights renormalised; null if none is."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for v, w in zip(values, weights):
        top = top + F.when(v.isNotNull(), v * w).otherwise(0.0)
        bottom = bottom + F.when(v.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def snake_slot(pick: Column, teams: int) -> Column:
    """The slot on the clock at ``pick`` (from 1) of a draft that turns round after each round."""
    within = F.pmod(pick - 1, F.lit(teams)) + 1
    odd = F.pmod(F.floor((pick - 1) / teams), F.lit(2)) == 0
    return F.when(odd, within).otherwise(teams + 1 - within).cast("int")


def next_pick(after: Column, slot: Column, teams: int, rounds: int) -> Column:
    """The next pick of ``slot`` later than ``after``; null when the draft is over."""
    first = F.floor(F.greatest(after, F.lit(0)) / teams).cast("int")

    def at(r: Column) -> Column:
        return r * teams + F.when(F.pmod(r, F.lit(2)) == 0, slot).otherwise(teams + 1 - slot)

    later = F.filter(F.transform(F.array(first, first + 1, first + 2), lambda r: F.when(r < rounds, at(r))), lambda p: p > after)
    return F.array_min(later).cast("int")


def ladder(x: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """The value of the first step whose bound is at least ``x``."""
    out = None
    for bound, value in steps:
        out = F.when(x <= bound, F.lit(value)) if out is None else out.when(x <= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def interpolate(x: Column, curve: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the points of ``curve``, flat beyond its ends."""
    out = F.when(x <= curve[0][0], F.lit(curve[0][1]))
    for (a, va), (b, vb) in zip(curve, curve[1:]):
        out = out.when(x <= b, va + (vb - va) * (x - a) / (b - a))
    return out.otherwise(F.lit(curve[-1][1]))


def normal_cdf_erf(z: Column) -> Column:
    """Normal distribution function through the Abramowitz-Stegun 7.1.26 error function."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + x * 0.3275911)
    # fixed values: coefficients of formula 7.1.26
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z < 0, -1.0).otherwise(1.0) * erf)


def normal_cdf_tail(z: Column) -> Column:
    """Normal distribution function by Abramowitz-Stegun 26.2.17, 0 and 1 beyond eight deviations."""
    x = F.abs(z)
    t = 1.0 / (1.0 + x * 0.2316419)
    # fixed values: coefficients of formula 26.2.17
    poly = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < -8, 0.0).when(z > 8, 1.0).when(z >= 0, 1.0 - upper).otherwise(upper)


def wilson_lower(hits: Column, n: Column, z: float) -> Column:
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mul32(a: Column, b: int | Column) -> Column:
    """Product modulo 2**32 of unsigned words held as longs, without leaving the range of a long."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    low = a.bitwiseAND(F.lit(65535).cast("long")) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535).cast("long")) * 65536
    return (low + high).bitwiseAND(F.lit(MASK).cast("long"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII string."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: mul32(h.bitwiseXOR(F.ascii(c).cast("long")), 16777619))


def fnv1a_of(text: str) -> int:
    """32-bit FNV-1a of a string known when the plan is made."""
    h = 2166136261
    for byte in text.encode():
        h = ((h ^ byte) * 16777619) & MASK
    return h


def let(x: Column, f) -> Column:  # noqa: ANN001
    """``f`` of ``x`` with ``x`` evaluated once: a chain of steps that each use their input twice stays linear in size."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _xorshift(h: Column, n: int) -> Column:
    return h.bitwiseXOR(F.shiftright(h, n))


def keyed_base(seed: int, scenario: Column, parts: list[Column]) -> Column:
    """A 32-bit state addressed by what a draw means (seed, scenario, hashed parts), not by when it is made."""
    h = let((scenario + 1).cast("long"), lambda x: mul32(x, 0x9E3779B1).bitwiseXOR(F.lit(seed & MASK).cast("long")))
    for part in parts:
        h = mix(h, part)
    return h


def mix(h: Column, part_hash: Column) -> Column:
    return let(h.bitwiseXOR(part_hash), lambda x: let(_xorshift(x, 16), lambda y: mul32(y, 0x85EBCA6B)))


def finish(h: Column) -> Column:
    """A uniform number in (0, 1) of a keyed state."""
    a = let(h, lambda x: let(_xorshift(x, 16), lambda y: mul32(y, 0x7FEB352D)))
    b = let(a, lambda x: let(_xorshift(x, 15), lambda y: mul32(y, 0x846CA68B)))
    return (let(b, lambda x: _xorshift(x, 16)) + 0.5) / 4294967296.0


def box_muller(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2.0 * F.log(F.greatest(F.lit(1e-12), u1))) * F.cos(2 * math.pi * u2)


def two_piece_shock(z: Column, mean: Column, floor: Column, ceiling: Column) -> Column:
    """A normal shock with different spread below and above the mean, centred so that it expects nothing."""
    down = F.greatest(F.lit(1.0), mean - floor) / 1.5
    up = F.greatest(F.lit(1.0), ceiling - mean) / 1.5
    return F.when(z >= 0, z * up).otherwise(z * down) - (up - down) / math.sqrt(2 * math.pi)


def grade(score: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    out = F.when(score >= steps[0][0], F.lit(steps[0][1]))
    for bound, name in steps[1:]:
        out = out.when(score >= bound, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def _accented() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(n), unicodedata.normalize("NFKD", chr(n))) for block in ((0xC0, 0x250), (0x1E00, 0x1F00)) for n in range(*block)]
    kept = [(a, "".join(ch for ch in b if ch.isascii())) for a, b in pairs if a != b]
    kept = [(a, b) for a, b in kept if len(b) == 1]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def fold(text: Column) -> Column:
    """Accents off: decomposed marks are dropped, Latin letters with marks become their base letters."""
    return F.regexp_replace(F.translate(text, *_accented()), r"[\x{300}-\x{36f}]", "")


def ascii_key(name: Column) -> Column:
    """Letters and digits of a name, lower case, without accents and generation suffixes."""
    bare = F.regexp_replace(F.lower(fold(name)), r"\s+(jr|sr|ii|iii|iv|v)\.?$", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def unicode_key(name: Column) -> Column:
    """Letters and digits of any script, lower case: accents and other alphabets stay."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]", "")
