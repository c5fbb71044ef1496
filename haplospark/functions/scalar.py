"""Column builders shared by operators; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def log1p_positive(c: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), c))


def binary_entropy(p: Column, base2: bool = False) -> Column:
    log = F.log2 if base2 else F.log
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * log(p) + (1 - p) * log(1 - p)))


def decay(distance: Column, scale: float, kind: str = "exp") -> Column:
    return F.exp(-distance / scale) if kind == "exp" else 1 / (1 + distance / scale)


def lenient_long(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(default))


def lenient_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "t"), F.lit(False))


def parse_allele(c: Column, ref: Column, alt: Column) -> Column:
    """+1 for the alternate, -1 for the reference, 0 for anything else."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin("1", "+1", "alt", "h1") | (x == F.lower(alt)), 1).when(x.isin("0", "-1", "ref", "h2") | (x == F.lower(ref)), -1).otherwise(0)


def gc_fraction(seq: Column) -> Column:
    s = F.upper(seq)
    return F.when(F.length(s) == 0, 0.0).otherwise((F.length(s) - F.length(F.regexp_replace(s, "[GC]", ""))) / F.length(s))


def longest_homopolymer(seq: Column) -> Column:
    runs = F.regexp_extract_all(F.upper(seq), F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def shannon(seq: Column) -> Column:
    """Bits a character of a sequence over A, C, G, T."""
    s = F.upper(seq)
    out = F.lit(0.0)
    for base in "ACGT":
        p = (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))) / F.length(s)
        out = out - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(F.length(s) > 0, out).otherwise(0.0)


def low_complexity(seq: Column, entropy: float = 1.2, run: int = 6) -> Column:
    return (shannon(seq) < entropy) | (longest_homopolymer(seq) >= run)
