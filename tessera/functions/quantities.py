"""Quantities and periods in texts, and when two statements are about different times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number with an optional scale; years; markers of the past and of the present.
QUANTITY = r"\b(\d[\d,.]*)\s*(million|billion|thousand|millones|mil millones|%|percent)?\b"
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
PAST = r"\b(at independence|at its founding|at the last census|when it was founded|en la independencia|en su fundaci[oó]n)\b"
PRESENT = r"\b(currently|today|at present|as of now|is now|actualmente|hoy en d[ií]a)\b"
SCALES = {"million": 1e6, "millones": 1e6, "billion": 1e9, "mil millones": 1e9, "thousand": 1e3, "%": 1.0, "percent": 1.0}
#: Bare numbers below this are noise; quantities within this share of the larger one are near; a year before this is past.
LEAST, NEAR, RECENT = 100.0, 0.20, 2020


def quantities(text: Column) -> Column:
    numbers, scales = (F.regexp_extract_all(text, F.lit(f"(?i){QUANTITY}"), F.lit(g)) for g in (1, 2))

    def value(number: Column, scale: Column) -> Column:
        # A number that ends with dots or has several is none.
        base = F.expr("1") * F.when(F.regexp_replace(number, ",", "").rlike(r"^\d+\.?\d*$"), F.regexp_replace(number, ",", "").cast("double"))
        factor = F.lit(None).cast("double")
        for name, times in SCALES.items():
            factor = F.when(F.lower(scale) == name, F.lit(times)).otherwise(factor)
        return F.when(factor.isNotNull(), base * factor).when(base >= LEAST, base)

    return F.filter(F.zip_with(numbers, scales, value), lambda x: x.isNotNull())


def period(text: Column) -> Column:
    """A year, 'past', 'present' or null."""
    year = F.regexp_extract(text, YEAR, 1)
    return F.when(year != "", year).when(text.rlike(f"(?iu){PAST}"), F.lit("past")).when(text.rlike(f"(?iu){PRESENT}"), F.lit("present"))


def different_periods(a: Column, b: Column) -> Column:
    year = lambda p: p.rlike(r"^\d+$")
    old = lambda p: F.when(year(p), p.cast("int") < RECENT).otherwise(False)
    return F.coalesce(
        F.when(a == b, False)
        .when(year(a) & year(b), True)
        .when(a.isin("past", "present") & b.isin("past", "present"), True)
        .when((b == "present") & year(a), old(a))
        .when((a == "present") & year(b), old(b))
        .otherwise(False),
        F.lit(False),
    )


def different_quantities(a: Column, b: Column) -> Column:
    """Both sides have quantities, and none of one is near one of the other."""
    near = F.exists(a, lambda x: F.exists(b, lambda y: (F.greatest(x, y) > 0) & (F.abs(x - y) / F.greatest(x, y) <= NEAR)))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~near


def downgraded(label: Column, claim: Column, evidence: Column) -> Column:
    """refuta becomes no_concluye if both sides tell quantities of provably different periods."""
    differs = different_periods(period(claim), period(evidence)) & different_quantities(quantities(claim), quantities(evidence))
    return F.when((label == "refuta") & differs, F.lit("no_concluye")).otherwise(label)
