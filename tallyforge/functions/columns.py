"""Column expressions of the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact type of stored amounts.
AMOUNT = "decimal(24,4)"


def resolved_segments(path: Column, root: str) -> Column:
    """The path's segments below the root's, . and .. resolved; an absolute path, drive letters included, starts anew."""
    base = [s for s in root.split("/") if s]
    start = F.array(*[F.lit(s) for s in base]) if base else F.expr("cast(array() as array<string>)")
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    absolute = plain.startswith("/") | plain.rlike("^[A-Za-z]:")
    start = F.when(absolute, F.expr("cast(array() as array<string>)")).otherwise(start)

    def step(stack: Column, segment: Column) -> Column:
        return F.when(segment.isin("", "."), stack).when(segment == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(segment)))

    return F.aggregate(F.split(plain, "/"), start, step)


def inside(segments: Column, root: str) -> Column:
    """Whether resolved segments lie in the root, the root itself included."""
    base = [s for s in root.split("/") if s]
    return F.slice(segments, 1, len(base)) == F.array(*[F.lit(s) for s in base]) if base else F.lit(True)


def parsed_amount(value: Column) -> Column:
    return value.try_cast(AMOUNT)


def period_year(period: Column) -> Column:
    return F.regexp_extract(period, r"^(\d{4})(-Q[1-4])?$", 1).try_cast("int")


def period_quarter(period: Column) -> Column:
    return F.regexp_extract(period, r"^\d{4}-Q([1-4])$", 1).try_cast("int")


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b as a double, null where b is zero or missing."""
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)


def wilson(passed: Column, n: Column, upper: bool, z: float = 1.96) -> Column:
    """An end of the Wilson interval of a share, clipped to [0, 1]; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = passed.cast("double") / n, F.lit(z * z)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    centre = p + zz / (2 * n)
    end = (centre + half if upper else centre - half) / (1 + zz / n)
    return F.least(F.greatest(end, F.lit(0.0)), F.lit(1.0))
