"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(column: Column, digits: int) -> Column:
    """Round half up on the value times a power of ten; the last digit of the half absorbs float noise, so every engine agrees."""
    scale = float(10**digits)
    return F.floor(column * scale + 0.500000001) / scale


def number(text: Column) -> Column:
    """A payload value as double: numbers and their text, never booleans, else null."""
    return F.when(~F.lower(text).isin("true", "false"), text.try_cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole within 0 and 1; 0 where whole is not positive."""
    return F.when(whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), part.cast("double") / whole))).otherwise(0.0)


def shape_signature(shapes: Column) -> Column:
    """``name:[dims]`` by name, joined by a bar; null for a null map."""
    entry = lambda e: F.concat(e["key"], F.lit(":["), F.array_join(e["value"].cast("array<string>"), ", "), F.lit("]"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(shapes)), entry), "|")


def first_dims(shapes: Column) -> tuple[Column, Column]:
    """Batch size (first dimension of the first shape) and sequence length (second of the first that has two)."""
    values = F.map_values(shapes)
    deep = F.filter(values, lambda v: F.size(v) >= 2)
    return F.get(F.get(values, F.lit(0)), F.lit(0)), F.get(F.get(deep, F.lit(0)), F.lit(1))


def codes(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that hold, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())


def flags(checks: dict[str, Column]) -> Column:
    """A map of each check to 'true' or 'false'; unknown is false."""
    return F.create_map(*[x for name, c in checks.items() for x in (F.lit(name), F.when(c, "true").otherwise("false"))])


def numbers(values: dict[str, Column]) -> Column:
    """A map of names to doubles, without the nulls."""
    return F.map_filter(F.create_map(*[x for name, c in values.items() for x in (F.lit(name), c.cast("double"))]), lambda k, v: v.isNotNull())


def environment(given: Column | None = None) -> dict[str, Column]:
    """Signals of a run's environment, a map of text; without one all are false."""
    known = F.create_map().cast("map<string,string>") if given is None else F.coalesce(given, F.create_map().cast("map<string,string>"))
    true = lambda k: F.lower(known[k]).isin("true", "1")
    return {"framework_pytorch": F.lower(known["framework"]) == "pytorch", "mixed_precision_enabled": true("mixed_precision"), "is_distributed": true("distributed")}


def true_flags(signals: Column) -> Column:
    """The names of the flags that are true, by name."""
    return F.array_sort(F.map_keys(F.map_filter(signals, lambda k, v: v == "true")))
