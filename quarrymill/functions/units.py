"""Supply units and package capacities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import col, normalize_text, present

#: Normalised unit names and their abbreviation.
UNITS = {
    "unidade": "UN", "un": "UN", "peca": "PC", "pecas": "PC", "pc": "PC", "metro": "M", "metros": "M", "m": "M",
    "quilograma": "KG", "kg": "KG", "rolo": "RO", "ro": "RO", "bobina": "BOBINA", "conjunto": "CJ", "caixa": "CX",
    "litro": "L", "galao": "GL",
}


def standard_unit(c: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    # most units need no more than lower case; the keys are normalised already
    plain = F.try_element_at(table, F.lower(F.trim(col(c).cast("string"))))
    return F.coalesce(plain, F.try_element_at(table, normalize_text(c)), F.upper(present(c)))


def capacity_text(c: str | Column) -> Column:
    """Capacity without needless decimals, six at most; null if missing or not positive."""
    value = col(c).cast("double")
    text = F.when((value < 1e15) & (value == F.floor(value)), value.cast("long").cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    )
    return F.when(F.coalesce(value > 0, F.lit(False)), text)


def _with_capacity(unit: Column, capacity: str | Column) -> Column:
    # bound to names by a transform of one element, so that both are evaluated once
    def joined(x: Column) -> Column:
        plain = x["text"].isNull() | (x["text"] == "1")
        return F.when(x["unit"].isNotNull(), F.when(plain, x["unit"]).otherwise(F.concat(x["unit"], F.lit("|CAP="), x["text"])))

    both = F.struct(unit.alias("unit"), capacity_text(capacity).alias("text"))
    return F.get(F.transform(F.array(both), joined), F.lit(0))


def comparable_unit(short: str | Column, name: str | Column, capacity: str | Column) -> Column:
    """Standard unit of the abbreviation, else of the name, with the capacity unless it is one."""
    return _with_capacity(F.coalesce(standard_unit(short), standard_unit(name)), capacity)


def comparable_unit_upper(capacity: str | Column, *units: str | Column) -> Column:
    """First given unit in upper case, without the unit table."""
    return _with_capacity(F.coalesce(*[F.upper(present(u)) for u in units]), capacity)
