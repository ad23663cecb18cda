"""Fields of the lines of an observation group, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(line, pattern, group)
    return F.when(found != "", found.cast("long"))


def group_number(line: Column) -> Column:
    return _number(line, r"#ObservationGroup_(\d+)>")


def machine_number(line: Column) -> Column:
    return _number(line, r"#Machine_(\d+)>").cast("int")


def logical_time(line: Column) -> Column:
    return _number(line, r"#Timestamp_(\d+)>")


def observation_number(line: Column) -> Column:
    return _number(line, r"#(?:Observation|Output|Value)_(\d+)>")


def sensor_number(line: Column) -> Column:
    return _number(line, r"#_(\d+)_(\d+)>", 2).cast("int")


def sensor_machine(line: Column) -> Column:
    return _number(line, r"#_(\d+)_(\d+)>").cast("int")


def literal(line: Column) -> Column:
    return F.regexp_extract(line, r'"([^"]*)"', 1)


def number_or_nan(line: Column) -> Column:
    """The literal as a double; NaN where it is none."""
    return F.coalesce(literal(line).try_cast("double"), F.lit(float("nan")))


def event_millis(line: Column) -> Column:
    """Epoch milliseconds of a line's dateTime literal, its offset observed."""
    return millis(literal(line))


def millis(text: Column) -> Column:
    return F.unix_millis(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX"))


def machine_type(line: Column) -> Column:
    """MOLDING or ASSEMBLY by the class in the line, null for another."""
    return F.when(line.contains("#Molding"), "MOLDING").when(line.contains("#Assembly"), "ASSEMBLY")


#: Spark's hash folds its arguments one after the other, from 42 on; this number's fold is 0, so what comes behind it is hashed from 0 on.
_FROM_ZERO = -1693959553


def key_hash(machine: Column, sensor: Column) -> Column:
    """The 32-bit hash of a key of two whole numbers: 31 times the first plus the second, wrapped."""
    wide = F.lit(31).cast("long") * machine.cast("long") + sensor.cast("long")
    return (F.pmod(wide + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("int")


def key_group(hashed: Column, groups: int) -> Column:
    """The group, from 0 to ``groups`` - 1, of a key by its hash: murmur3 of the hash from seed 0, its absolute value modulo ``groups``."""
    mixed = F.hash(F.lit(_FROM_ZERO), hashed).cast("long")
    return F.when(mixed == -(1 << 31), 0).otherwise(F.abs(mixed) % groups).cast("int")


def operator_of(group: Column, parallelism: int, groups: int) -> Column:
    """The parallel task that a key group belongs to: ranges of groups, as equal as can be."""
    return F.floor(group.cast("long") * parallelism / groups).cast("int")
