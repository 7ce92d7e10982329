"""String, map and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def parsed(id_: Column) -> Column:
    """kind, key and rest of a composite id; the rest may hold colons."""
    s = F.split(id_, ":", 3)
    return F.struct(F.get(s, F.lit(0)).alias("kind"), F.get(s, F.lit(1)).alias("key"), F.get(s, F.lit(2)).alias("rest"))


def hash_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def alias(name: Column, names: dict[str, str], default: str) -> Column:
    """A name looked up after trimming, lower case and one kind of dash."""
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(known[F.translate(F.lower(F.trim(name)), " -", "__")], F.lit(default))


def named(*choices: Column) -> Column:
    """The first choice that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices])


def short(label: Column, most: int = 28) -> Column:
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, 12), F.lit("…"), F.right(label, F.lit(10)))).otherwise(label)


def listed(items: Column, most: int) -> Column:
    """The first items joined, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def finite_numbers(values: Column, keep_null: tuple[str, ...] = ()) -> Column:
    """Of a map of texts the entries that are finite numbers, as doubles; the named keys may also be null."""
    numbers = F.transform_values(values, lambda k, v: v.try_cast("double"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.map_filter(numbers, lambda k, v: fine(v) | (v.isNull() & k.isin(*keep_null) if keep_null else F.lit(False)))


def id_list(text: Column) -> Column:
    """Sorted distinct ids of a free text, split at white space, commas and semicolons."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"[\s,;]+"), lambda x: x != "")))


def costs(text: Column) -> Column:
    """key=value entries with a finite value of at least one."""
    pairs = F.filter(F.transform(F.split(text, r"[\s,;]+"), lambda x: F.struct(F.get(F.split(x, "="), F.lit(0)).alias("k"), F.get(F.split(x, "="), F.lit(1)).try_cast("double").alias("v"))), lambda p: (p["v"] >= 1) & (p["v"] < float("inf")) & (p["k"] != ""))
    return pairs


def trip_time(dz: Column, reposition: Column, speed: float = 1.0, dwell: float = 3.0) -> Column:
    """Seconds of an elevator trip: reposition, dwell, travel, dwell."""
    return F.abs(reposition) / speed + dwell + F.abs(dz) / speed + dwell
