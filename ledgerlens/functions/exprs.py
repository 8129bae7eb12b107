"""Scalar column helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed 24-hour days between two timestamps (not calendar days), floored."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS_PER_DAY))


def contains_mark(text: Column, mark: str) -> Column:
    """Whether ``mark`` occurs anywhere; a missing value counts as no."""
    return F.coalesce(text.cast("string").contains(mark), F.lit(False))


def parsed_number(text: Column) -> Column:
    """Number, or null where the text is not one."""
    return F.trim(text.cast("string")).try_cast("double")


def parsed_timestamp(text: Column) -> Column:
    """Timestamp, or null where the text is not one."""
    return text.try_cast("timestamp")


def recoded(value: Column, mapping: Mapping) -> Column:
    """Value looked up in a small mapping; unmapped values become null."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, value)


def yes_no_flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, also for null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def zero_as_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("double"))


def replaced_patterns(text: Column, rules: Mapping[str, str]) -> Column:
    """Apply regular-expression replacements in order."""
    for pattern, replacement in rules.items():
        text = F.regexp_replace(text, pattern, replacement)
    return text


def normalized_code(text: Column) -> Column:
    """Trimmed, upper-case form of typed input."""
    return F.upper(F.trim(text))


def joined_key(parts: Sequence[Column], separator: str = "_") -> Column:
    """Parts joined by a separator; null if any part is null."""
    return F.when(_all_present(parts), F.concat_ws(separator, *parts))


def _all_present(parts: Sequence[Column]) -> Column:
    present = F.lit(True)
    for p in parts:
        present = present & p.isNotNull()
    return present


# A quoted run in either kind of quotes, with escapes. Quoted runs are matched before the bare constants, so that a
# constant inside a title is left alone.
_QUOTED = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
_MARK = "\u0000"
_CONSTANTS = {"None": "null", "True": "true", "False": "false"}


def literal_records(text: Column) -> Column:
    """Parse a printed list of records, or one record, into ``array<struct<name>>``; null when it cannot be read."""
    for word, replacement in _CONSTANTS.items():
        edited = F.regexp_replace(text, rf"{_QUOTED}|\b{word}\b", f"$1{_MARK}")
        edited = F.regexp_replace(edited, rf"""(['"]){_MARK}""", "$1")
        text = F.when(text.contains(word), F.regexp_replace(edited, _MARK, replacement)).otherwise(text)
    return F.from_json(text, "array<struct<name:string>>")


def joined_names(text: Column, separator: str = ", ") -> Column:
    """The ``name`` fields of a printed list of records (or of one record), joined."""
    return F.array_join(F.transform(literal_records(text), lambda r: r["name"]), separator)


SPOTS = 1 << 30
SPLIT_FACTOR, FOLD_FACTOR, PICK_FACTOR = 2_654_435_761, 2_246_822_519, 3_266_489_917


def key_spot(key: Column, seed: int, factor: int = SPLIT_FACTOR) -> Column:
    """Repeatable number in [0, 1) for a whole-number key, by multiplication modulo 2^30: the same on any engine."""
    whole = F.pmod(key.cast("long"), F.lit(SPOTS).cast("long"))
    return F.pmod(whole * F.lit(factor) + F.lit(seed * 69_069), F.lit(SPOTS).cast("long")) / F.lit(float(SPOTS))
