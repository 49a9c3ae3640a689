"""Paths, hex forms, number parsing, flat JSON maps and image geometry, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def separators(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative(path: Column, root: Column | str) -> Column:
    """``path`` below ``root``, with forward separators."""
    root = F.regexp_replace(separators(F.lit(root) if isinstance(root, str) else root), "/+$", "")
    whole = separators(path)
    return F.when(whole.startswith(F.concat(root, F.lit("/"))), F.substr(whole, F.char_length(root) + 2)).otherwise(whole)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def stem(path: Column) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def component_order(path: Column) -> Column:
    """Sort key that compares paths by their components (``a/b`` before ``a.txt``); bytewise order is that of the path itself."""
    return F.split(path, "/")


def hex_upper(value: Column) -> Column:
    return F.hex(value)


def hex_padded(value: Column, width: int = 16) -> Column:
    return F.lower(F.lpad(F.hex(value), width, "0"))


def strict_int(text: Column) -> Column:
    """Null unless the whole text is a number."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def bit_width(value: Column) -> Column:
    """Bits that a non-negative number needs, at least 1."""
    return F.greatest(F.lit(1), F.length(F.bin(value)))


def to_json(mapping: Column) -> Column:
    return F.to_json(mapping)


def from_json(text: Column) -> Column:
    return F.from_json(text, MAP)


def zip_entry_kept(name: Column) -> Column:
    return (name != "") & ~name.endswith("/")


def image_side(size: Column, grey: bool = False) -> Column:
    """Width and height of the square that holds ``size`` bytes, one bit or one byte a pixel."""
    return F.ceil(F.sqrt((size if grey else size * 8).cast("double"))).cast("long")


def image_stride(side: Column, grey: bool = False) -> Column:
    return (F.floor((side + 3) / 4) * 4 if grey else F.floor((side + 31) / 32) * 4).cast("long")


def ratio(before: Column, after: Column) -> Column:
    return F.when(after > 0, before / after)


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, (1 - after / before) * 100)


def expansion_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, (after / before - 1) * 100)


def throughput_mib(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / F.lit(1048576.0) / seconds)
