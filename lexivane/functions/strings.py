"""String helpers as column expressions: join, case, trim, split, affixes, encodings, times, paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings that the JVM's functions take; others go through Python.
JVM_ENCODINGS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def joined(parts: Column, separator: str) -> Column:
    """The strings of an array; nulls are left out."""
    return F.array_join(parts, separator)


def trimmed(text: Column, signs: str | None = None) -> Column:
    """Without white space, or without the given signs, at both ends."""
    if signs is None:
        return F.regexp_replace(text, "^\\s+|\\s+$", "")
    return F.btrim(text, F.lit(signs))


def split_at(text: Column, signs: str, most: int | None = None) -> Column:
    """Cut at any of the signs, into at most ``most`` parts; empty parts stay."""
    pattern = "[" + "".join("\\" + c for c in signs) + "]"
    return F.split(text, pattern, -1 if most is None else most)


def starts(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def ends(text: Column, suffix: str) -> Column:
    return F.endswith(text, F.lit(suffix))


def encoded(text: Column, encoding: str) -> Column:
    """Bytes in an encoding; what it can't write becomes a question mark."""
    if encoding.upper() in JVM_ENCODINGS:
        return F.encode(text, encoding)

    @F.pandas_udf("binary")
    def write(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode(encoding, "replace"))

    return write(text)


def decoded(data: Column, encoding: str) -> Column:
    """Text of bytes; what is no text in the encoding becomes the replacement character."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return read(data)


def formatted(time: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(time, pattern)


def path_joined(left: Column, right: Column) -> Column:
    """Two parts of a path with one slash between; an empty part gives the other."""
    both = F.concat(F.regexp_replace(left, "/+$", ""), F.lit("/"), F.regexp_replace(right, "^/+", ""))
    return F.when(left == "", right).when(right == "", left).otherwise(both)
