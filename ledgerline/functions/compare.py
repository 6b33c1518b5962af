"""Column expressions for value comparison: one comparison form per column pair."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType,
                               MapType, ShortType, StringType, StructField, StructType)

_NESTED = (ArrayType, MapType, StructType)
# Timestamps inside JSON keep their microseconds.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def same_type(a: DataType, b: DataType) -> bool:
    return a.simpleString() == b.simpleString()


# Digits of the exact number types; decimals up to 15 digits and integers up to 32
# bits are different doubles if they differ.
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}
DOUBLE_DIGITS, DECIMAL_DIGITS = 15, 38


def _exact(dtype: DataType) -> tuple[int, int] | None:
    """(digits, of which after the point) of an exact number type."""
    if isinstance(dtype, DecimalType):
        return dtype.precision, dtype.scale
    return (_DIGITS[type(dtype)], 0) if type(dtype) in _DIGITS else None


def number_form(a: DataType, b: DataType) -> StructType | None:
    """What two number types are compared in that no one number type holds without loss.

    * A long decimal or bigint against a double: the nearest double, and the exact
      number where it is not that double's value (neither in full nor as printed).
    * Two exact types that need more than 38 digits together: the parts before and
      after the point.
    """
    exact = [x for x in map(_exact, (a, b)) if x]
    if len(exact) == 2:
        (p, s), (q, t) = exact
        if max(p - s, q - t) + max(s, t) <= DECIMAL_DIGITS:
            return None
        return StructType([StructField("floor", DecimalType(DECIMAL_DIGITS, 0)),
                           StructField("rest", DecimalType(DECIMAL_DIGITS, DECIMAL_DIGITS))])
    if len(exact) == 1 and any(isinstance(x, (FloatType, DoubleType)) for x in (a, b)) and exact[0][0] > DOUBLE_DIGITS:
        return StructType([StructField("near", DoubleType()),
                           StructField("unlike", DecimalType(DECIMAL_DIGITS, exact[0][1]))])
    return None


def in_number_form(c: Column, dtype: DataType, form: StructType) -> Column:
    """A number in the form :func:`number_form` names: equal numbers, equal forms."""
    first, second = form.fields
    if first.name == "floor":
        number = c.cast(DecimalType(*_exact(dtype)))
        parts = F.floor(number).cast(first.dataType), (number % F.lit(1).cast("decimal(1,0)")).cast(second.dataType)
    elif _exact(dtype) is None:
        parts = c.cast("double") + F.lit(0.0), F.lit(None).cast(second.dataType)
    else:
        near = c.cast("double")
        as_printed = near.try_cast(second.dataType)
        # 2^63, no bigint itself, would become the largest one.
        in_full = F.when(near < float(1 << 63), near.try_cast("bigint").cast("decimal(19,0)"))
        same = F.coalesce(as_printed == c, F.lit(False)) | F.coalesce(in_full == c, F.lit(False))
        parts = near + F.lit(0.0), F.when(~same, c.cast(second.dataType))
    return F.when(c.isNotNull(), F.struct(parts[0].alias(first.name), parts[1].alias(second.name)))


def common_type(df: DataFrame, a: DataType, b: DataType) -> DataType | None:
    """The type both values are compared in: the wider of two numbers, or their
    exact form where no type holds both, a timestamp for a date, None (compare as
    text) if there is none or only one of them is a string."""
    if same_type(a, b):
        return a
    if (form := number_form(a, b)) is not None:
        return form
    if isinstance(a, StringType) != isinstance(b, StringType):
        return None
    try:
        both = df.select(F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)))
    except AnalysisException:
        return None
    return both.schema[0].dataType


def has_map(dtype: DataType) -> bool:
    if isinstance(dtype, MapType):
        return True
    if isinstance(dtype, ArrayType):
        return has_map(dtype.elementType)
    return isinstance(dtype, StructType) and any(has_map(f.dataType) for f in dtype.fields)


def comparable(c: Column, dtype: DataType) -> Column:
    """A form of the value that can be grouped and compared: maps become entries
    sorted by key, at any depth; everything else stays typed as it is."""
    if not has_map(dtype):
        return c
    if isinstance(dtype, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            comparable(e["key"], dtype.keyType).alias("k"), comparable(e["value"], dtype.valueType).alias("v")))
        return F.array_sort(entries)
    if isinstance(dtype, ArrayType):
        return F.transform(c, lambda x: comparable(x, dtype.elementType))
    fields = [comparable(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(c.isNotNull(), F.struct(*fields))


def as_text(c: Column, dtype: DataType) -> Column:
    """Display form: nested values as JSON, negative zero as zero."""
    if isinstance(dtype, _NESTED):
        return F.to_json(c, JSON_OPTIONS)
    if isinstance(dtype, StringType):
        return c
    return positive_zero(c, dtype).cast("string")


def as_json(c: Column) -> Column:
    """The value as JSON: null for NULL, numbers bare, text quoted."""
    wrapped = F.to_json(F.struct(c.alias("v")), JSON_OPTIONS)
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def positive_zero(c: Column, dtype: DataType) -> Column:
    return c + F.lit(0.0).cast(dtype) if isinstance(dtype, (FloatType, DoubleType)) else c


def compare_type(common: DataType | None, case_insensitive: bool, null_as_blank: bool) -> DataType | None:
    """The common type when values are compared as they are, None for text."""
    return None if case_insensitive or null_as_blank else common


def compare_value(c: Column, dtype: DataType, common: DataType | None, case_insensitive: bool,
                  null_as_blank: bool) -> Column:
    """The value a column is compared on, the same form wherever it is compared.

    * plain: the value in the common type of both sides (null-safe equality later),
      its text only if there is no common type;
    * case-insensitive: ``upper`` of the common form's text;
    * null-as-blank: ``coalesce(text, '')`` — a cast is needed first, because a
      blank string cannot be coerced to a number or date under ANSI mode.
    """
    if common is not None:
        if isinstance(common, StructType) and not isinstance(dtype, StructType):
            c = in_number_form(c, dtype, common)
        elif not same_type(dtype, common):
            c = c.cast(common)
        dtype = common
    v = comparable(c, dtype)
    if compare_type(common, case_insensitive, null_as_blank) is not None:
        return v
    if isinstance(dtype, _NESTED):
        v = v.cast("string")
    elif not isinstance(dtype, StringType):
        v = positive_zero(v, dtype).cast("string")
    if null_as_blank:
        v = F.coalesce(v, F.lit(""))
    if case_insensitive:
        v = F.upper(v)
    return v


def differs(a: Column, b: Column) -> Column:
    """NOT EQUAL_NULL(a, b): NULL equals NULL, NULL differs from any value."""
    return ~a.eqNullSafe(b)
