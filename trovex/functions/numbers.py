"""Numbers on columns: formats, bases, units, arithmetic."""

from __future__ import annotations

import ast
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (from, to, factor, offset); a value converts to value * factor + offset.
UNITS: list[tuple[str, str, float, float]] = [
    ("km", "m", 1000.0, 0.0), ("km", "miles", 0.621371, 0.0), ("km", "mi", 0.621371, 0.0), ("m", "km", 1 / 1000.0, 0.0),
    ("m", "ft", 3.28084, 0.0), ("m", "feet", 3.28084, 0.0), ("miles", "km", 1.60934, 0.0), ("mi", "km", 1.60934, 0.0),
    ("ft", "m", 1 / 3.28084, 0.0), ("feet", "m", 1 / 3.28084, 0.0), ("cm", "inch", 1 / 2.54, 0.0), ("cm", "in", 1 / 2.54, 0.0),
    ("inch", "cm", 2.54, 0.0), ("in", "cm", 2.54, 0.0), ("kg", "lb", 2.20462, 0.0), ("kg", "lbs", 2.20462, 0.0),
    ("lb", "kg", 1 / 2.20462, 0.0), ("lbs", "kg", 1 / 2.20462, 0.0), ("g", "oz", 1 / 28.3495, 0.0), ("oz", "g", 28.3495, 0.0),
    ("c", "f", 1.8, 32.0), ("celsius", "fahrenheit", 1.8, 32.0), ("f", "c", 1 / 1.8, -32 / 1.8), ("fahrenheit", "celsius", 1 / 1.8, -32 / 1.8),
    ("c", "k", 1.0, 273.15), ("celsius", "kelvin", 1.0, 273.15), ("k", "c", 1.0, -273.15), ("kelvin", "celsius", 1.0, -273.15),
    ("sqm", "sqft", 10.7639, 0.0), ("sqft", "sqm", 1 / 10.7639, 0.0), ("l", "gal", 0.264172, 0.0), ("liter", "gallon", 0.264172, 0.0),
    ("gal", "l", 3.78541, 0.0), ("gallon", "liter", 3.78541, 0.0), ("ml", "floz", 1 / 29.5735, 0.0), ("floz", "ml", 29.5735, 0.0),
    ("kmh", "mph", 0.621371, 0.0), ("mph", "kmh", 1.60934, 0.0), ("ms", "kmh", 3.6, 0.0), ("kmh", "ms", 1 / 3.6, 0.0),
    ("kb", "mb", 1 / 1024.0, 0.0), ("mb", "kb", 1024.0, 0.0), ("mb", "gb", 1 / 1024.0, 0.0), ("gb", "mb", 1024.0, 0.0),
    ("gb", "tb", 1 / 1024.0, 0.0), ("tb", "gb", 1024.0, 0.0), ("s", "min", 1 / 60.0, 0.0), ("sec", "min", 1 / 60.0, 0.0),
    ("min", "s", 60.0, 0.0), ("min", "sec", 60.0, 0.0), ("min", "h", 1 / 60.0, 0.0), ("min", "hour", 1 / 60.0, 0.0),
    ("h", "min", 60.0, 0.0), ("hour", "min", 60.0, 0.0), ("h", "day", 1 / 24.0, 0.0), ("hour", "day", 1 / 24.0, 0.0),
    ("day", "h", 24.0, 0.0), ("day", "hour", 24.0, 0.0),
]
# What the inline converter makes of one unit: (unit, to, factor, offset).
INLINE: list[tuple[str, str, float, float]] = [
    ("m", "km", 0.001, 0.0), ("m", "cm", 100.0, 0.0), ("m", "mm", 1000.0, 0.0), ("m", "ft", 3.28084, 0.0),
    ("km", "m", 1000.0, 0.0), ("km", "mi", 0.621371, 0.0), ("cm", "m", 0.01, 0.0), ("cm", "mm", 10.0, 0.0), ("cm", "in", 0.393701, 0.0),
    ("mm", "m", 0.001, 0.0), ("mm", "cm", 0.1, 0.0), ("kg", "g", 1000.0, 0.0), ("kg", "lb", 2.20462, 0.0), ("kg", "oz", 35.274, 0.0),
    ("g", "kg", 0.001, 0.0), ("g", "mg", 1000.0, 0.0), ("mg", "g", 0.001, 0.0), ("mg", "kg", 0.000001, 0.0),
    ("lb", "kg", 0.453592, 0.0), ("lb", "g", 453.592, 0.0), ("c", "f", 1.8, 32.0), ("c", "k", 1.0, 273.15),
    ("f", "c", 1 / 1.8, -32 / 1.8), ("f", "k", 1 / 1.8, 273.15 - 32 / 1.8), ("k", "c", 1.0, -273.15), ("k", "f", 1.8, 32 - 273.15 * 1.8),
    ("b", "kb", 2.0**-10, 0.0), ("b", "mb", 2.0**-20, 0.0), ("b", "gb", 2.0**-30, 0.0), ("kb", "b", 1024.0, 0.0), ("kb", "mb", 2.0**-10, 0.0), ("kb", "gb", 2.0**-20, 0.0),
    ("mb", "kb", 1024.0, 0.0), ("mb", "gb", 2.0**-10, 0.0), ("mb", "b", 2.0**20, 0.0), ("gb", "mb", 1024.0, 0.0), ("gb", "tb", 2.0**-10, 0.0), ("gb", "kb", 2.0**20, 0.0),
    ("tb", "gb", 1024.0, 0.0), ("tb", "mb", 2.0**20, 0.0),
]


def printed(x: Column, form: str) -> Column:
    """x as C's printf has it: rounded from the double's exact value, where format_string rounds its shortest decimal form."""

    @F.pandas_udf("string")
    def text(xs: pd.Series) -> pd.Series:
        return pd.Series([form % v for v in xs], dtype=object)

    return F.when(x.isNotNull(), text(x.cast("double")))


def plain_number(x: Column) -> Column:
    """A whole number without decimals, else up to six of them."""
    trimmed = F.regexp_replace(printed(x, "%.6f"), r"0+$", "")
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(F.regexp_replace(trimmed, r"\.$", ""))


def converter_number(x: Column) -> Column:
    """Scientific below 0.001 (zero too) and above a million, else whole, else up to four decimals; the exponent is not padded."""
    science = F.regexp_replace(printed(x, "%.6e"), r"e([+-])0*(\d)", "e$1$2")
    science = F.regexp_replace(science, r"e\+", "e")
    four = F.regexp_replace(F.regexp_replace(printed(x, "%.4f"), r"0+$", ""), r"\.$", "")
    return F.when((F.abs(x) < 0.001) | (F.abs(x) > 1_000_000), science).when(x == F.floor(x), printed(x, "%.0f")).otherwise(four)


def base_value(text: Column) -> Column:
    """The value of a 0x, 0b or 0o literal that fits 63 bits; null otherwise."""
    low = F.lower(text)
    digits = F.regexp_replace(F.substring(low, F.lit(3), F.length(low)), "^0+(?=.)", "")
    hexa, bina, octa = F.rlike(text, F.lit("^0[xX][0-9a-fA-F]+$")), F.rlike(text, F.lit("^0[bB][01]+$")), F.rlike(text, F.lit("^0[oO][0-7]+$"))
    fits = F.when(hexa, (F.length(digits) < 16) | ((F.length(digits) == 16) & (F.substring(digits, 1, 1) < "8"))).when(bina, F.length(digits) < 64).when(octa, F.length(digits) < 22)
    value = F.when(hexa, F.conv(digits, 16, 10)).when(bina, F.conv(digits, 2, 10)).when(octa, F.conv(digits, 8, 10))
    return F.when(fits, value.cast("long"))


def based(value: Column) -> Column:
    """struct(decimal, hexadecimal, binary, octal) of a whole number."""
    return F.struct(
        value.cast("string").alias("decimal"),
        F.concat(F.lit("0x"), F.hex(value)).alias("hexadecimal"),
        F.concat(F.lit("0b"), F.bin(value)).alias("binary"),
        F.concat(F.lit("0o"), F.lower(F.conv(value.cast("string"), 10, 8))).alias("octal"),
    )


def unit_table(spark: SparkSession, rows: list[tuple[str, str, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "from_unit string, to_unit string, factor double, shift double")


def conversions(requests: DataFrame, text: str = "text") -> DataFrame:
    """requests with value, from_unit, to_unit and result, for texts like '10 km to miles'; others are dropped."""
    pattern = r"^(\d+\.?\d*)\s*([a-z]+)\s+to\s+([a-z]+)$"
    parts = [F.regexp_extract(F.lower(text), pattern, i) for i in (1, 2, 3)]
    rows = requests.select("*", parts[0].alias("_value"), parts[1].alias("from_unit"), parts[2].alias("to_unit")).where("_value <> ''")
    rows = rows.withColumn("value", F.col("_value").cast("double")).drop("_value")
    joined = rows.join(F.broadcast(unit_table(requests.sparkSession, UNITS)), ["from_unit", "to_unit"])  # as many rows as UNITS has
    return joined.withColumn("result", F.col("value") * F.col("factor") + F.col("shift")).drop("factor", "shift")


def inline_conversions(requests: DataFrame, text: str = "text") -> DataFrame:
    """A row for each unit that a text like '5km' converts to."""
    pattern = r"^([\d.]+)\s*([a-zA-Z]+)$"
    value = F.regexp_extract(text, pattern, 1)
    rows = requests.select("*", value.alias("_value"), F.lower(F.regexp_extract(text, pattern, 2)).alias("from_unit")).where(F.rlike("_value", F.lit(r"^(\d+\.?\d*|\.\d+)$")))
    joined = rows.withColumn("value", F.col("_value").cast("double")).drop("_value").join(F.broadcast(unit_table(requests.sparkSession, INLINE)), "from_unit")
    return joined.withColumn("result", F.col("value") * F.col("factor") + F.col("shift")).drop("factor", "shift")


def literal_value(expr: str) -> float | None:
    """Plus and minus first, then times and over, each from the left; brackets only around a whole factor.

    So neither a sign nor brackets that hold an operator give a value.
    """

    def factor(x: str) -> float:
        return float(x) if re.fullmatch(r"\d+\.?\d*|\.\d+", x) else math.nan

    def chain(x: str, signs: str, inner) -> float:
        parts = re.split(f"([{re.escape(signs)}])", x)
        total = inner(parts[0])
        for sign, part in zip(parts[1::2], parts[2::2], strict=True):
            v = inner(part)
            if sign == "/" and v == 0:
                return math.nan
            total = total + v if sign == "+" else total - v if sign == "-" else total * v if sign == "*" else total / v
        return total

    value = chain(expr.replace(" ", ""), "+-", lambda x: chain(x, "*/", factor))
    return None if math.isnan(value) else value


OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def exact_value(expr: str) -> float | None:
    """The usual rules, with signs and brackets; null where there is no value, or where it is nested too deep to be read."""

    def value(node: ast.expr) -> float:
        if isinstance(node, ast.Constant):
            return float(node.value)
        inner = [node.left, node.right] if isinstance(node, ast.BinOp) else [node.operand] if isinstance(node, ast.UnaryOp) else []
        return OPERATORS[type(getattr(node, "op", None))](*map(value, inner))

    numbers = re.sub(r"\d+\.?\d*|\.\d+", lambda m: repr(float(m[0])), re.sub(r"\s", " ", expr).strip())
    try:
        return value(ast.parse(numbers, mode="eval").body)
    except (SyntaxError, KeyError, ZeroDivisionError, RecursionError, MemoryError):
        return None


def literal_column(text: Column) -> Column:
    """literal_value by built-in functions: terms between + and -, factors between * and /, each added up from the left."""
    clean = F.replace(text, F.lit(" "), F.lit(""))

    def folded(whole: Column, signs: str, inner, step) -> Column:
        parts = F.transform(F.split(whole, f"[{signs}]"), inner)
        rest = F.arrays_zip(F.slice(parts, F.lit(2), F.size(parts)).alias("v"), F.regexp_extract_all(whole, F.lit(f"([{signs}])"), F.lit(1)).alias("sign"))
        return F.aggregate(rest, F.element_at(parts, 1), step)

    number = lambda x: F.when(F.rlike(x, F.lit(r"^(\d+\.?\d*|\.\d+)$")), x.try_cast("double"))
    times = lambda total, x: F.when(x["sign"] == "*", total * x["v"]).otherwise(F.try_divide(total, x["v"]))
    plus = lambda total, x: F.when(x["sign"] == "+", total + x["v"]).otherwise(total - x["v"])
    value = folded(clean, "+\\-", lambda term: folded(term, "*/", number, times), plus)
    return F.when(F.rlike(text, F.lit(r"^[\d+\-*/().\s]+$")), value)


def calculated(requests: DataFrame, text: str = "text", literal: bool = True) -> DataFrame:
    """requests with a column value (null where a text is no expression): as literal_value, else as exact_value."""
    if literal:
        return requests.withColumn("value", literal_column(F.col(text)))

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: exact_value(x) if x is not None and re.fullmatch(r"[\d+\-*/().\s]+", x) else None).astype("float64")

    return requests.withColumn("value", F.nanvl(value(F.col(text)), F.lit(None).cast("double")))
