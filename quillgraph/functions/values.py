"""Value semantics of graph queries as Column builders.

They differ from SQL's: equality is null-safe and two-valued, ordering of null or mixed operands is false, truth is
"not null and not false", arithmetic is in doubles, and a malformed operand is an error instead of a null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = frozenset("tinyint smallint int bigint float double".split())


def kind(dtype: str) -> str:
    """The value kind of a Spark type name: number, string, boolean, list, map or other."""
    base = dtype.split("(")[0].split("<")[0]
    if base in NUMERIC or base == "decimal":
        return "number"
    return {"string": "string", "boolean": "boolean", "array": "list", "struct": "map"}.get(base, "other")


def truthy(value: Column, dtype: str = "boolean") -> Column:
    """Null is false, a boolean itself, anything else (0 and '' too) true."""
    return F.coalesce(value, F.lit(False)) if kind(dtype) == "boolean" else value.isNotNull()


def equal(a: Column, b: Column, a_type: str = "string", b_type: str = "string") -> Column:
    """Null equals null only; numbers compare as doubles, other mixed kinds by their printed text."""
    kinds = {kind(a_type), kind(b_type)}
    if kinds == {"number"}:
        # Integers are compared as they are: exact, and a join on them stays an equi-join.
        whole = all(t in ("tinyint", "smallint", "int", "bigint") for t in (a_type, b_type))
        return a.eqNullSafe(b) if whole else a.cast("double").eqNullSafe(b.cast("double"))
    return a.eqNullSafe(b) if len(kinds) == 1 else a.cast("string").eqNullSafe(b.cast("string"))


def not_equal(a: Column, b: Column, a_type: str = "string", b_type: str = "string") -> Column:
    return ~equal(a, b, a_type, b_type)


def compare(a: Column, op: str, b: Column, a_type: str = "double", b_type: str = "double") -> Column:
    """``<``, ``>``, ``<=`` or ``>=`` of two numbers or two strings; null or mixed operands give false."""
    if kind(a_type) != kind(b_type) or kind(a_type) not in ("number", "string"):
        return F.lit(False)
    found = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return F.coalesce(found, F.lit(False))


def both(*values: Column) -> Column:
    """AND of any number of operands, each by its truthiness; never null."""
    total = F.lit(True)
    for v in values:
        total = total & truthy(v)
    return total


def either(*values: Column) -> Column:
    """OR of any number of operands, each by its truthiness; never null."""
    total = F.lit(False)
    for v in values:
        total = total | truthy(v)
    return total


def joined(*lists: Column) -> Column:
    """``+`` of lists: their entries one after the other; a null list counts as an empty one."""
    return F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))


def negate(value: Column, dtype: str = "boolean") -> Column:
    """NOT: true for null."""
    return ~truthy(value, dtype)


def exactly_one(*values: Column) -> Column:
    """XOR of any number of operands: true if exactly one is."""
    total = F.lit(0)
    for v in values:
        total = total + truthy(v).cast("int")
    return total == 1


def _operand(value: Column) -> Column:
    number = value.cast("double")
    return F.when(value.isNull(), F.raise_error(F.lit("arithmetic on null")).cast("double")).otherwise(number)


def arithmetic(a: Column, op: str, b: Column) -> Column:
    """``+ - * / %`` in doubles; a null operand or a division by zero is an error; % truncates to whole numbers."""
    x, y = _operand(a), _operand(b)
    if op == "+":
        return x + y
    if op == "-":
        return x - y
    if op == "*":
        return x * y
    zero = F.raise_error(F.lit("division by zero")).cast("double")
    if op == "/":
        return F.when(y == 0, zero).otherwise(x / y)
    if op == "%":
        whole = y.cast("long")
        return F.when(whole == 0, zero).otherwise((x.cast("long") % whole).cast("double"))
    raise ValueError(f"unsupported operator {op}")


def minus(value: Column) -> Column:
    return arithmetic(F.lit(0), "-", value)


VERTEX_KEY = "^vtx\\.[a-z][a-z0-9]*\\.[^.]+$"


def id_from_key(key: Column) -> Column:
    """The id segment of a vertex key; null for null, an error for anything that is no vertex key."""
    wrong = F.raise_error(F.concat(F.lit("not a vertex key: "), key)).cast("string")
    return F.when(key.isNull(), F.lit(None).cast("string")).when(key.rlike(VERTEX_KEY), F.substring_index(key, ".", -1)).otherwise(wrong)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / larger length in bytes; 1.0 for two empty strings, null if either is null."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def is_absent(value: Column, dtype: str = "string") -> Column:
    """Missing, null, or a string of white space only."""
    return value.isNull() | (F.trim(value) == "") if kind(dtype) == "string" else value.isNull()
