"""The scalar functions of the query language as column expressions over typed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexloom.functions.dynamic import BOOL, NUM, NUMBER, OTHER, TEXT, WHOLE, Value, dynamic, is_dynamic, let, long_of, only_text, text_of


def is_text(v: Value) -> bool:
    return isinstance(v.type, T.StringType)


def as_text(v: Value) -> Column:
    if is_dynamic(v.type):
        return text_of(v.col)
    if isinstance(v.type, T.StructType | T.ArrayType | T.MapType):
        return F.to_json(v.col)
    if isinstance(v.type, T.DoubleType | T.FloatType):
        return F.regexp_replace(v.col.cast("string"), r"\.0$", "")
    return v.col.cast("string")


def by_type(v: Value, fn: Callable[[Value], Column]) -> Column:
    """fn of a dynamic value, as the text, number or boolean that it is; the value is computed once."""
    return let(
        v.col,
        lambda c: F.when(c["rank"] == TEXT, fn(Value(c["s"], T.StringType())))
        .when((c["rank"] == NUM) & c["whole"], fn(Value(long_of(c), T.LongType())))
        .when(c["rank"] == NUM, fn(Value(c["d"], T.DoubleType())))
        .when(c["rank"] == BOOL, fn(Value(c["d"] == 1, T.BooleanType()))),
    )


def _plain(*values: Value) -> list[Value]:
    """Dynamic values as texts, null if they are none."""
    return [Value(only_text(v.col), T.StringType(), v.kind) if is_dynamic(v.type) else v for v in values]


def coalesce(*values: Value) -> Column:
    return F.coalesce(*[dynamic(v) for v in values]) if len({type(v.type) for v in values} - {T.NullType}) > 1 or any(is_dynamic(v.type) for v in values) else F.coalesce(*[v.col for v in values])


def _text(fn: Callable[..., Column]) -> Callable[..., Column]:
    """fn on texts; null on anything else."""
    return lambda v, *rest: fn(_plain(v)[0].col, *rest) if is_text(_plain(v)[0]) else F.lit(None).cast("string")


def to_integer(v: Value) -> Column:
    if is_dynamic(v.type):
        return by_type(v, to_integer)
    if isinstance(v.type, T.BooleanType):
        return v.col.cast("long")
    if is_text(v):
        return F.when(v.col.rlike(WHOLE), v.col.try_cast("long"))
    return v.col.try_cast("long")


def to_float(v: Value) -> Column:
    if is_dynamic(v.type):
        return by_type(v, to_float)
    return F.when(v.col.rlike(NUMBER), v.col.try_cast("double")) if is_text(v) else v.col.try_cast("double")


def to_boolean(v: Value) -> Column:
    if is_dynamic(v.type):
        return by_type(v, to_boolean)
    if is_text(v):
        return F.when(F.lower(v.col) == "true", True).when(F.lower(v.col) == "false", False)
    return v.col if isinstance(v.type, T.BooleanType) else v.col != 0


def size(v: Value) -> Column:
    if is_dynamic(v.type):
        return let(v.col, lambda c: F.when(c["rank"] == TEXT, F.length(c["s"])).when(c["rank"] == OTHER, F.json_array_length(c["j"])).cast("long"))
    if is_text(v):
        return F.length(v.col).cast("long")
    return F.size(v.col).cast("long") if isinstance(v.type, T.ArrayType | T.MapType) else F.lit(None).cast("long")


def position(v: Value) -> Column:
    """A position: whole numbers, floats from 0 cut, texts of digits; null if it is negative or none of these."""
    n = to_integer(v)
    return F.when(n >= 0, n).cast("int")


def substring(v: Value, start: Value, length: Value | None = None) -> Column:
    v = _plain(v)[0]
    if not is_text(v):
        return F.lit(None).cast("string")
    begin, most = position(start), F.length(v.col)
    n = most if length is None else F.coalesce(position(length), most)
    return F.when(begin.isNotNull() & v.col.isNotNull(), F.substr(v.col, begin + 1, n))


def side(fn: Callable[..., Column]) -> Callable[[Value, Value], Column]:
    return lambda v, n: F.when(position(n).isNotNull(), fn(_plain(v)[0].col, position(n))) if is_text(_plain(v)[0]) else F.lit(None).cast("string")


def replace(v: Value, old: Value, new: Value) -> Column:
    v, old, new = _plain(v, old, new)
    if not (is_text(v) and is_text(old) and is_text(new)):
        return F.lit(None).cast("string")
    between = F.concat(new.col, F.array_join(F.transform(F.split(v.col, ""), lambda c: F.concat(c, new.col)), ""))
    between = F.when(F.length(v.col) == 0, new.col).otherwise(between)
    return F.when(F.length(old.col) == 0, between).otherwise(F.replace(v.col, old.col, new.col))


def split(v: Value, by: Value) -> Column:
    v, by = _plain(v, by)
    if not (is_text(v) and is_text(by)):
        return F.lit(None).cast("array<string>")
    quoted = F.concat(F.lit(r"\Q"), by.col, F.lit(r"\E"))
    return F.when(F.length(by.col) == 0, F.split(v.col, "")).otherwise(F.split(v.col, quoted))


def entity_id(v: Value) -> Column:
    return v.col["id"] if v.kind == "node" else v.col["discriminator"] if v.kind == "edge" else F.lit(None).cast("string")


def keys(v: Value) -> Column:
    if v.kind != "node":
        return F.json_object_keys(v.col["properties"]) if v.kind == "edge" else F.lit(None).cast("array<string>")
    present = [F.when(v.col[c].isNotNull(), F.lit(c)) for c in ("file_path", "start_line", "end_line")]
    return F.concat(F.array(F.lit("name"), F.lit("qualified_name"), F.lit("label")), F.array_compact(F.array(*present)), F.coalesce(F.json_object_keys(v.col["properties"]), F.array().cast("array<string>")))


TRIM = "\\s\\p{Z}\u0085"
SCALARS: dict[str, Callable[..., Column]] = {
    "coalesce": coalesce,
    "tolower": _text(F.lower),
    "toupper": _text(F.upper),
    "tostring": as_text,
    "tointeger": to_integer,
    "tofloat": to_float,
    "toboolean": to_boolean,
    "size": size,
    "length": size,
    "reverse": lambda v: F.reverse(_plain(v)[0].col) if is_text(_plain(v)[0]) or isinstance(v.type, T.ArrayType) else F.lit(None).cast("string"),
    "trim": _text(lambda c: F.regexp_replace(c, f"^[{TRIM}]+|[{TRIM}]+$", "")),
    "ltrim": _text(lambda c: F.regexp_replace(c, f"^[{TRIM}]+", "")),
    "rtrim": _text(lambda c: F.regexp_replace(c, f"[{TRIM}]+$", "")),
    "substring": substring,
    "left": side(lambda c, n: F.left(c, n)),
    "right": side(lambda c, n: F.right(c, n)),
    "replace": replace,
    "split": split,
    "labels": lambda v: F.array(v.col["label"]) if v.kind == "node" else F.expr("cast(array() as array<string>)"),
    "type": lambda v: v.col["kind"] if v.kind == "edge" else F.lit(None).cast("string"),
    "id": entity_id,
    "properties": lambda v: v.col["properties"] if v.kind in ("node", "edge") else F.lit(None).cast("string"),
    "keys": keys,
}
