"""Values of which the type is known only row by row, as in a node's JSON properties.

Such a value is a struct in the order that mixed values sort by: rank of its type, number, rest of the number, text; and
with it whether a number is whole, and its JSON text.  Null is a null struct.  A number is a double and the whole rest
that the double leaves of an integer, so integers of 64 bits and doubles compare without loss.  On the way out of a
query the value becomes a VARIANT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DYN = T.StructType(
    [
        T.StructField("rank", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("r", T.LongType()),
        T.StructField("s", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("j", T.StringType()),
    ]
)
#: Ranks of types in mixed comparisons; a whole number beyond 63 bits ranks last beside what is no number.
BOOL, EDGE, NUM, OTHER, NODE, NULL, TEXT, BIG = 0, 1, 2, 4, 5, 6, 7, 8
NUMERIC = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType, T.DecimalType)
FLOATS = (T.DoubleType, T.FloatType)
WHOLE = r"^[+-]?\d+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_EXACT = "decimal(38,0)"


@dataclass
class Value:
    col: Column
    type: T.DataType
    kind: str = "value"  # or node, edge


def is_dynamic(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == DYN.fieldNames()


def let(c: Column, fn) -> Column:
    """fn of c, which is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def rest(exact: Column, d: Column) -> Column:
    """What a double leaves of a whole number."""
    return (exact - d.try_cast(_EXACT)).cast("long")


def _struct(rank, d, r, s, whole, j) -> Column:
    cast = lambda c, t: (c if isinstance(c, Column) else F.lit(c)).cast(t)
    return F.struct(*[cast(c, f.dataType).alias(f.name) for c, f in zip((rank, d, r, s, whole, j), DYN.fields, strict=True)])


def quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def dynamic(v: Value) -> Column:
    """v as a struct of type DYN, null where it is null."""
    t, c = v.type, v.col
    if is_dynamic(t):
        return c
    if isinstance(t, T.NullType):
        return F.lit(None).cast(DYN)
    if isinstance(t, T.BooleanType):
        made = _struct(BOOL, c.cast("int").cast("double"), 0, None, None, c.cast("string"))
    elif isinstance(t, FLOATS):
        made = _struct(NUM, c, 0, None, False, c.cast("string"))
    elif isinstance(t, NUMERIC):
        d = c.cast("double")
        made = _struct(NUM, d, rest(c.cast(_EXACT), d), None, True, c.cast("string"))
    elif isinstance(t, T.StringType):
        made = _struct(TEXT, None, None, c, None, quoted(c))
    else:
        rank = {"node": NODE, "edge": EDGE}.get(v.kind, OTHER)
        made = _struct(rank, None, None, F.to_json(c), None, F.to_json(c))
    return F.when(c.isNotNull(), made)


def json_value(text: Column, path: list[str]) -> Value:
    """The value at a path in a JSON text; null where there is none, or JSON's null."""
    at = "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path)
    return Value(let(F.try_variant_get(F.try_parse_json(text), at, "variant"), _of_variant), DYN)


def _of_variant(v: Column) -> Column:
    def typed(k: Column) -> Column:
        kind, plain, d = k["kind"], F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        whole = (kind == "BIGINT") | (kind.startswith("DECIMAL") & kind.endswith(",0)"))
        made = (
            F.when(kind == "BOOLEAN", _struct(BOOL, F.try_variant_get(v, "$", "boolean").cast("int").cast("double"), 0, None, None, plain))
            .when(number, _struct(NUM, d, F.when(whole, rest(F.try_variant_get(v, "$", _EXACT), d)).otherwise(0), None, whole, plain))
            .when(kind == "STRING", _struct(TEXT, None, None, plain, None, F.to_json(v)))
            .otherwise(_struct(OTHER, None, None, F.to_json(v), None, F.to_json(v)))
        )
        return F.when(v.isNotNull() & (kind != "VOID"), made)

    return let(F.struct(F.schema_of_variant(v).alias("kind")), typed)


def text_of(c: Column) -> Column:
    """A dynamic value as plain text."""
    return let(c, lambda x: F.when(x["rank"] == TEXT, x["s"]).otherwise(F.regexp_replace(x["j"], r"^(-?\d+)\.0$", "$1")))


def only_text(c: Column) -> Column:
    return let(c, lambda x: F.when(x["rank"] == TEXT, x["s"]))


def long_of(c: Column) -> Column:
    """A dynamic number cut to a whole one; null if it is none."""
    whole = (c["d"].try_cast(_EXACT) + c["r"]).try_cast("long")
    return F.when(c["rank"] == NUM, F.when(c["d"] == F.rint(c["d"]), whole).otherwise(c["d"].try_cast("long")))


def number_in(s: Column) -> Column:
    """The number that a text is, as (d, r); null if it is none."""
    d = F.when(s.rlike(NUMBER), s.try_cast("double"))
    exact = F.when(s.rlike(WHOLE), s.try_cast(_EXACT))
    fits = exact.between(F.lit("-9223372036854775808").cast(_EXACT), F.lit("18446744073709551615").cast(_EXACT))
    return F.when(s.rlike(WHOLE), F.when(fits, F.struct(d.alias("d"), rest(exact, d).alias("r")))).when(d.isNotNull(), F.struct(d.alias("d"), F.lit(0).cast("long").alias("r")))


def compare_dynamic(calc, left: Column, right: Column) -> Column:
    """calc of two dynamic values: as numbers if one is a number and the other one or a text that is one; as texts or
    booleans; else by the ranks of their types."""
    n = lambda c: F.struct(c["d"].alias("d"), c["r"].alias("r"))
    num = lambda c: c["rank"] == NUM

    def decide(p: Column) -> Column:
        a, b = p["a"], p["b"]
        x = F.when(num(a), n(a)).when(num(b) & (a["rank"] == TEXT), number_in(a["s"]))
        y = F.when(num(b), n(b)).when(num(a) & (b["rank"] == TEXT), number_in(b["s"]))
        big = lambda c: F.when(num(c) & c["whole"] & (c["d"] >= 2.0**63), F.lit(BIG)).otherwise(c["rank"])
        plain = lambda c: F.struct(F.coalesce(c["d"], F.lit(0.0)).alias("d"), F.coalesce(c["s"], F.lit("")).alias("s"))
        out = F.when((num(a) | num(b)) & x.isNotNull() & y.isNotNull(), calc(x, y)).when(a["rank"] == b["rank"], calc(plain(a), plain(b))).otherwise(calc(big(a), big(b)))
        return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), out), F.lit(False))

    return let(F.struct(left.alias("a"), right.alias("b")), decide)


def sort_keys(c: Column, descending: bool) -> list[Column]:
    """Order of dynamic values: by rank, null between others and texts, then by value."""
    parts = [F.coalesce(c["rank"], F.lit(NULL)), c["d"], c["r"], c["s"]]
    return [p.desc() if descending else p.asc() for p in parts]


def total(c: Column) -> Column:
    """SUM of dynamic numbers: whole and exact if all are, else a double; 0 of none; an error for what is no number."""
    bad = F.raise_error(F.concat(F.lit("SUM of what is no number: "), c["j"]))
    checked = F.when(c.isNull() | (c["rank"] == NUM), c["d"]).otherwise(bad.cast("double"))
    exact = F.sum(F.when(c["whole"], c["d"].cast(_EXACT) + c["r"]))
    whole = F.coalesce(F.min(c["whole"]), F.lit(True))
    as_long = dynamic(Value(F.coalesce(exact, F.lit(0).cast(_EXACT)).cast("long"), T.LongType()))
    return F.when(whole & (F.count(checked) >= 0), as_long).otherwise(dynamic(Value(F.sum(checked), T.DoubleType())))


def _variant(c: Column) -> Column:
    return let(c, lambda x: F.when((x["rank"] == NUM) & ~x["whole"], x["d"].cast("variant")).otherwise(F.parse_json(x["j"])))


def to_variants(df: DataFrame) -> DataFrame:
    """df with its dynamic values, also those in arrays, as VARIANT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_dynamic(f.dataType):
            c = _variant(c)
        elif isinstance(f.dataType, T.ArrayType) and is_dynamic(f.dataType.elementType):
            c = F.transform(c, _variant)
        out.append(c.alias(f.name))
    return df.select(*out)
