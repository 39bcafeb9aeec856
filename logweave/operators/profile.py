"""Column profile (M1): declared type attributes next to measured ones.

One aggregation pass over the table computes, per column, the NULL count and
the widest rendered value; the declared attributes come from the schema.
The one-row aggregate is turned into one row per column with ``inline``,
so there is no join and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JDBC type codes (java.sql.Types) and display attributes of
# the SQL client's result metadata.
BOOLEAN, TINYINT, SMALLINT, INTEGER, BIGINT = 16, -6, 5, 4, -5
REAL, DOUBLE, DECIMAL, CHAR, LONGNVARCHAR = 7, 8, 3, 1, -16
LONGVARBINARY, DATE, TIME, TIMESTAMP, ARRAY, JAVA_OBJECT = -4, 91, 92, 93, 2003, 2000
VARCHAR_MAX = 1024 * 1024 * 1024
TIME_MAX = len("HH:mm:ss.SSS")
TIME_ZONE_MAX = 40
TIMESTAMP_MAX = len("yyyy-MM-dd HH:mm:ss.SSS")
DATE_MAX = len("yyyy-MM-dd")

# engine type name -> (jdbc code, signed, precision, scale, display width, class name)
_ATTRS = {
    "boolean": (BOOLEAN, False, 0, 0, 5, "java.lang.Boolean"),
    "tinyint": (TINYINT, True, 3, 0, 4, "java.lang.Byte"),
    "smallint": (SMALLINT, True, 5, 0, 6, "java.lang.Short"),
    "integer": (INTEGER, True, 10, 0, 11, "java.lang.Integer"),
    "bigint": (BIGINT, True, 19, 0, 20, "java.lang.Long"),
    "real": (REAL, True, 9, 0, 16, "java.lang.Float"),
    "double": (DOUBLE, True, 17, 0, 24, "java.lang.Double"),
    "varchar": (LONGNVARCHAR, True, VARCHAR_MAX, 0, VARCHAR_MAX, "java.lang.String"),
    "char": (CHAR, False, 0, 0, 0, "java.lang.String"),
    "varbinary": (LONGVARBINARY, True, VARCHAR_MAX, 0, VARCHAR_MAX, "byte[]"),
    "date": (DATE, True, 0, 0, DATE_MAX, "java.sql.Date"),
    "time": (TIME, True, 3, 0, TIME_MAX, "java.sql.Time"),
    "timestamp": (TIMESTAMP, True, 3, 0, TIMESTAMP_MAX, "java.sql.Timestamp"),
    "timestamp with time zone": (TIMESTAMP, True, 3, 0, TIMESTAMP_MAX + TIME_ZONE_MAX, "java.sql.Timestamp"),
    "interval year to month": (JAVA_OBJECT, False, 0, 0, TIMESTAMP_MAX, "java.lang.String"),
    "interval day to second": (JAVA_OBJECT, False, 0, 0, TIMESTAMP_MAX, "java.lang.String"),
}


def engine_type(dt: T.DataType) -> str:
    """Type name of the SQL engine for a Spark type."""
    simple = {
        T.BooleanType: "boolean", T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "integer",
        T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double", T.StringType: "varchar",
        T.BinaryType: "varbinary", T.DateType: "date", T.TimestampNTZType: "timestamp",
        T.TimestampType: "timestamp with time zone",
        T.YearMonthIntervalType: "interval year to month", T.DayTimeIntervalType: "interval day to second",
    }
    for cls, name in simple.items():
        if isinstance(dt, cls):
            return name
    if dt.typeName().startswith("time") and not dt.typeName().startswith("timestamp"):
        return "time"
    if isinstance(dt, T.CharType):
        return "char"
    if isinstance(dt, T.VarcharType):
        return "varchar"
    if isinstance(dt, T.DecimalType):
        return f"decimal({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return f"array({engine_type(dt.elementType)})"
    if isinstance(dt, T.MapType):
        return f"map({engine_type(dt.keyType)},{engine_type(dt.valueType)})"
    if isinstance(dt, T.StructType):
        return "row(" + ",".join(f"{f.name} {engine_type(f.dataType)}" for f in dt.fields) + ")"
    return "json" if dt.typeName() == "variant" else dt.simpleString()


def declared(dt: T.DataType) -> tuple[str, int, bool, int, int, int, str]:
    """``(type name, jdbc code, signed, precision, scale, width, class)`` of a Spark type."""
    name = engine_type(dt)
    if isinstance(dt, T.DecimalType):
        return name, DECIMAL, True, dt.precision, dt.scale, dt.precision + 2, "java.math.BigDecimal"
    if isinstance(dt, T.ArrayType):
        return name, ARRAY, False, 0, 0, 0, "java.lang.String"
    code, signed, p, s, w, cls = _ATTRS.get(name, (JAVA_OBJECT, False, 0, 0, 0, "java.lang.String"))
    return name, code, signed, p, s, w, cls


def element_code(dt: T.DataType) -> int | None:
    """JDBC code of an array's elements; None for other types."""
    return declared(dt.elementType)[1] if isinstance(dt, T.ArrayType) else None


def _leaves(path: str, dt: T.DataType, value: Column, repeated: bool):
    """(path, type, values, repeated) of every leaf of a column. ``value`` is
    the value itself, or with ``repeated`` the array of all values that stand
    at that path in a row."""
    if isinstance(dt, T.StructType) and dt.fields:
        for f in dt.fields:
            def field(x: Column, name: str = f.name) -> Column:
                return x[name]
            inner = F.transform(value, lambda x: field(x)) if repeated else field(value)
            yield from _leaves(f"{path}.{f.name}", f.dataType, inner, repeated)
    elif isinstance(dt, T.ArrayType):
        inner = F.flatten(F.filter(value, lambda x: x.isNotNull())) if repeated else value
        yield from _leaves(f"{path}.element", dt.elementType, inner, True)
    elif isinstance(dt, T.MapType):
        for part, kind, of in (("key", dt.keyType, F.map_keys), ("value", dt.valueType, F.map_values)):
            held = F.flatten(F.transform(F.filter(value, lambda x: x.isNotNull()), of)) if repeated else of(value)
            yield from _leaves(f"{path}.{part}", kind, held, True)
    else:
        yield path, dt, value, repeated


def nested_profile(df: DataFrame) -> DataFrame:
    """M1 for nested types: one row per leaf of the columns, in order.

    A leaf is a field of a struct, the elements of an array, the keys or values
    of a map, at any depth, under the path ``column.field``, ``.element``,
    ``.key`` or ``.value``; a flat column is its own leaf. ``value_count`` is
    how many values stand there in all rows, NULLs included (a NULL array or
    map has none, a field of a NULL struct is a NULL), ``null_count`` and
    ``max_width`` are taken over them. One aggregation, as for flat columns.
    """
    leaves = [x for f in df.schema.fields for x in _leaves(f.name.lower(), f.dataType, F.col(f"`{f.name}`"), False)]
    aggs = []
    for i, (_, _, v, repeated) in enumerate(leaves):
        text = lambda x: F.length(x.cast("string"))
        if repeated:
            aggs += [F.sum(F.when(v.isNotNull(), F.size(v)).cast("long")).alias(f"c{i}"),
                     F.sum(F.when(v.isNotNull(), F.size(F.filter(v, lambda x: x.isNull()))).cast("long")).alias(f"n{i}"),
                     F.max(F.array_max(F.transform(v, text))).alias(f"w{i}")]
        else:
            aggs += [F.count(F.lit(1)).alias(f"c{i}"), F.count_if(v.isNull()).alias(f"n{i}"), F.max(text(v)).alias(f"w{i}")]
    rows = []
    for i, (path, dt, _, _) in enumerate(leaves):
        name, code, _, p, s, w, _ = declared(dt)
        rows.append(F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(path).alias("path"), F.lit(name).alias("type_name"), F.lit(code).alias("jdbc_type"),
            F.lit(p).alias("precision"), F.lit(s).alias("scale"), F.lit(w).alias("display_width"),
            F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias("value_count"), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("null_count"),
            F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("bigint").alias("max_width")))
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.withColumn("width_ok", (F.col("display_width") == 0) | (F.col("max_width") <= F.col("display_width")))


def column_profile(df: DataFrame) -> DataFrame:
    """M1: one row per column with declared and measured attributes.

    Declared: the type's name, codes and widths (``element_jdbc_type`` for
    arrays) and ``nullable``, whether the schema allows NULLs.

    Measured: ``null_count`` and ``max_width`` (longest value rendered as
    text). ``width_ok`` says whether the data fits the declared width.
    """
    fields = df.schema.fields
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        aggs.append(F.max(F.length(c.cast("string"))).alias(f"w{i}"))
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        name, code, signed, p, s, w, cls = declared(f.dataType)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("ordinal"), F.lit(f.name.lower()).alias("column_name"), F.lit(name).alias("type_name"),
                F.lit(code).alias("jdbc_type"), F.lit(signed).alias("signed"), F.lit(p).alias("precision"),
                F.lit(s).alias("scale"), F.lit(w).alias("display_width"), F.lit(cls).alias("class_name"),
                F.lit(element_code(f.dataType)).cast("int").alias("element_jdbc_type"), F.lit(f.nullable).alias("nullable"),
                F.col(f"n{i}").alias("null_count"), F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("bigint").alias("max_width"),
            )
        )
    out = one.select(F.inline(F.array(*rows)))
    return out.withColumn("width_ok", (F.col("display_width") == 0) | (F.col("max_width") <= F.col("display_width")))
