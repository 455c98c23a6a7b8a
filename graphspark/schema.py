"""Row types and kinds of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("package", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Groups of node and edge kinds.
SYMBOL_KINDS = ("type", "struct", "interface", "function", "method", "variable", "module", "class")
CONTAINER_KINDS = ("file", "package", "module")
IMPACT_KINDS = ("calls", "references", "implements", "inherits", "uses_type", "imports", "depends_on")
STRONG_KINDS = ("calls", "imports", "depends_on", "implements", "references")
