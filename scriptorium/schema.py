"""Types of records; built without a session, so modules can be imported before one."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


REFERENCES = T.ArrayType(struct(key=T.StringType(), raw=T.StringType()))
SECTIONS = T.ArrayType(struct(title=T.StringType(), content=T.StringType()))
VISUALS = T.ArrayType(struct(label=T.StringType(), caption=T.StringType(), path=T.StringType(), placement=T.StringType()))
SPANS = T.ArrayType(struct(lo=T.IntegerType(), hi=T.IntegerType(), text=T.StringType()))
TEXT = T.StringType()
