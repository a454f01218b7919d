"""Result conventions at the edge of a registered query: money (DECIMAL
inside) leaves as DOUBLE rounded to cents (Q1)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import money


def edge(df: DataFrame) -> DataFrame:
    return df.select(*[money(f.name).alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])
