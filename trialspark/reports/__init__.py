"""Named reports over the standard tables.  Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy(df: DataFrame, digits: int = 6, **columns: int) -> DataFrame:
    """Widen integers and round doubles, so that results do not depend on the
    order in which partial sums were added."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), columns.get(f.name, digits))
        out.append(c.alias(f.name))
    return df.select(*out)
