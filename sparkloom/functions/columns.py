"""Column functions and Arrow UDFs; built-in expressions wherever they can say it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, as a double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def json_number(text: Column, path: str) -> Column:
    """A number in a JSON text; null if it isn't there or isn't one."""
    return F.get_json_object(text, path).try_cast("bigint")


@F.pandas_udf(StringType())
def initials(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Scalar iterator UDF: first characters of the words of each name."""
    for own in names:
        yield own.str.replace(r"(\S)\S*\s*", r"\1", regex=True).str.strip()


@F.udtf(returnType=StructType([StructField("word_no", IntegerType()), StructField("size", LongType())]), useArrow=True)
class WordSizes:
    """Table function, whose rows go to and fro as Arrow batches: position and length of each word of a text."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield i, len(w)
