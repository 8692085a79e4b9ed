"""What the operators share: stages on the shared folder and the text rules of the contracts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.session import new_folder

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word of the contracts, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to a new folder that all executors share, and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Removes what ``stage`` wrote for ``df``, which nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    ``lower`` does just that for pure ASCII, several times faster than
    ``translate``.
    """
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
