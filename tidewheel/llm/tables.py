"""Reading the corpus tables, and setting a caller's columns aside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Aside:
    """A table whose columns are called ``_in0``, ``_in1``, ... while an operator works, so that none can clash with its own.

    Columns named in ``replaced`` are left out (in any case of letters); ``back`` gives the others their
    names again.  Names may hold dots or any other character.
    """

    def __init__(self, df: DataFrame, replaced: Iterable[str] = ()):
        gone = {r.lower() for r in replaced}
        kept = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
        self.names = [df.columns[i] for i in kept]
        numbered = df.toDF(*[f"_all{i}" for i in range(len(df.columns))])
        self.df = numbered.select(*[F.col(f"_all{i}").alias(f"_in{k}") for k, i in enumerate(kept)])

    def of(self, name: str) -> str:
        """The present name of the caller's column ``name``."""
        return f"_in{self.names.index(name)}"

    def back(self, df: DataFrame, *added: Column | str, without: str | None = None) -> DataFrame:
        """The caller's columns (but for ``without``) with their own names, and those that were added."""
        return df.select(*[F.col(f"_in{k}").alias(n) for k, n in enumerate(self.names) if n != without], *added)
