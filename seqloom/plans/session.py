"""Embedding interface: open an index, ask for names, expand repeats, align."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.config import Options
from ..operators.index import load_index
from ..operators.repeats import expand


class NotARepeat(ValueError):
    """The name is not that of a repeat of the index."""


class Index:
    """An index that was written by operators.index.write_index."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options(), names: tuple[str, ...] = ("repeats",)):
        self.options = options
        self.tables: dict[str, DataFrame] | None = load_index(spark, path, *names)

    @staticmethod
    def default_options() -> Options:
        return Options()

    def close(self) -> None:
        for df in (self.tables or {}).values():
            df.unpersist()
        self.tables = None

    def _table(self, name: str) -> DataFrame:
        if self.tables is None:
            raise ValueError("the index is closed")
        return self.tables[name]

    def reference_name(self, chrom_id: int) -> str | None:
        """Name of a reference, the last one included; None for other numbers."""
        row = self._table("ref").where(F.col("chrom_id") == chrom_id).select("chrom").first()
        return row.chrom if row else None

    def reference_names(self) -> DataFrame:
        return self._table("ref").select("chrom_id", "chrom").orderBy("chrom_id")

    def repeat_expand(self, rep_id: int, pos: int, length: int) -> DataFrame:
        """(chrom_id, pos, fw) of every copy of a piece of a repeat."""
        repeats = self._table("repeats").where(F.col("rep_id") == rep_id)
        if repeats.isEmpty():
            raise NotARepeat(rep_id)
        hits = repeats.sparkSession.range(1).select(F.lit(rep_id).cast("long").alias("rep_id"), F.lit(pos).cast("long").alias("pos"), F.lit(length).cast("long").alias("len"))
        return expand(hits, repeats).select("chrom_id", "pos", "fw")

    def align(self, reads: DataFrame) -> DataFrame:
        from .align import align, report

        ref, kmers = self._table("ref"), self._table("kmers")
        return report(reads, align(reads, ref, kmers, self.options), ref, self.options)


@udtf(returnType="chrom_id long, pos long, fw boolean")
class RepeatExpand:
    """Table function repeat_expand(length of the repeat, positions, pos, len)."""

    def eval(self, size: int, positions: list, pos: int, length: int):
        if positions is None or pos < 0 or pos + length > size:
            return
        for p in positions:
            yield p["chrom_id"], p["pos"] + pos if p["fw"] else p["pos"] + size - pos - length, p["fw"]


def register(spark: SparkSession) -> None:
    """Makes repeat_expand known to SQL."""
    spark.udtf.register("repeat_expand", RepeatExpand)
