"""Rules as tables: each gives the rows it objects to; what no error names is accepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"


class Rules:
    """A set of rules over rows with a key."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.rules: list[tuple[str, str, Callable[[DataFrame], DataFrame]]] = []

    def row(self, code: str, broken: Column, severity: str = ERROR) -> Rules:
        """Objects to rows for which ``broken`` holds."""
        self.rules.append((code, severity, lambda df: df.where(F.coalesce(broken, F.lit(False)))))
        return self

    def unique(self, code: str, columns: list[str], severity: str = ERROR) -> Rules:
        """Objects to rows whose columns are those of another row too."""

        def find(df: DataFrame) -> DataFrame:
            many = df.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1").select(*columns)
            return df.join(many, columns, "left_semi")

        self.rules.append((code, severity, find))
        return self

    def refers(self, code: str, column: str, to: DataFrame, target: str, severity: str = ERROR) -> Rules:
        """Objects to rows whose non-null ``column`` is no ``target`` of ``to``."""
        known = to.select(F.col(target).alias(column)).distinct()
        self.rules.append((code, severity, lambda df: df.where(F.col(column).isNotNull()).join(known, column, "left_anti")))
        return self

    def issues(self, df: DataFrame) -> DataFrame:
        """(key, code, severity), distinct."""
        out = None
        for code, severity, find in self.rules:
            one = find(df).select(F.col(self.key), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return df.select(F.col(self.key), F.lit("").alias("code"), F.lit("").alias("severity")).where("false")
        return out.distinct()

    def accepted(self, df: DataFrame) -> DataFrame:
        """Rows without an error; a null key is never accepted."""
        bad = self.issues(df).where(F.col("severity") == ERROR).select(self.key).distinct()
        return df.where(F.col(self.key).isNotNull()).join(bad, self.key, "left_anti")


def staleness(status: Column, reference: Column, checked: Column, days: Column, now: Column) -> Column:
    """ready, pending, stale or invalid of a reference: pending without one, stale if checked more than ``days`` days before ``now``, invalid if never checked."""
    return F.when(F.coalesce(reference, F.lit("")) == "", "pending").when(checked.isNull(), "invalid").when(F.datediff(now, checked) > days, "stale").otherwise(F.coalesce(status, F.lit("ready")))
