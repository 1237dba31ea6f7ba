"""Tenant scope: every table is read through it, and no tenant means no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class TenantScope:
    tenant_id: str | None

    def predicate(self, column: str = "tenant_id") -> Column:
        return F.lit(False) if self.tenant_id in (None, "") else F.col(column) == F.lit(self.tenant_id)

    def rows(self, df: DataFrame, column: str = "tenant_id") -> DataFrame:
        """The tenant's rows; the predicate stays below any later top-k."""
        return df.where(self.predicate(column))

    def stamped(self, df: DataFrame) -> DataFrame:
        """Rows for an append; whatever tenant they claim is overwritten."""
        if self.tenant_id in (None, ""):
            raise ValueError("an append needs a tenant")
        return df.withColumn("tenant_id", F.lit(self.tenant_id))

    # point and bulk reads of a repository
    def get(self, df: DataFrame, key, by: str = "id") -> DataFrame:
        return self.rows(df).where(F.col(by) == F.lit(key))

    def get_many(self, df: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
        return self.rows(df).join(keys.select(by).distinct(), by, "left_semi")

    def exists(self, df: DataFrame, key, by: str = "id") -> bool:
        return not self.get(df, key, by).isEmpty()

    def without(self, df: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
        """The table after a delete of the tenant's rows with these keys."""
        gone = self.rows(df).join(keys.select(by).distinct(), by, "left_semi").select("tenant_id", by)
        return df.join(gone, ["tenant_id", by], "left_anti")
