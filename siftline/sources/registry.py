"""The log of loaded datasets: one entry per name, the newest few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: entries shown.
RECENT = 8


def latest_loads(entries: DataFrame) -> DataFrame:
    """Newest entry per name of (name, file_size, row_count, column_count, loaded_at).

    One aggregation with map-side combine; ties on time go to the larger entry.
    """
    rest = [c for c in entries.columns if c not in ("name", "loaded_at")]
    newest = F.max(F.struct("loaded_at", *rest)).alias("e")
    return entries.groupBy("name").agg(newest).select("name", "e.*").select(*entries.columns)


def load_registry(entries: DataFrame, limit: int = RECENT) -> DataFrame:
    return latest_loads(entries).orderBy(F.desc("loaded_at"), "name").limit(limit)


def push_load(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """The registry after one more load."""
    return load_registry(registry.unionByName(entry))
