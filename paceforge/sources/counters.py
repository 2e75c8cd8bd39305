"""Counts of an import or a calculation, taken while its rows are written: no second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are known once an action over it has ended: ``observation.get``."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counters.items()]), seen


def _each(column: str, names: dict[str, str]) -> dict[str, Column]:
    return {name: F.count_if(F.col(column) == value) for name, value in names.items()}


def file_counters() -> dict[str, Column]:
    """Of files with ``outcome`` (``registry.register``), ``status`` (``tracking.resolve_files``) and ``action`` (``tracking.create_missing``), null where a step did not come to a file."""
    settled = F.coalesce(F.when(F.col("action") == "created", "matched").otherwise(F.col("action")), F.col("status"))
    return {
        "total_files": F.count(F.lit(1)),
        **_each("outcome", {"accepted_files": "accepted", "duplicate_files": "duplicate"}),
        **{f"{s}_files": F.count_if(settled == s) for s in ("matched", "unmatched", "ambiguous")},
        **_each("action", {"activities_created": "created"}),
    }


def detail_counters() -> dict[str, Column]:
    """Of written detail rows with ``kind`` (lap or trackpoint)."""
    return _each("kind", {"laps_written": "lap", "trackpoints_written": "trackpoint"})


def enrichment_counters() -> dict[str, Column]:
    """Of activities with a selected source and ``changed``."""
    return {"activities_enriched": F.count_if("changed"), "activities_unchanged": F.count_if(~F.col("changed"))}


def metric_counters() -> dict[str, Column]:
    """Of metric rows with ``action`` (created or reused), ``zones`` and ``edwards_trimp``."""
    return {
        "activities_processed": F.count(F.lit(1)),
        "activities_with_profile": F.count("zones"),
        "activities_with_heart_rate_load": F.count("edwards_trimp"),
        **_each("action", {"activity_metrics_created": "created", "activity_metrics_reused": "reused"}),
    }


def load_counters() -> dict[str, Column]:
    """Of the rows of ``state.upsert``."""
    return _each("action", {f"daily_loads_{a}": a for a in ("created", "updated", "reused")})
