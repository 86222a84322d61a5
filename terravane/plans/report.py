"""Report text and chart data from result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_text(metrics: DataFrame, digits: int = 3) -> DataFrame:
    """Metrics with their values as fixed-point text; absent ones read nan."""
    columns = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.withColumns({f"{c}_text": F.format_string(f"%.{digits}f", F.coalesce(c, F.lit(float("nan")))) for c in columns})


def markdown(metrics: DataFrame, importance: DataFrame | None = None, title: str = "Forecast evaluation", facts: Mapping[str, str] | None = None) -> str:
    """A report of one section for each split and model; its tables have a row for each of these."""
    lines = [f"# {title}", ""]
    lines += [f"- {k}: {v}" for k, v in (facts or {}).items()]
    for row in with_text(metrics).orderBy("split", "model").toLocalIterator():
        lines += ["", f"## {row.split}: {row.model}", "", "| metric | value |", "| --- | --- |"]
        lines += [f"| {c} | {row[f'{c}_text']} |" for c in ("accuracy", "precision", "recall", "f1", "roc_auc") if f"{c}_text" in row.asDict()]
    if importance is not None:
        top = importance.orderBy(F.desc("importance"), "feature").limit(1).first()
        if top:
            lines += ["", f"Most important feature: {top.feature} ({top.importance:.3f})"]
    return "\n".join(lines) + "\n"


def nested(metrics: DataFrame) -> DataFrame:
    """All metrics as one JSON document: split -> model -> metrics."""
    values = [c for c in metrics.columns if c not in ("split", "model")]
    models = metrics.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*values)))).alias("m"))
    return models.agg(F.map_from_entries(F.collect_list(F.struct("split", "m"))).alias("d")).select(F.to_json("d", {"pretty": "true"}).alias("document"))
