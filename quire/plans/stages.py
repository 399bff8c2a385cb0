"""Stages by name: functions DataFrame -> DataFrame that a user of the engine strings together, and may add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quire.operators import noise, reflow, regions, segments
from quire.sources import tables

Stage = Callable[[DataFrame], DataFrame]
STAGES: dict[str, Stage] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    """Register a stage; a name is given once."""

    def keep(f: Stage) -> Stage:
        if name in STAGES:
            raise ValueError(f"stage {name!r} is there already")
        STAGES[name] = f
        return f

    return keep


def run(df: DataFrame, names: list[str]) -> DataFrame:
    """df through the named stages, in order."""
    missing = [n for n in names if n not in STAGES]
    if missing:
        raise KeyError(f"no such stages: {', '.join(missing)}")
    for name in names:
        df = STAGES[name](df)
    return df


stage("lines")(tables.document_lines)
stage("strip_noise")(lambda lines: noise.strip_noise(lines, tables.page_sizes(lines)))
stage("drop_embedded_translation")(noise.drop_embedded_translation)
stage("mask_special_regions")(regions.mask_special_regions)
stage("reflow")(reflow.reflow)
stage("articles")(segments.article_slices)
