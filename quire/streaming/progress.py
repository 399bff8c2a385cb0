"""Progress of jobs as a stream: snapshots in, changes of stage out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.jobs import stage

SNAPSHOT = "job_id string, seq long, has_lines boolean, has_paragraphs boolean, n_articles int, n_results int"


def changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A batch may hold several snapshots of a job, in any order; across batches they come in order."""
    rows = pd.concat(list(frames)).sort_values("seq")
    last = state.get[0] if state.exists else "starting"
    out = []
    for seq, now in zip(rows["seq"], rows["stage"]):
        if now != last:
            out.append((key[0], seq, now))
            last = now
    state.update((last,))
    yield pd.DataFrame(out, columns=["job_id", "seq", "stage"])


def stage_stream(snapshots: DataFrame) -> DataFrame:
    """A streaming DataFrame of snapshots to one row for each change of a job's stage."""
    rows = snapshots.withColumn("stage", stage()).select("job_id", "seq", "stage")
    return rows.groupBy("job_id").applyInPandasWithState(changes, "job_id string, seq long, stage string", "stage string", "append", GroupStateTimeout.NoTimeout)


def glossary_stream(terms: DataFrame, write_batch):
    """New terms as a stream into a first-in-wins store: write_batch(batch, id) adds a micro-batch, exactly as quire.operators.glossary.add_terms."""
    return terms.writeStream.foreachBatch(write_batch)
