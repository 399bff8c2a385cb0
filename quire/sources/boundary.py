"""Requests to models and searches, and their replies, as tables.

requests(kind, key, attempt, payload) go through a Responder in batches; replies(kind, key, attempt, body, tokens_in, tokens_out, error) are
settled in the shared folder before anything reads them, so a lost executor never causes a second call or a different answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import settled_table

REPLIES = "kind string, key string, attempt int, body string, tokens_in long, tokens_out long, error string"
#: Tokens that each kind of call may use, and what happens when it fails.
CALLS = {
    "confirm_headings": (512, "all candidates"), "extract_terms": (512, "no candidates"), "judge_terms": (1024, "unjudged"), "resolve_terms": (1024, "no new terms"),
    "translate": (4096, "failure mark"), "transcribe_formula": (512, "placeholder"), "judge_pairs": (64, "sample skipped"), "baseline": (8192, "error"),
}


class Responder(Protocol):
    """Answers a payload: (body, tokens in, tokens out); raises to fail the attempt. It is pickled to the executors."""

    def __call__(self, kind: str, payload: str, max_tokens: int) -> tuple[str, int, int]: ...


def echo(kind: str, payload: str, max_tokens: int) -> tuple[str, int, int]:
    """A deterministic stand-in: translations come back as the numbered segments themselves, other calls as an empty object."""
    import json
    import re

    if kind == "translate":
        parts = re.findall(r"(?s)\[(\d+)\] (.*?)(?=\n\n\[\d+\] |\Z)", payload)
        return json.dumps({n: text for n, text in parts}, ensure_ascii=False), len(payload) // 4, len(payload) // 4
    return "{}", len(payload) // 4, 1


def answer(requests: DataFrame, responder: Responder = echo, attempts: int = 3) -> DataFrame:
    """Replies, settled. An attempt that fails is kept as a row with its error, and the next one follows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for kind, key, payload in zip(frame["kind"], frame["key"], frame["payload"]):
                for attempt in range(attempts):
                    try:
                        rows.append((kind, key, attempt, *responder(kind, payload, CALLS[kind][0]), None))
                        break
                    except Exception as e:  # noqa: BLE001  a failed call is a row
                        rows.append((kind, key, attempt, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["kind", "key", "attempt", "body", "tokens_in", "tokens_out", "error"])

    return settled_table(requests.select("kind", "key", "payload").mapInPandas(run, REPLIES))


def errors(replies: DataFrame) -> DataFrame:
    """Calls that no attempt answered, with the last error."""
    done = replies.where(F.col("error").isNull()).select("kind", "key").distinct()
    return replies.join(done, ["kind", "key"], "left_anti").groupBy("kind", "key").agg(F.max_by("error", "attempt").alias("error")).withColumn("severity", F.lit("error"))
