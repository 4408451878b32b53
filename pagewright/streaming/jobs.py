"""The scheduler's state on streams: failures in a row by book and kind, and counts of jobs by time window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def strikes(jobs: DataFrame, limit: int = 3) -> DataFrame:
    """A stream of jobs(seq bigint, book_id string, kind string, ok boolean) -> after each micro-batch the strikes of every
    (book_id, kind) it touched; a success clears them. Within a micro-batch jobs count in order of seq."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        last, good, failed = None, None, np.zeros(0, dtype=np.int64)
        for part in parts:  # in any order; of a part only the failures after the last success so far are held
            seq, ok = part["seq"].to_numpy(dtype=np.int64), part["ok"].to_numpy(dtype=bool)
            last = max([int(seq.max())] + [last] * (last is not None))
            if ok.any():
                good = max([int(seq[ok].max())] + [good] * (good is not None))
            failed = np.concatenate([failed, seq[~ok]])
            failed = failed if good is None else failed[failed > good]
        n = len(failed) + (n if good is None else 0)
        state.update((n,))
        yield pd.DataFrame({"book_id": [key[0]], "kind": [key[1]], "seq": [last], "strikes": [n], "struck_out": [n >= limit]})

    out = "book_id string, kind string, seq bigint, strikes int, struck_out boolean"
    return jobs.groupBy("book_id", "kind").applyInPandasWithState(update, out, "strikes int", "update", GroupStateTimeout.NoTimeout)


def windows(jobs: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of jobs(ts timestamp, kind, ok) -> jobs and failures by event-time window; rows later than `late` are dropped."""
    return jobs.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "kind").agg(F.count("*").alias("jobs"), F.count_if(~F.col("ok")).alias("failures")).select(F.col("w.start").alias("start"), "kind", "jobs", "failures")
