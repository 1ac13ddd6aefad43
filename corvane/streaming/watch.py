"""A debounced change stream: a snapshot is reported once it has stayed the same for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, event long, digest string, dirty boolean"
STATE = "last string, pending string, since long, events long"


def snapshots(changes: DataFrame) -> DataFrame:
    """(key, path, sha) rows of one poll -> (key, digest): one digest of all that the poll saw."""
    return changes.groupBy("key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha"))), "\n"), 256).alias("digest"))


def debounce(polls: DataFrame, wait_ms: int = 200, clean: str = "") -> DataFrame:
    """A stream of (key, at_ms, digest) -> events: the first digest at once; later ones after `wait_ms` without a change.

    Going back to what was last reported cancels what is pending. State is four values a key; time is that of the rows, and
    a processing-time timeout reports what is still pending when no row comes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending, since, events = state.get if state.exists else (None, None, 0, 0)
        out = []
        if state.hasTimedOut:
            if pending is not None:
                events, last, pending = events + 1, pending, None
                out.append((key[0], events, last, last != clean))
        else:
            rows = pd.concat([*frames]).sort_values("at_ms", kind="stable")
            for at, digest in zip(rows["at_ms"].tolist(), rows["digest"].tolist(), strict=True):
                if pending is not None and at - since >= wait_ms:
                    events, last, pending = events + 1, pending, None
                    out.append((key[0], events, last, last != clean))
                if last is None:
                    events, last = events + 1, digest
                    out.append((key[0], events, last, last != clean))
                elif digest == last:
                    pending = None
                elif digest != pending:
                    pending, since = digest, at
        state.update((last, pending, since, events))
        if pending is not None:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=["key", "event", "digest", "dirty"])

    return polls.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def churn_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """A stream of (ts, path) -> changes a path and window; rows later than the watermark are dropped, finished windows leave the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "path").agg(F.count("*").alias("changes")).select("w.start", "path", "changes")


def warnings_stream(lines: DataFrame) -> DataFrame:
    """Secret warnings of a stream of lines: stateless."""
    from corvane.operators import scan

    return scan.warnings(lines)
