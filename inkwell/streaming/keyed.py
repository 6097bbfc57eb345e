"""Page changes by keyed state: every key's last state lives in the state store, is updated in place and expires.

The whole state is never read or rewritten for a batch; a batch touches the keys that it has rows of,
and those that have expired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.streaming import freshness

#: A key not polled for so long is forgotten; its next page is a BASELINE again.
KEEP_MS = 400 * 24 * 3600 * 1000
STATUS = "key string, ts long, status string"


def page_states(keep_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Status of each page against the key's state before it.

    Rows of a batch are taken in their order, equally late ones in that of their signatures. A row that
    is older than the state is LATE and changes nothing: the latest poll wins. A row without signature
    is an ERROR and changes nothing either.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pages = pd.concat(list(rows)).sort_values(["ts", "signature"], kind="stable")
        now = state.getCurrentProcessingTimeMs()
        known = state.get if state.exists else None
        if known is not None and now - known[2] > keep_ms:  # expired, but new rows came first
            known = None
        made = []
        for ts, signature in zip(pages["ts"].tolist(), pages["signature"].tolist(), strict=True):
            if signature is None:
                made.append("ERROR")
            elif known is not None and ts < known[0]:
                made.append("LATE")
            else:
                made.append("BASELINE" if known is None else "OK" if known[1] == signature else "STALE")
                known = (ts, signature, now)
        if known is not None:
            state.update(known)
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"key": [key[0]] * len(pages), "ts": pages["ts"].tolist(), "status": made})

    return update


def keyed_changes(pages: DataFrame, key: str = "key", order: str = "ts", keep_ms: int = KEEP_MS) -> DataFrame:
    """Stream of (key, ts, status) of a stream of pages (key, ts, html). Pages that can't be read have no signature."""
    parsed = freshness.parse(pages, key, order).selectExpr(f"cast({key} as string) as key", f"cast({order} as long) as ts", "case when not degraded then signature end as signature")
    return parsed.groupBy("key").applyInPandasWithState(page_states(keep_ms), STATUS, "ts long, signature string, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Without this setting a query with timeouts that is to end with what is there would run empty batches for ever.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_keyed(pages: DataFrame, out_path: str, checkpoint: str, **options: object):
    """Starts keyed_changes() over what is there and appends its rows to out_path, exactly once.

    Keys expire in batches with rows. A query that runs on should be started with a trigger of its own
    over keyed_changes(), so that they expire in empty batches too.
    """
    conf = pages.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, "false")  # a query keeps the settings it was started with
    try:
        return keyed_changes(pages, **options).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(EMPTY_BATCHES, before)
