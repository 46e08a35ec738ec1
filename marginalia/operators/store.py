"""Replay of a bounded artifact store: which accesses hit when least recently used records go first."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 256 * 1024 * 1024


def weight(byte_length: Column, line_count: Column) -> Column:
    return 2 * byte_length + 160 * line_count + 32768


class Store:
    """Weighted LRU; the record just put always stays."""

    def __init__(self, most: int = MAX_BYTES) -> None:
        if isinstance(most, bool) or not isinstance(most, int) or most <= 0:
            raise ValueError("maxEstimatedBytes must be a positive safe integer")
        self.most, self.total, self.held = most, 0, OrderedDict()

    def get(self, key: str) -> bool:
        if key in self.held:
            self.held.move_to_end(key)
            return True
        return False

    def put(self, key: str, size: int) -> int:
        """Number of records that had to go."""
        self.total += size - self.held.pop(key, 0)
        self.held[key] = size
        gone = 0
        while self.total > self.most and len(self.held) > 1:
            self.total -= self.held.popitem(last=False)[1]
            gone += 1
        return gone


def replay(log: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """``session, seq, op, artifact_id, hit, evicted, total`` of ``session, seq, op, artifact_id, weight``.

    A store lives in one process, so a session is the unit of work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store, rows = Store(most), []
        for r in pdf.sort_values("seq").itertuples():
            hit, gone = store.get(r.artifact_id), 0
            if r.op == "put":
                gone = store.put(r.artifact_id, int(r.weight))
            rows.append((r.session, r.seq, r.op, r.artifact_id, hit, gone, store.total))
        return pd.DataFrame(rows, columns=["session", "seq", "op", "artifact_id", "hit", "evicted", "total"])

    kind = log.schema["session"].dataType.simpleString()
    return log.groupBy("session").applyInPandas(run, f"session {kind}, seq long, op string, artifact_id string, hit boolean, evicted long, total long")
