"""Memo counters as a stream: the batch operators' state machine, event by event.

Events count in the order in which they arrive (within a batch by time and number): there is no
watermark, so none is left out, however late. What a session tracks is one map entry for each
path, so a batch writes the paths that it touches and no others. A session that ends, compacts, or
whose next event comes after an idle gap, starts anew with an empty map.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memo import IDLE_SECONDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "session_id long, life long, total_reads long, redundant_reads_prevented long, tokens_saved long, compaction_count long, seq long"
_HEAD = "life long, last double, ended boolean, reads long, redundant long, saved long, compactions long"
_FILE = "content_hash long, tokens long, stale boolean"


class _Files:
    """The map of a session for one batch: entries are read when first asked for, and only
    those that changed are written."""

    def __init__(self, state):
        self.state, self.known, self.changed, self.cleared = state, {}, set(), False

    def get(self, path: str) -> list | None:
        if path not in self.known:
            held = None if self.cleared or not self.state.containsKey((path,)) else self.state.getValue((path,))
            self.known[path] = list(held) if held else None
        return self.known[path]

    def put(self, path: str, entry: list) -> None:
        self.known[path] = entry
        self.changed.add(path)

    def clear(self) -> None:
        self.known, self.changed, self.cleared = {}, set(), True

    def save(self) -> None:
        if self.cleared and self.state.exists():
            self.state.clear()
        for path in self.changed:
            self.state.updateValue((path,), tuple(self.known[path]))


class Memo(StatefulProcessor):
    def __init__(self, idle_seconds: int, forget_seconds: int | None):
        self.idle_seconds, self.forget = idle_seconds, forget_seconds and forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", _HEAD, self.forget)
        self.files = handle.getMapState("files", "path string", _FILE, self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        life, last, ended, reads, redundant, saved, compactions = self.head.get() if self.head.exists() else (0, None, False, 0, 0, 0, 0)
        files, seq = _Files(self.files), 0
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for ts, seq, event, path, content_hash, tokens in zip(*(batch[c].tolist() for c in ("ts", "seq", "event", "path", "content_hash", "tokens"))):
            now = ts.timestamp()
            if ended or last is not None and int(now) - int(last) > self.idle_seconds:
                life, ended, reads, redundant, saved, compactions = life + 1, False, 0, 0, 0, 0
                files.clear()
            last = now if last is None else max(last, now)
            if event == "session_end":
                ended = True
                files.clear()
            elif event == "pre_compact":
                compactions += 1
                files.clear()
            elif event == "edit" and isinstance(path, str) and (f := files.get(path)):
                files.put(path, [f[0], f[1], True])
            elif event == "read" and isinstance(path, str):
                observed, value = 0 if pd.isna(tokens) else int(tokens), None if pd.isna(content_hash) else int(content_hash)
                reads += 1
                f = files.get(path)
                if f and not f[2] and f[0] == value:
                    files.put(path, [f[0], observed or f[1], False])
                    redundant, saved = redundant + 1, saved + (observed or f[1])
                else:
                    files.put(path, [value, max(observed, f[1] if f else 0), False])
        files.save()
        self.head.update((life, last, ended, reads, redundant, saved, compactions))
        yield pd.DataFrame([[key[0], life, reads, redundant, saved, compactions, seq]], columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def memo_totals(events: DataFrame, idle_seconds: int = IDLE_SECONDS, forget_seconds: int | None = None) -> DataFrame:
    """Counters of each session's current life after every batch, out of a stream of events
    (session_id, seq, ts, event, path, content_hash, tokens). Output mode update. Sets the
    session's state store to RocksDB, which keyed state of this kind needs.

    With ``forget_seconds`` what was not touched for so long is forgotten, by the clock. Such a
    query runs on without data, so it never ends by itself under availableNow.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    mode = "processingTime" if forget_seconds else "none"
    return events.groupBy("session_id").transformWithStateInPandas(Memo(idle_seconds, forget_seconds), _OUT, "update", mode)
