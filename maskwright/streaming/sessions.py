"""Sessions that last: a value's placeholder is the same in every micro-batch, and numbers go on where the last batch ended.

State by session: a map from a value (as its HMAC, if a key is given: state then holds no raw value of values that are only encoded) to its token, as a list where nothing has a time to
live, and a map from a category to its last number. Both live for time_to_live after they were last used or, without one, until the session is reset.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What comes in: what order says within a session is the order of sightings; a row with reset starts the session anew, before rows of a later order.
SIGHTINGS = "session string, order long, original string, category string, blocked boolean, reset boolean"
TOKENS = "session string, order long, original string, category string, token string, fresh boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Numbering:
    """The rule itself, over any two maps: the first sighting fixes category and suffix, and empty values and categories are left out."""

    def __init__(self, tokens, counts) -> None:
        self.tokens, self.counts = tokens, counts

    def see(self, name: str, category: str, blocked: bool) -> tuple[str, bool]:
        known = self.tokens.get(name)
        if known is not None:
            return known, False
        n = (self.counts.get(category) or 0) + 1
        self.counts.put(category, n)
        token = f"{category}_{n}" + ("_BLOCKED" if blocked else "")
        self.tokens.put(name, token)
        return token, True


class _Held:
    """A map state, with what this batch has read or written of it; it is written back at the end."""

    def __init__(self, state) -> None:
        self.state, self.cache, self.new = state, {}, {}

    def get(self, name: str):
        if name not in self.cache:
            found = self.state.getValue((name,))
            self.cache[name] = found[0] if found is not None else None
        return self.cache[name]

    def put(self, name: str, value) -> None:
        self.cache[name] = self.new[name] = value

    def clear(self) -> None:
        self.state.clear()
        self.cache, self.new = {}, {}

    def flush(self, used: bool) -> None:
        """used: also writes what was only read, so that its time to live starts again."""
        for name, value in (self.cache if used else self.new).items():
            if value is not None:
                self.state.updateValue((name,), (value,))


class _Listed:
    """A map kept as a list state: read whole by one call, and what is new is added by one, where a map state takes two calls for each name."""

    def __init__(self, state) -> None:
        self.state, self.cache, self.new = state, dict(state.get()), {}

    def get(self, name: str):
        return self.cache.get(name)

    def put(self, name: str, value) -> None:
        self.cache[name] = self.new[name] = value

    def clear(self) -> None:
        self.state.clear()
        self.cache, self.new = {}, {}

    def flush(self, used: bool) -> None:
        if self.new:
            self.state.appendList(list(self.new.items()))


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A session's rows of a batch, in order; a reset comes before sightings of the same order."""
    rows = pd.concat(list(frames))
    rows["reset"] = rows["reset"].fillna(False).astype(bool)
    return rows.sort_values(["order", "reset"], ascending=[True, False], kind="stable")


class SessionTokens(StatefulProcessor):
    def __init__(self, key: bytes | None = None, time_to_live_ms: int | None = None) -> None:
        self.key, self.ttl = key, time_to_live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A time to live is each name's own, which a list can't renew.
        self.tokens = handle.getListState("tokens", "name string, token string") if self.ttl is None else handle.getMapState("tokens", "name string", "token string", self.ttl)
        self.counts = handle.getMapState("counts", "category string", "n long", self.ttl)

    def _name(self, value: str) -> str:
        return hmac.new(self.key, value.encode(), hashlib.sha256).hexdigest() if self.key else value

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tokens, counts = (_Listed if self.ttl is None else _Held)(self.tokens), _Held(self.counts)
        rule, out = _Numbering(tokens, counts), []
        for r in _rows(rows).itertuples(index=False):
            if r.reset:
                tokens.clear()
                counts.clear()
            if isinstance(r.original, str) and r.original and isinstance(r.category, str) and r.category:
                token, fresh = rule.see(self._name(r.original), r.category, r.blocked is not None and bool(r.blocked))
                out.append((key[0], int(r.order), r.original, r.category, token, fresh))
        tokens.flush(self.ttl is not None)
        counts.flush(self.ttl is not None)
        yield pd.DataFrame(out, columns=["session", "order", "original", "category", "token", "fresh"])

    def close(self) -> None:
        pass


def session_stream(sightings: DataFrame, *, key: bytes | None = None, time_to_live_ms: int | None = None) -> DataFrame:
    """sightings, a stream or a table: as SIGHTINGS. A row per sighting with a value and a category: its token, and whether it was the first. Rows of one session
    are numbered by order within a batch, and batches by when they come; sessions without rows in a batch cost nothing. A null session is a session.

    Sets the session's state store provider to RocksDB, which map states need, if it is another.
    """
    spark = sightings.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != _PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    _ = spark.streams.active  # starts what state stores report to, which a table alone doesn't
    rows = sightings.select(*(c.split()[0] for c in SIGHTINGS.split(", ")))
    mode = "ProcessingTime" if time_to_live_ms is not None else "None"
    return rows.groupBy("session").transformWithStateInPandas(SessionTokens(key, time_to_live_ms), TOKENS, "Append", mode)
