"""Model recognisers: a model is loaded once per worker, in a process of its own, and each batch has a time limit. Whatever goes wrong, rules still count, and a
gap says why.
"""

from __future__ import annotations

import contextlib
import os
import pickle
import select
import struct
import subprocess
import sys
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detect as D
from .matcher import _ARROW, ENTITIES

#: Texts in one call of a model, failures of a worker after which its model isn't tried again in this task, and seconds to load a model.
ROWS, FAILURES, LOAD_LIMIT = 64, 3, 120.0
DEFAULT_BACKEND = "gliner"
#: The names of backends that a setting or a policy may have.
BACKENDS = ("gliner", "spacy", "nunerzero")


class Recogniser(Protocol):
    def entities(self, texts: Sequence[str]) -> Sequence[Sequence[Mapping]]:
        """Of each text its entities: start, end (code points), label, score."""


def resolve_backend(setting: str | None, policy: str | None = None, known: Sequence[str] = BACKENDS) -> str:
    """The setting, else the policy's, else the default. An unknown name is an error: no backend stands in for another in silence."""
    name, where = next(((n, w) for n, w in ((setting, "setting"), (policy, "policy")) if n), (DEFAULT_BACKEND, "default"))
    clean = str(name).strip().lower()
    if clean not in known:
        raise ValueError(f"unknown recogniser {name!r} ({where}); one of {sorted(known)}")
    return clean


_CHILD = """
import os, pickle, struct, sys
out = os.fdopen(os.dup(1), "wb")
os.dup2(2, 1)  # what a model prints is no answer
def read(n):
    data = sys.stdin.buffer.read(n)
    if len(data) < n:
        sys.exit()
    return data
def send(x):
    raw = pickle.dumps(x)
    out.write(struct.pack("<Q", len(raw)) + raw)
    out.flush()
get = lambda: pickle.loads(read(struct.unpack("<Q", read(8))[0]))
model = get()()
send("ready")
while True:
    texts = get()
    try:
        send([[(int(e["start"]), int(e["end"]), str(e["label"]), float(e["score"])) for e in one] for one in model.entities(texts)])
    except Exception as e:
        send(f"{type(e).__name__}")
"""


class _Worker:
    """A process with a loaded model."""

    def __init__(self, load: Callable[[], Recogniser], load_limit: float) -> None:
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.process = subprocess.Popen([sys.executable, "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)
        try:
            self._send(cloudpickle.dumps(load), load_limit)
            if self._receive(time.monotonic() + load_limit) != "ready":
                raise RuntimeError("did not load")
        except BaseException:
            self.close()
            raise

    def _send(self, raw: bytes, limit: float) -> None:
        data, at, until = struct.pack("<Q", len(raw)) + raw, 0, time.monotonic() + limit
        fd = self.process.stdin.fileno()
        os.set_blocking(fd, False)
        while at < len(data):
            if not select.select([], [fd], [], max(0.0, until - time.monotonic()))[1]:
                raise TimeoutError
            at += os.write(fd, data[at : at + 65536])

    def _receive(self, until: float):
        fd, data, size = self.process.stdout.fileno(), b"", None
        while size is None or len(data) < 8 + size:
            if not select.select([fd], [], [], max(0.0, until - time.monotonic()))[0]:
                raise TimeoutError
            more = os.read(fd, 1 << 20)
            if not more:
                raise EOFError
            data += more
            if size is None and len(data) >= 8:
                (size,) = struct.unpack("<Q", data[:8])
        return pickle.loads(data[8:])  # noqa: S301 - from this worker's own child

    def ask(self, texts: list[str], limit: float):
        until = time.monotonic() + limit
        self._send(pickle.dumps(texts), limit)
        return self._receive(until)

    def close(self) -> None:
        self.process.kill()
        self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            with contextlib.suppress(OSError):
                pipe.close()


def _checked(answer, texts: list[str]) -> list[list[dict]]:
    if not isinstance(answer, list) or len(answer) != len(texts):
        raise ValueError
    return [[{"start": s, "end": e, "label": label, "score": score, "text": t[s:e]} for s, e, label, score in sorted(found) if 0 <= s < e <= len(t)] for found, t in zip(answer, texts)]


def with_recogniser(docs: DataFrame, load: Callable[[], Recogniser], *, text_col: str = "text", out_col: str = "entities", reason_col: str = "gap_reason", time_limit: float = 10.0, rows: int = ROWS, load_limit: float = LOAD_LIMIT) -> DataFrame:
    """docs with out_col, the entities of each text, and reason_col, null where there is an answer. A batch whose model takes longer than time_limit (seconds), dies, fails, or
    answers out of shape has null entities and the reason; its process is ended, and the next batch gets a new one. After FAILURES in a row a task doesn't start
    another. load runs in that process and must be picklable. A null text has no entities.
    """
    for name in (out_col, reason_col):
        if name in docs.columns:
            raise ValueError(f"there is a column {name!r} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, ENTITIES), T.StructField(reason_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, failed, last = None, 0, ""

        def answer(texts: list[str]) -> tuple[list, str | None]:
            nonlocal worker, failed, last
            if failed >= FAILURES:
                return [None] * len(texts), f"recogniser is off after {FAILURES} failures: {last}"
            try:
                started = worker is not None
                worker = worker or _Worker(load, load_limit)
                started = True
                found = _checked(worker.ask(texts, time_limit), texts)
                failed = 0
                return found, None
            except TimeoutError:
                last = "recogniser timed out" if started else "recogniser timed out while loading"
            except (EOFError, OSError, RuntimeError):
                last = "recogniser crashed" if started else "recogniser can't be loaded"
            except (ValueError, TypeError):
                last = "recogniser gave a wrong answer"
            failed += 1
            if worker is not None:
                worker.close()
                worker = None
            return [None] * len(texts), last

        try:
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                entities: list = [[] for _ in texts]
                reasons: list = [None] * len(texts)
                some = [k for k, t in enumerate(texts) if t]
                for at in range(0, len(some), rows):
                    part = some[at : at + rows]
                    found, reason = answer([texts[k] for k in part])
                    for k, f in zip(part, found):
                        entities[k], reasons[k] = f, reason
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entities, _ARROW), pa.array(reasons, pa.string())], names=[*batch.schema.names, out_col, reason_col])
        finally:
            if worker is not None:
                worker.close()

    return docs.mapInArrow(run, schema)


def scan_with(docs: DataFrame, load: Callable[[], Recogniser], labels: dict[str, str], *, text_col: str = "text", scan_col: str = "scan", limits: dict | None = None, **options) -> DataFrame:
    """docs with scan_col: struct(detections, coverage_gap, stage2_gap_reason) of rules and model; the rules alone where the model gave no answer. limits: for
    with_recogniser(), options: for detect()."""
    rows = with_recogniser(docs, load, text_col=text_col, out_col="__entities", reason_col="__reason", **(limits or {}))
    scan: Column = D.scan(F.col(f"`{text_col}`"), F.col("__entities"), labels, F.col("__reason"), **options)
    return rows.withColumn(scan_col, scan).drop("__entities", "__reason")
