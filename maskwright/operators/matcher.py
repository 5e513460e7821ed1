"""Many literals at once: an Aho-Corasick automaton over all of them, built once in a worker, reads each text once, however many literals there are."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENTITIES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64()), ("text", pa.string())]))
#: Characters of literals in one automaton, which is some hundred times as large in memory. More literals are read in several passes.
MOST = 4_000_000


def _automaton(words: list[tuple[str, tuple[str, ...]]]) -> ahocorasick.Automaton:
    """words: (literal, its labels)."""
    out = ahocorasick.Automaton()
    for word, labels in words:
        out.add_word(word, (len(word), labels))
    out.make_automaton()
    return out


def literal_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, label), in order: of each label the leftmost literals and, of those that begin together, the longest, without overlaps within the label. That is what
    an alternation of the label's literals finds, longer ones first."""
    found = sorted((end + 1 - size, -size, label) for end, (size, labels) in automaton.iter(text) for label in labels) if len(automaton) else []
    reach: dict[str, int] = {}
    out = []
    for start, size, label in found:
        if start >= reach.get(label, 0):
            reach[label] = start - size
            out.append((start, start - size, label))
    return out


def _parts(words: Mapping[str, str | tuple[str, ...]]) -> Iterator[list[tuple[str, tuple[str, ...]]]]:
    """Literals by label, so that a label's literals stay together as long as one automaton can hold them."""
    by_label: dict[str, list[str]] = {}
    for word, labels in words.items():
        for label in (labels,) if isinstance(labels, str) else labels:
            if word:
                by_label.setdefault(label, []).append(word)
    part: dict[str, list[str]] = {}
    size = 0
    for label, own in by_label.items():
        total = sum(map(len, own))
        if part and size + total > MOST:
            yield [(w, tuple(ls)) for w, ls in part.items()]
            part, size = {}, 0
        for w in own:
            part.setdefault(w, []).append(label)
        size += total
    if part:
        yield [(w, tuple(ls)) for w, ls in part.items()]


def with_entities(docs: DataFrame, words: Mapping[str, str | tuple[str, ...]], *, text_col: str = "text", out_col: str = "entities", score: float = 0.9) -> DataFrame:
    """docs with out_col: every occurrence of a literal, array<struct<start, end, label, score, text>>, as literal_spans() orders them; empty for a null text. words:
    literals to their label, or labels. An entity recogniser by dictionary, in place of a model; scan() takes the column. Literals count code points and case.
    """
    if out_col in docs.columns:
        raise ValueError(f"there is a column {out_col!r} already")
    parts = list(_parts(words)) or [[]]
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, ENTITIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [_automaton(p) for p in parts]
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                found = sorted(x for m in machines for x in literal_spans(text, m)) if text else []
                rows.append([{"start": s, "end": e, "label": label, "score": score, "text": text[s:e]} for s, e, label in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def without_allowed(docs: DataFrame, words: list[str], *, dets_col: str = "detections") -> DataFrame:
    """docs with dets_col, an array of detections, without those whose value holds one of the words anywhere: an allow list of literals."""
    parts = [[(w, ("",)) for w in dict.fromkeys(words) if w]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(parts[0])
        held = lambda value: bool(len(machine)) and value is not None and next(machine.iter(value), None) is not None
        for batch in batches:
            at = batch.schema.get_field_index(dets_col)
            column = batch.column(at)
            rows = [None if dets is None else [d for d in dets if not held(d["original"])] for dets in column.to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, column.type))

    return docs.mapInArrow(run, docs.schema)
