"""The line index over many generations: chains of filters, merged totals, deletions, and ids that come again."""

import collections

import numpy as np
import pytest

from maskwright.llm import line_dedup
from maskwright.llm.common import NULL_ID


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def kept(rows: list[tuple[int | None, str | None]]) -> dict:
    """By brute force: rows that share an id are one document."""
    held = collections.defaultdict(set)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    key = lambda i: NULL_ID if i is None else i
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(norm(x)) >= 10:
                held[norm(x)].add(key(i))
    gone = lambda i, x: len(norm(x)) >= 10 and key(i) > min(held[norm(x)])
    return {(i, t): "\n".join(x for x in (t or "").split("\n") if not gone(i, x)) for i, t in rows}


def some_lines(k: int, count: int = 60) -> str:
    rng = np.random.default_rng(k)
    return "\n".join(f"a line with the number {x}" for x in rng.integers(0, 400, count))


def test_many_generations_are_merged_and_agree(spark):
    """More insertions than LEVELS, with ids in no order: what an insertion says counts what came before, and render() all."""
    index = line_dedup.LineIndex(spark, shards=3)
    rng = np.random.default_rng(1)
    order, rows = rng.permutation(24), []
    for at in range(0, 24, 3):
        new = [(int(i), some_lines(int(i))) for i in order[at : at + 3]]
        rows += new
        got = {(r.doc_id): r.text for r in index.insert(frame(spark, new)).collect()}
        want = kept(rows)
        assert got == {i: want[i, t] for i, t in new}
        assert len(index.totals) <= line_dedup.LEVELS
    assert {r.doc_id: r.text for r in index.render(frame(spark, rows)).collect()} == {i: x for (i, _), x in kept(rows).items()}
    opened = line_dedup.LineIndex(spark, index.path)
    assert opened.totals == index.totals
    gone = [i for i, _ in rows if i % 3 == 0]
    opened.delete(frame(spark, [(i, "") for i in gone]).select("doc_id"))
    left = [(i, t) for i, t in rows if i % 3]
    assert {r.doc_id: r.text for r in opened.render(frame(spark, left)).collect()} == {i: x for (i, _), x in kept(left).items()}
    # They come back as new ones.
    back = [(i, t) for i, t in rows if i % 3 == 0]
    got = {r.doc_id: r.text for r in opened.insert(frame(spark, back)).collect()}
    assert got == {i: kept(rows)[i, t] for i, t in back}


def test_chain_of_filters_holds_every_live_key(spark):
    """Each batch is larger than what the open filter has room for."""
    index = line_dedup.LineIndex(spark, shards=1)
    text = lambda a, b: "\n".join(f"line number {k:06d} of many" for k in range(a, b))
    ends = [0, 20, 400, 3000, 9000]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        index.insert(frame(spark, [(k + 10, text(a, b))])).count()
    chain = [line_dedup.CuckooFilter.from_bytes(r.filter) for r in index._held_filters().orderBy("since").collect()]
    assert len(chain) >= 2
    keys = lambda a, b: np.array([np.frombuffer(line_dedup.key_hash(line_dedup.line_key(x.encode())), "<i8")[0] for x in text(a, b).split("\n")])
    every = keys(0, ends[-1])
    assert np.any([f.contains(every) for f in chain], axis=0).all()
    # A deletion takes its keys out of the filter that holds them, and no other key.
    index.delete(frame(spark, [(11, "")]).select("doc_id"))
    chain = [line_dedup.CuckooFilter.from_bytes(r.filter) for r in index._held_filters().orderBy("since").collect()]
    held = np.any([f.contains(every) for f in chain], axis=0)
    assert held[: ends[1]].all() and held[ends[2] :].all() and held[ends[1] : ends[2]].mean() < 0.05
    assert index.insert(frame(spark, [(50, text(0, 9000))])).first().n_dropped == 9000 - (ends[2] - ends[1])


def test_an_id_that_comes_again_adds_to_its_lines(spark):
    index = line_dedup.LineIndex(spark, shards=2)
    index.insert(frame(spark, [(5, "the first common line")])).count()
    got = index.insert(frame(spark, [(5, "the first common line\nand another one of it"), (7, "and another one of it\nthe first common line\nown line of seven")])).collect()
    assert {r.doc_id: r.text for r in got} == {5: "the first common line\nand another one of it", 7: "own line of seven"}
    index.delete(frame(spark, [(5, "")]).select("doc_id"))
    assert index.reference_counts().count() == 3
    assert index.render(frame(spark, [(7, "and another one of it\nthe first common line")])).first().n_dropped == 0


@pytest.mark.parametrize("ids", [[None, None, 1, 2], [3, 3, 3, 4], [None] * 4])
def test_batches_of_null_and_repeated_ids(spark, ids):
    rows = [(i, f"a common line of all\nline of row number {k}") for k, i in enumerate(ids)]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted((NULL_ID if i is None else i, x) for (i, _), x in kept(rows).items())


def test_removal_takes_one_copy_of_each(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**62), 2**62, 30_000)
    f = line_dedup.CuckooFilter.build(keys)
    before = int((f.slots > 0).sum())
    f.remove(keys[:10_000])
    assert int((f.slots > 0).sum()) == before - 10_000 and f.contains(keys[10_000:]).all()
