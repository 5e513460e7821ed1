"""Regions of long near copies: splitting ends, and what it works on stays bounded."""

import random

import numpy as np
import pytest

from maskwright.llm import jaccard_join
from maskwright.llm.common import NULL_ID


def classes(some: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """By brute force: all pairs, as a product of incidence matrices."""
    sets, number = [], {}
    for _, text in some:
        w = text.split()
        sets.append({number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(len(w) - 4)})
    held = np.zeros((len(sets), len(number)), np.float32)
    for k, s in enumerate(sets):
        held[k, list(s)] = 1
    common = held @ held.T
    n = held.sum(1)
    linked = 100 * common >= 80 * (n[:, None] + n[None] - common)
    own = np.arange(len(sets))
    while True:
        new = np.array([own[row].min() for row in linked])
        if (new == own).all():
            break
        own = new
    ids = np.array([i for i, _ in some])
    least = {c: int(ids[own == c].min()) for c in np.unique(own)}
    return sorted((i, len(s), least[c]) for (i, _), s, c in zip(some, sets, own))


def bounded(trace: list[float]) -> bool:
    """A round weighs at most SPREAD times the one before; the last one, of cells that are all small, at most a copy per pivot and one more."""
    most = [jaccard_join.SPREAD] * max(0, len(trace) - 2) + [jaccard_join.PIVOTS + 1]
    return all(b <= m * a for a, b, m in zip(trace, trace[1:], most))


def got(frame):
    return sorted((NULL_ID if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


def drafts(count: int, words: int, share: float, seed: int = 3) -> list[tuple[int, str]]:
    """Texts that each keep share of one base, in runs, so that any two have about the same distance."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    out = []
    for k in range(count):
        text = []
        for at in range(0, words, 25):
            text += base[at : at + 25] if rng.random() < share else [f"o{k}x{at}x{j}" for j in range(25)]
        out.append((k, " ".join(text)))
    return out


def test_long_drafts_of_one_text_end(spark):
    """Distances of about 0.5 all over: it ends after a round or two."""
    some = drafts(50, 2600, 0.8)
    some += [(100 + k, some[k][1] + " one more word or two") for k in range(10)]
    trace: list[float] = []
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert got(jaccard_join.jaccard_join(docs, cell=60, trace=trace)) == classes(some)
    assert trace[0] > 60 and len(trace) <= 3 and bounded(trace)


def test_many_long_drafts_with_the_default_cell(spark):
    some = drafts(1500, 600, 0.9, seed=8)
    some += [(5000 + k, some[k][1].replace("b5 ", "c5 ")) for k in range(0, 1500, 50)]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(6)
    trace: list[float] = []
    assert got(jaccard_join.jaccard_join(docs, trace=trace)) == classes(some)
    assert bounded(trace)


@pytest.mark.parametrize("cell", [60, 200])
def test_chains_and_clusters(spark, cell):
    """Classes that split: some far apart, some chains, some equal sets."""
    rng = random.Random(11)
    some = []
    for c in range(6):
        base = [f"common{k}" for k in range(40)] + [f"c{c}w{k}" for k in range(160)]
        now = base
        for k in range(40):
            now = list(now)
            for _ in range(rng.randint(0, 4)):
                now[rng.randrange(200)] = f"z{c}x{k}x{rng.randint(0, 9)}"
            some.append((c * 100 + k, " ".join(now if k % 2 else base)))
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert got(jaccard_join.jaccard_join(docs, cell=cell)) == classes(some)
