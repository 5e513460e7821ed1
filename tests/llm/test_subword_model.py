"""The attention model of language-model scoring predicts every subword id, whole vocabulary and all, from the ids before it."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from maskwright.llm import lm_scoring as lm

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def log_softmax(x):
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def naive(model, x, z, y):
    """log P(y) at each place of one window, place by place and head by head."""
    w, depth, out = {n: v.astype(np.float64) for n, v in model.w.items()}, lm.WIDTH // lm.HEADS, []
    e = np.stack([w["first"][a] + w["last"][b] + w["place"][i] for i, (a, b) in enumerate(zip(x, z))])
    for i in range(len(x)):
        heads = []
        for k in range(lm.HEADS):
            own = slice(k * depth, (k + 1) * depth)
            query, keys, values = e[i] @ w["query"][:, own], e[: i + 1] @ w["key"][:, own], e[: i + 1] @ w["value"][:, own]
            heads.append(np.exp(log_softmax(keys @ query / np.sqrt(depth))) @ values)
        h = e[i] + np.concatenate(heads) @ w["join"]
        c = int(np.searchsorted(model.edges, y[i], side="right")) - 1
        own = slice(model.edges[c], model.edges[c + 1])
        out.append(log_softmax(h @ w["out"] + w["bias"])[c] + log_softmax(w["inside"][own] @ h + w["inside_bias"][own])[y[i] - model.edges[c]])
    return np.array(out)


def test_shares_are_those_of_attention_place_by_place():
    rng, size = np.random.default_rng(3), 700
    for scale in (0.3, 1.5, 12.0):  # the last needs shifted exponents
        model = lm.AttentionModel(rng.standard_normal(lm.AttentionModel.cells(size)) * scale, size)
        model.w = {n: v.astype(np.float64) for n, v in model.w.items()}
        x, z, y = rng.integers(0, size, 30), rng.integers(0, lm.LAST_CLASSES, 30), rng.integers(0, size, 30)
        assert np.allclose(model.log_shares(x[None], z[None], y[None])[0], naive(model, x, z, y))
        every = np.stack([model.log_shares(x[None], z[None], np.full((1, 30), c))[0] for c in range(size)])
        assert np.allclose(np.exp(every).sum(0), 1)


def test_model_begins_at_the_counted_shares():
    counts = np.array([900, 70, 70, 30, 5, 0, 0] + [0] * 300)
    model = lm.AttentionModel(lm.AttentionModel.start(counts), len(counts))
    got = [model.log_shares(np.zeros((1, 1), int), np.zeros((1, 1), int), np.array([[c]]))[0, 0] for c in range(len(counts))]
    assert np.allclose(np.exp(got), (counts + lm.LEAST) / (counts + lm.LEAST).sum(), rtol=1e-3)


def test_blocks_hold_the_ids_of_whole_texts():
    """x, z and y of a block are its texts' ids, the end's included, and what comes before each."""
    texts = ["the antithesis of zebrakat", "", "zebrakat zebrakat " + "q" * 900]
    rng = np.random.default_rng(0)
    known = lm.Ranks(rng.permutation(50257), np.r_[[5] * 100, [0] * 50157], 0)
    known.end = int(known.rank[50256])
    cut = next(lm._blocks(10_000)(iter([pa.RecordBatch.from_pydict({"row": range(3), "held": [False] * 3, "text": texts})])))
    words = cut.column("words")[0].as_py()
    ids = lm.subwords(words, BYTE_BPE, 50256)
    packed = known.packed(lm._Flat(np.ones(len(ids)), np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids])))
    row = cut.to_pylist()[0]
    told = {"count": np.ones(len(words), np.int64), "pieces": np.array([len(i) for i in ids]), "ranks": np.frombuffer(b"".join(packed.to_pylist()), known.kind)}
    batch = pa.RecordBatch.from_pylist([{k: row[k] for k in ("block", "rows", "held", "sizes", "places")} | {c: lm._packed(told[c].astype(kind)) for c, kind in lm._WORD.items()}])
    b = lm._Block(batch, 0, known)
    for k, text in enumerate(texts):
        each = [lm.subwords([w], BYTE_BPE, 50256)[0] for w in lm.tokens(text.encode())]
        want = known.rank[np.concatenate(each)]
        own = slice(b.begin[k], b.begin[k] + b.sizes[k])
        assert b.y[own].tolist() == want.tolist() and b.x[own].tolist() == [known.end, *want[:-1]]
        assert b.z[own].tolist() == [0, *(min(i, lm.LAST_CLASSES - 1) for w in each for i in range(len(w)))][:-1]


def test_later_subwords_follow_from_words_before(spark):
    """A text holds one of two words that differ in a later subword alone. Counts within words leave both at a half wherever they come: 0.3 digits a pair of words."""
    kat, mol = (lm.subwords([w], BYTE_BPE, 50256)[0].tolist() for w in (b"zebrakat", b"zebramol"))
    assert kat[0] == mol[0] and kat != mol
    rows = [(i, " ".join(["the", ("zebrakat", "zebramol")[i // 2 % 2]] * 40)) for i in range(600)]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=BYTE_BPE, block=5_000)
    held = out.where("held_out").agg(F.sum("score").alias("s"), F.count("*").alias("n")).first()
    assert held.s / held.n / 40 > -0.2


def test_each_id_is_scored_once_as_in_its_own_window(monkeypatch):
    """Windows overlap, but an id's softmax is found in the first window that holds it alone, and is that window's."""
    rng, size = np.random.default_rng(5), 700
    model = lm.AttentionModel(rng.standard_normal(lm.AttentionModel.cells(size)) * 0.3, size)
    b = lm._Block.__new__(lm._Block)
    b.sizes = np.array([5, 64, 300, 1, 130])
    n, b.begin = int(b.sizes.sum()), np.cumsum(b.sizes) - b.sizes
    b.x, b.z, b.y = rng.integers(0, size, n), rng.integers(0, lm.LAST_CLASSES, n), rng.integers(0, size, n)
    rows, classes = [], lm.AttentionModel._classes
    monkeypatch.setattr(lm.AttentionModel, "_classes", lambda self, h, own: rows.append(len(h)) or classes(self, h, own))
    got = b.scores(model)
    assert sum(rows) == n
    for at, length, known in zip(*lm.windows(b.sizes, lm.STRIDE)):
        own = slice(at, at + length)
        assert np.allclose(got[own][known:], model.log_shares(b.x[None, own], b.z[None, own], b.y[None, own])[0][known:], atol=1e-4)


def test_rounds_get_equal_numbers_of_blocks():
    """Hashes of the blocks' numbers gave most blocks to two of the rounds."""
    rounds = [[lm.round_of((p << lm.PARTITION_BITS) + k) for p in range(16)] for k in range(3)]
    assert all(sorted(r) == sorted([*range(lm.ROUNDS)] * (16 // lm.ROUNDS)) for r in rounds)
    assert len({r[0] for r in rounds}) == 3
