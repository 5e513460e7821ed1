"""Language-model scoring, fill-in-middle and whitening against brute force, gradients against differences, held-out quality."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import fill_in_middle as fim
from maskwright.llm import lm_scoring as lm
from maskwright.llm import whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, carried string, n long, row long, held boolean, output string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def some_texts(count: int = 120) -> list[tuple[int | None, str | None]]:
    """Two made-up languages, whose words follow each other by rules, and odd rows."""
    rng = random.Random(7)
    words = {k: ["".join(rng.choice(["ka", "mo", "ti", "ré", "zu"] if k else ["lo", "ñe", "ba", "x", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(40)] for k in (0, 1)}
    out: list[tuple[int | None, str | None]] = []
    for i in range(count):
        own = words[i % 2]
        text, w = [], rng.choice(own)
        for _ in range(rng.randint(1, 90)):
            text.append(w)
            w = own[(own.index(w) + rng.choice([1, 1, 2, 5])) % 40]
        out.append((i, " ".join(text)))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "a\x00b c\x85d"), (204, "x" * 5000), (205, "keep <P> this <M>"), (206, " lead and trail  \n"), (206, "an id that comes again"), (None, "no id"), (None, None), (207, "Ünï ΑΒΓ 한국어 🙂 " * 40), (208, out[3][1]), (209, out[3][1].upper())]
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = some_texts()
    return rows, spark.createDataFrame([(i, t, "en", "c", 1, 2, True, "o") for i, t in rows], SCHEMA).repartition(3).cache()


# --- language model -----------------------------------------------------------------------------

def brute_base(rows):
    """(id, text) to (held out, tokens, known, N, base), by the formula."""
    cut = [(i, [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] + ["\n"]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = collections.Counter(w for (_, ws), h in zip(cut, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for (i, ws), h in zip(cut, held)]


@pytest.mark.parametrize("block", [lm.BLOCK, 300])
def test_counts_and_base_scores(texts, block):
    rows, docs = texts
    out = lm.score_texts(docs, tokenizer=BYTE_BPE, block=block)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:4])
    got = sorted([tuple(r) for r in out.collect()], key=key)
    want = sorted(brute_base(rows), key=key)
    assert [r[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in got], [w[5] for w in want], rtol=1e-12)
    assert all(r[6] < 0 and np.isfinite(r[6]) for r in got)


def test_model_beats_single_words_on_held_out_texts(spark):
    rows = [(i, t) for i, t in some_texts(1500) if i is not None and i < 1500]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=BYTE_BPE, block=20_000)
    held = out.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert held.s / held.n > held.b / held.n + 0.15


def test_empty_tables_and_no_training_text(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), tokenizer=BYTE_BPE).collect() == []
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.score_texts(spark.createDataFrame([(i, "some words here") for i in out], "doc_id long, text string"), tokenizer=BYTE_BPE).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 4, 0, 0, 0.0)] * 3 and all(np.isfinite(r.score) for r in got)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    flat = rng.standard_normal(lm.AttentionModel.CELLS) * 0.3
    x, z, y = (rng.integers(0, n, (3, 32)) for n in (lm.CLASSES, lm.LAST_CLASSES, lm.CLASSES))
    real = np.arange(32) < np.array([32, 20, 7])[:, None]
    # In double precision, so that differences are exact enough.
    model = lm.AttentionModel(flat)
    model.w = {n: v.astype(np.float64) for n, v in model.w.items()}
    loss = lambda: -(model.log_shares(x, z, y) * real).sum() / real.sum()
    for name, g in model.gradient(x, z, y, real).items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in model.w[name].shape)
            was = model.w[name][at]
            model.w[name][at] = was + 1e-5
            up = loss()
            model.w[name][at] = was - 1e-5
            down = loss()
            model.w[name][at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])) + 1e-6, name


def test_model_is_causal_and_sums_to_one():
    rng = np.random.default_rng(1)
    model = lm.AttentionModel(rng.standard_normal(lm.AttentionModel.CELLS) * 0.3)
    x, z = (rng.integers(0, n, (1, 48)) for n in (lm.CLASSES, lm.LAST_CLASSES))
    every = np.stack([model.log_shares(x, z, np.full_like(x, c)) for c in range(lm.CLASSES)])
    assert np.allclose(np.exp(every).sum(0), 1, atol=1e-4)
    x2 = x.copy()
    x2[0, 30:] = (x2[0, 30:] + 1) % lm.CLASSES
    y = rng.integers(0, lm.CLASSES, x.shape)
    assert np.allclose(model.log_shares(x, z, y)[0, :30], model.log_shares(x2, z, y)[0, :30])


@pytest.mark.parametrize("stride", [lm.STRIDE, lm.WINDOW])
def test_windows_score_each_place_once(stride):
    sizes = np.array([1, 2, 63, 64, 65, 112, 113, 1000, 16, 17])
    at, length, known = lm.windows(sizes, stride)
    seen = np.zeros(sizes.sum(), int)
    for some, p, real in lm._batches(at, length):
        new = real & (np.arange(p.shape[1]) >= known[some, None])
        np.add.at(seen, p[new], 1)
    assert (seen == 1).all()
    # No window crosses the border of two texts.
    own = np.repeat(np.arange(len(sizes)), sizes)
    assert (own[at] == own[at + length - 1]).all()


def test_words_within_a_class_are_a_distribution():
    """Over the counted words that begin with an id, P(word | id) sums to at most 1, and leaves room for others."""
    words = [w.encode() for w in ("the", "then", "there", "a", "an", "zebra", "zebras", "the.")]
    ids = lm.subwords(words, BYTE_BPE, 50256)
    flat = lm._Flat(np.array([9, 3, 2, 8, 4, 1, 1, 2]), np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids]))
    size = 50257
    counts = np.bincount(flat.first, weights=flat.count, minlength=size)
    kinds = np.bincount(flat.first, minlength=size)
    zero = np.zeros(size, np.int64)
    _, before, after = flat.steps(size)
    code, times = np.unique(zero[before] * (size + 1) + after, return_counts=True)
    known = lm.Lexicon(size, 50256, counts, kinds, zero, zero, zero, code, times.astype(float))
    after_first = np.bincount(flat.first, weights=np.exp(known.within(flat) - known.inside[flat.first]))
    assert (after_first <= 1).all() and (after_first[np.unique(flat.first)] > 0.4).all() and abs(np.exp(known.inside).sum() - 1) < 1e-9


# --- fill-in-middle -----------------------------------------------------------------------------

def brute_fim(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text, text
    if h4 % 100 < 80:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_fill_in_middle(texts):
    rows, docs = texts
    out = fim.fill_in_middle(docs, carry=("lang", "carried"))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("r"), "carried.carried").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted((brute_fim(*r) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"} and {r.carried for r in got} == {"c"}


def test_fill_in_middle_with_odd_texts(spark):
    """Texts that look like parts of markers, other parameters, and a text far beyond a block of texts."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["<", "P>", "S", "<M", ">", " ", "\n", "w"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(1000 + k, "long words " * 400_000) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.fill_in_middle(docs).withColumn("r", fim.restored(F.col("output"), F.col("form"))).join(docs, "doc_id")
    assert out.where("r <> text").isEmpty() and out.where("form <> 'plain' and length(output) <> length(text) + 9").isEmpty()
    every = fim.fill_in_middle(docs, percent=100, spm_percent=0, seed=7, markers=("[a]", "[b's]", "[c]"))
    every = every.withColumn("r", fim.restored(F.col("output"), F.col("form"), ("[a]", "[b's]", "[c]"))).join(docs, "doc_id")
    assert every.where("r <> text").isEmpty() and every.where("text <> '' and form <> 'psm'").isEmpty()
    assert fim.fill_in_middle(docs.where("false")).collect() == []


# --- whitening ----------------------------------------------------------------------------------

def brute_whitening(vectors: list[list[float]]):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, ((n * x - s) ** 2).sum(1), c @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1] / np.trace(v)


def whitened(frame) -> dict:
    out = collections.defaultdict(dict)
    for r in frame.collect():
        out[r.vec_id][r.component] = r
    return out


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((400, 24)) @ rng.standard_normal((24, 24)) * 0.3 + rng.standard_normal(24)).astype(np.float32)
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    odd = [(900, None, "x"), (901, [*vectors[0].tolist()[:-1], None], "x"), (902, [*vectors[0].tolist()[:-1], float("nan")], "x"), (903, [float("inf")] * 24, "x"), (904, [], "x")]
    docs = spark.createDataFrame(rows + odd[:4], "vec_id long, embedding array<float>, x string").repartition(3)
    n, deviation, want, shares = brute_whitening(vectors)
    got = whitened(whitening.whiten(docs, carry=("x",)))
    assert sorted(got) == list(range(400)) and all(sorted(g) == list(range(1, 9)) for g in got.values())
    mine = np.array([[got[k][c].whitened for c in range(1, 9)] for k in range(400)])
    sign = np.sign((mine * want[:, :8]).sum(0))
    assert np.abs(mine * sign - want[:, :8]).max() < 1e-8
    assert [int(got[k][1].deviation) for k in range(400)] == deviation.tolist()
    assert np.allclose([got[0][c].explained for c in range(1, 9)], shares[:8], rtol=1e-9)
    assert got[0][1].identity_error < 1e-9 and got[0][1].n == n and got[0][1].carried.x == "x"
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([*rows, odd[4]], "vec_id long, embedding array<float>, x string"))


def test_whitening_of_flat_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).collect() == [] and make([(1, [1.0, 2.0])]).collect() == [] and make([(1, []), (2, [])]).collect() == []
    assert make([(k, [0.5, 0.25]) for k in range(5)]).collect() == []
    # Rank 2 of 4: two components, whatever is asked for; null and repeated ids are rows.
    rng = np.random.default_rng(2)
    a = rng.integers(-50, 50, (60, 2))
    vectors = np.stack((a[:, 0], a[:, 1], a[:, 0], np.zeros(60)), 1).astype(float)
    got = make([(None if k < 3 else k // 2, v.tolist()) for k, v in enumerate(vectors)]).collect()
    assert len(got) == 120 and {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    assert sum(r.vec_id is None for r in got) == 6 and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9


def test_lobpcg_finds_close_eigenvalues():
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    e = np.r_[[10.0, 10.0, 9.999999, 5, 4, 3, 2.5, 2.4], np.linspace(2, 0, 192)]
    v = (q * e) @ q.T
    calls = []

    def product(b):
        calls.append(b.shape[1])
        return v @ b

    found, x, residual = whitening.lobpcg(product, 200, 8)
    assert np.allclose(found, e[:8], rtol=1e-10) and residual.max() <= 2e-12 * 10 and np.allclose(x.T @ x, np.eye(8), atol=1e-12)
    assert max(calls) <= 3 * 16 and len(calls) < 150
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(product, 200, 8, rounds=2)


def test_exact_deviations_beyond_64_bits():
    n, s = 10**6, 10**12
    known = whitening.Fit(n, np.array([0, s], object))
    x = np.array([[2**38, 100_000], [-(2**40), 7], [2**52, 0]])
    got = whitening._deviations(known.scaled(x))
    assert [v.as_py() and int(v.as_py()) for v in got] == [(2**38 * n) ** 2 + (100_000 * n - s) ** 2, (2**40 * n) ** 2 + (7 * n - s) ** 2, None] and got.type == pa.decimal128(38, 0)
