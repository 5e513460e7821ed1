"""Every stage of the pipeline, and all of them in turn, against brute force: null, empty, long and repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_operators import lines_left, linked
from tokenizers import Tokenizer

from maskwright.llm import mixing, pipeline, toxicity
from maskwright.llm.common import NULL_ID

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"long{k % 977}x{k}" for k in range(20_000))


def rows_of(spark):
    text = lambda k, n=30: " ".join(f"w{k}x{j}" for j in range(n))
    near = text(1, 60).rsplit(" ", 1)[0] + " other"
    rows = [(None, text(0)), (None, text(1, 60)), (None, text(2)), (5, near), (5, text(3)), (6, text(4)), (6, text(4)), (7, text(5)), (8, ""), (9, None), (10, LONG)]
    return rows, spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)


def test_near_copies_by_row(spark):
    rows, docs = rows_of(spark)
    got = collections.Counter((r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs, "").collect())
    # The near copy with id 5 and the second copy with id 6 go, nothing else.
    assert got == collections.Counter(rows[:3] + rows[4:6] + rows[7:])


def test_mix_by_row(spark):
    rows, docs = rows_of(spark)
    # One source: its target is its size, so every row with words is taken once.
    got = collections.Counter((r.doc_id, r.text) for r in pipeline.mix(spark, docs, "").collect())
    assert got == collections.Counter(rows[:8] + rows[10:])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: toxic ones hold marking words; lines, passages and texts repeat."""
    rng = random.Random(11)
    words = [f"word{k}" for k in range(400)]
    line = "this line is in many documents"
    docs, labels = [], []
    for k in range(160):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
        if k % 4 == 0:
            t += " vile{0} hateful vile{1} nasty".format(k % 3, (k + 1) % 3)
        if k % 5 == 0:
            t = f"  {line.upper()} \n{t}\nshort"
        docs.append((k, t))
        labels.append((k, 1, int(k % 4 == 0)))
    docs += [(200, docs[1][1]), (201, docs[1][1] + " more"), (202, None), (203, ""), (204, " \n "), (None, docs[2][1]), (205, LONG), (206, f"{line}\n{line}")]
    rows = [(i, t, "en", f"s{n % 3}" if n % 7 else None, len(t or "")) for n, (i, t) in enumerate(docs)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", class string, row long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def not_toxic(spark, path, rows):
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    out = []
    for r in rows:
        words, stems, n = toxicity.features(r[1] or "")
        m = sum(model.weights.get(xxhash.xxh3_64_intdigest(w), 0.0) for w in words)
        m += sum(model.weights.get(xxhash.xxh3_64_intdigest(x, 1), 0.0) * float(toxicity.density(c, n)) for x, c in stems.items())
        if 1 / (1 + np.exp(model.thresholds[0] - m)) < toxicity.REJECT:
            out.append(r)
    return out


def key(i):
    return NULL_ID if i is None else i


def without_lines(rows):
    left = lines_left([(key(i), t or "") for i, t, *_ in rows])
    return [(i, left[key(i)], lang, source, len(left[key(i)])) for i, t, lang, source, _ in rows]


def without_near_copies(rows):
    least = {i: c for i, _, c in linked([(i, t or "") for i, t, *_ in rows])}
    return [r for r in rows if least[key(r[0])] == key(r[0])]


def mixed(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[(r[3] is None, r[3] or "")].append((r, (r[1] or "").encode().split()))
    order = sorted(by)
    sizes = [sum(len(w) for _, w in by[s]) for s in order]
    out = []
    for s, size, target in zip(order, sizes, mixing.brute_targets(sizes, [1 + k % 3 for k in range(len(order))])):
        budget = min(int(target + 0.5), 3 * size)
        epochs, rest = divmod(budget, size) if size else (0, 0)
        digest = lambda r, w: hashlib.md5(f"17|{'' if r[0] is None else r[0]}|{len(w)}".encode()).hexdigest()[:16]
        for r, w in sorted(by[s], key=lambda x: (digest(*x), key(x[0][0]), len(x[1]))):
            part = max(0, min(rest, len(w)))
            rest -= len(w)
            if w:
                out += [r] * epochs + ([r] if part == len(w) else [])
                if 0 < part < len(w):
                    cut = b" ".join(w[:part]).decode()
                    out.append((r[0], cut, r[2], r[3], len(cut)))
    return [(i, t, lang, source, len(t)) for i, t, lang, source, _ in out]


def plain(frame):
    return sorted((tuple(r) for r in frame.select(pipeline.COLUMNS).collect()), key=str)


BRUTE = [not_toxic, lambda spark, path, rows: without_lines(rows), lambda spark, path, rows: without_near_copies(rows), lambda spark, path, rows: mixed(rows)]


@pytest.mark.parametrize("k", range(4))
def test_stage(spark, folder, k):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = BRUTE[k](spark, path, rows)
    assert plain(pipeline.STAGES[k][1](spark, docs, path)) == sorted(want, key=str) and (k == 3 or want != rows)


def test_run(spark, folder):
    path, rows = folder
    for brute in BRUTE:
        rows = brute(spark, path, rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(key(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    want = sorted((i, x, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids)
    got = sorted((key(r.doc_id), list(r.ids), r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want and len(got) > 100


@pytest.mark.parametrize("k", range(5))
def test_empty_documents(spark, folder, k):
    path, _ = folder
    none = spark.read.parquet(f"{path}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[k][1](spark, none, path).count() == 0
