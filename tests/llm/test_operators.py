"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import json
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from maskwright.llm import bpe, exact_dedup, fingerprints, induced_sort, jaccard_join, line_dedup, mixing, substring_dedup, suffix_dedup, token_files, toxicity
from maskwright.llm.common import NULL_ID, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, told binary, n long, key string"


def texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, shared, long = make(200), make(60), make(6000)
    near = base.split()
    near[7] = "other"
    line = "  A Common Line of text\t"
    out = [make(rng.randint(1, 120)) for _ in range(20)]
    out += [None, "", " \n\t", base, base, base, " ".join(near), long, long[5000:] + " x", make(3) + " " + shared, shared + " " + make(40), f"{line}\n{make(4)}\nshort\n{line}", f"{make(5)}\n{line.lower().strip()}\nshort", "same same " * 80, "one two", "ONE two"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 101, t, "en", f"s{k % 3}" if k % 4 else None, None, b"", 1, "k") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_exact(docs, rows):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, keep="largest").collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for i, t in rows:
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(groups[t]), len(groups[t]), i == max(groups[t]), sha(t))
    twice = exact_dedup.exact_dedup(docs.unionByName(docs)).collect()
    assert sum(r.kept for r in twice) == len(groups)


def test_lines_and_deletion(spark, docs, rows):
    def brute(some):
        held = collections.defaultdict(set)
        key = lambda x: line_dedup.line_key(x.encode())
        for i, t in some:
            for x in t.split("\n"):
                if len(key(x).decode()) >= 10:
                    held[key(x)].add(i)
        return {i: sha("\n".join(x for x in t.split("\n") if not (len(held[key(x)]) > 1 and i > min(held[key(x)])))) for i, t in some}

    index = line_dedup.LineIndex(spark, shards=3)
    assert {r.doc_id: r.kept_sha256 for r in index.insert(docs).collect()} == brute(rows)
    # In two batches, and after a deletion, the smallest holder left counts.
    two = line_dedup.LineIndex(spark, shards=3)
    two.insert(docs.where("doc_id % 2 = 0")).count()
    two.delete(docs.where("doc_id % 4 = 0").select("doc_id"))
    got = {r.doc_id: r.kept_sha256 for r in two.insert(docs.where("doc_id % 2 = 1")).collect()}
    left = {i: t for i, t in rows if i % 4 != 0}
    held = collections.defaultdict(set)
    for i, t in left.items():
        for x in t.split("\n"):
            held[line_dedup.line_key(x.encode())].add(i)
    for i, t in left.items():
        if i % 2:
            k = line_dedup.line_key
            assert got[i] == sha("\n".join(x for x in t.split("\n") if not (len(k(x.encode()).decode()) >= 10 and i > min(held[k(x.encode())]))))


def holders(rows):
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            key = line_dedup.line_key(x.encode())
            if len(key.decode()) >= 10:
                held[key].add(i)
    return held


def lines_left(rows):
    held = holders(rows)
    gone = lambda i, x: len(held.get(line_dedup.line_key(x.encode()), ())) > 1 and i > min(held[line_dedup.line_key(x.encode())])
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in rows}


@pytest.mark.parametrize("batches", [1, 4])
def test_lines_in_batches(docs, rows, batches):
    got = {r.doc_id: (r.n_lines, r.text) for r in line_dedup.dedup_lines(docs, batches=batches).collect()}
    left = lines_left(rows)
    assert got == {i: (len(t.split("\n")), left[i]) for i, t in rows}


def test_index_is_reopened(spark):
    some = [(1, "a common line here\nx"), (2, "a common line here\ny"), (5, "a common line here\nanother line of text"), (None, None)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=2)
    index.insert(docs.where("doc_id > 1")).count()
    again = line_dedup.LineIndex(spark, index.path)
    assert (again.shards, again.generations, again.filters) == (2, index.generations, index.filters)
    mark = len(again.generations)
    again.insert(docs.where("doc_id = 1 or doc_id is null")).count()
    # The smaller holder takes the line from 2; 5 had lost it before.
    assert [r.doc_id for r in again.affected(mark).collect()] == [2]
    assert {r.doc_id: r.text for r in again.render(docs.where("doc_id > 1")).collect()} == {2: "y", 5: "another line of text"}
    again.delete(spark.createDataFrame([(1,), (2,), (77,)], "doc_id long"))
    last = line_dedup.LineIndex(spark, index.path)
    assert [r.doc_id for r in last.affected(mark).collect()] == [5] and last.render(docs.where("doc_id = 5")).first().text == some[2][1]
    last.insert(docs.where("false")).count()
    assert last.render(docs.where("doc_id = 5")).first().text == some[2][1]


def test_full_filter_grows(spark):
    index = line_dedup.LineIndex(spark, shards=1)
    one = lambda i, k: spark.createDataFrame([(i, "\n".join(f"line number {x:06d}" for x in range(k)))], "doc_id long, text string")
    index.insert(one(1, 10)).count()
    assert index.insert(one(2, 3000)).first().n_dropped == 10 and index.insert(one(3, 4000)).first().n_dropped == 3000


def test_cuckoo_filter():
    keys = np.arange(20_000, dtype=np.int64) * 7919
    f = line_dedup.CuckooFilter.build(keys)
    assert f.contains(keys).all() and f.contains(keys + 1).mean() < 0.01
    f.remove(keys[:500])
    assert f.contains(keys[500:]).all() and f.contains(keys[:500]).mean() < 0.05


def test_false_hit_has_its_own_fingerprint(spark):
    lines = [f"a line with number {k}" for k in range(30_000)]
    h1 = np.array([np.frombuffer(line_dedup.key_hash(x.encode()), "<i8")[0] for x in lines])
    one = line_dedup.CuckooFilter(64)
    f, b = one._finger(h1)
    pairs = collections.defaultdict(list)
    for k, at in enumerate(zip(f.tolist(), np.minimum(b, one._other(b, f)).tolist())):
        pairs[at].append(lines[k])
    x, y = next(p for p in pairs.values() if len(p) > 1)[:2]
    # Either of two lines that share a fingerprint goes; the other one is found all the same.
    for gone, stays, other in ((1, 2, y), (2, 1, x)):
        index = line_dedup.LineIndex(spark, shards=1)
        for i, t in ((1, x), (2, y)):
            assert index.insert(spark.createDataFrame([(i, t)], "doc_id long, text string")).first().n_dropped == 0
        index.delete(spark.createDataFrame([(gone,)], "doc_id long"))
        assert index.insert(spark.createDataFrame([(3, f"{other}\n{x if other == y else y}")], "doc_id long, text string")).first().text == (x if other == y else y), stays


def test_mixing(docs, rows):
    got = mixing.mix_to_weights(docs).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[(r.source is None, r.source or "")][0] += r.size
        by[(r.source is None, r.source or "")][1] += r.taken
        by[(r.source is None, r.source or "")][2] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(by)
    targets = mixing.brute_targets([by[k][0] for k in order], [1 + k % 3 for k in range(len(order))])
    for k, t in zip(order, targets):
        assert abs(by[k][2] - t) < 1e-6 * max(1, t) and abs(by[k][1] - t) <= 0.5 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_to_weights(docs.repartition(7)).collect()))


def linked(rows):
    """(id, size of the set, smallest id of the class) by row; null ids as the smallest."""

    def shingle(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingle(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b):
                c = len(sets[a] & sets[b])
                if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    parent[find(a)] = find(b)
    ids = [NULL_ID if i is None else i for i, _ in rows]
    least = collections.defaultdict(lambda: 2**63)
    for k in range(len(rows)):
        least[find(k)] = min(least[find(k)], ids[k])
    return sorted((ids[k], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def components(out):
    return sorted((NULL_ID if r.doc_id is None else r.doc_id, r.n_shingles, NULL_ID if r.component_id is None else r.component_id) for r in out.collect())


def test_jaccard(docs, rows):
    want = linked(rows)
    assert components(jaccard_join.jaccard_join(docs)) == want and len({w[2] for w in want}) < len(want)


def test_large_group_of_unequal_copies(spark):
    """Drafts that follow each other, near copies of one text, and texts that share half of it: one region, far beyond a cell."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    some, now = [], base
    for k in range(50):
        now = list(now)
        for _ in range(rng.randint(0, 3)):
            now[rng.randrange(120)] = f"z{rng.randint(0, 10**6)}"
        some.append((1000 + k, " ".join(now)))
    for k in range(90):
        own = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6])):
            own[rng.randrange(120)] = f"y{rng.randint(0, 10**6)}"
        some.append((2000 + k, " ".join(own)))
    some += [(3000 + k, " ".join(base[:100] + [f"t{k}x{j % 3 + k % 7}" for j in range(14)])) for k in range(40)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert components(jaccard_join.jaccard_join(docs, cell=60)) == linked(some)


def thue_morse():
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    a = "".join("ab"[b] for b in bits)
    return a, a.translate(str.maketrans("ab", "ba"))


def test_no_algebraic_collisions(spark):
    a, b = thue_morse()
    rest = " ".join(f"x{k}" for k in range(34))
    one = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert components(jaccard_join.jaccard_join(one)) == [(1, 1, 1), (2, 1, 2)]
    two = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(two).collect()} == {0}


ODD = [(None, 5), (None, 22), (None, 0), (3, 23), (3, 24), (6, 7)]


@pytest.fixture(scope="module")
def odd(spark, docs):
    """(rows, table): also rows whose ids are null or repeat, with texts of other rows and texts of their own."""
    more = [(i, texts()[k]) for i, k in ODD] + [(None, "a text of its own " + " ".join(f"u{k}" for k in range(60)))]
    own = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()] + [(i, t or "") for i, t in more]
    return own, docs.unionByName(spark.createDataFrame([(i, t, "en", None, None, b"", 1, "k") for i, t in more], SCHEMA))


def test_jaccard_null_and_repeated_ids(odd):
    assert components(jaccard_join.jaccard_join(odd[1])) == linked(odd[0])


def test_region_with_pivots():
    rng = np.random.default_rng(0)
    base = np.sort(rng.choice(2**40, 300, replace=False)).astype(np.uint64)
    sets = []
    for k in range(120):
        own = base.copy()
        own[rng.choice(300, rng.integers(0, 45), replace=False)] = rng.integers(2**41, 2**50, 1)[0] + np.uint64(k)
        sets.append(np.unique(own))
    got = jaccard_join.Region(np.array([len(s) for s in sets]), sets).classes()
    parent = list(range(120))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(120):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = [find(i) for i in range(120)]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(120) for j in range(i))


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)

    def alike(a, b):
        """Of the 64 smallest names of both, the share that both have."""
        a, b = ({x[k : k + 8] for k in range(0, len(x), 8)} for x in (a, b))
        least = sorted(a | b)[: fingerprints.KEEP]
        return sum(x in a and x in b for x in least) / len(least) if least else 1.0

    for (i, t), (j, nxt) in zip(rows, [*rows[1:], rows[0]]):
        cut = len(t) // 4
        assert got[i].edited_sha256 == sha(t[: len(t) - cut] + nxt[:cut]) and got[i].n_chars == len(t)
        assert got[i].fingerprint == "".join(sorted({f"{x >> 32:08x}" for x in slow_phrases(t.encode())})[: fingerprints.KEEP])
        assert got[i].edited_fingerprint == "".join(sorted({f"{x >> 32:08x}" for x in slow_phrases((t[: len(t) - cut] + nxt[:cut]).encode())})[: fingerprints.KEEP])
        assert abs(got[i].near_edited - alike(got[i].fingerprint, got[i].edited_fingerprint)) < 1e-12 and abs(got[i].near_next - alike(got[i].fingerprint, got[j].fingerprint)) < 1e-12
    assert np.mean([got[i].near_edited - got[i].near_next for i, t in rows if len(t) > 300]) > 0.3


def slow_phrases(raw: bytes) -> list[int]:
    """The names of the last two levels, one symbol at a time."""
    m64 = 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    def toss(c, bits):
        out = []
        for k, x in enumerate(c):
            left = c[k - 1] if k else ~x & (2**bits - 1)
            low = ((x ^ left) & -(x ^ left)).bit_length() - 1
            out.append(2 * low + (x >> low & 1))
        return out

    names, upper, r = list(raw), [], 0x9E3779B97F4A7C15
    for level in range(fingerprints.LEVELS if raw else 0):
        runs = [(x, len(list(g))) for x, g in itertools.groupby(names)]
        wide = [mix(x + 1) if level == 0 else x for x, _ in runs]
        wide = [mix(w + r * n & m64) if n > 1 else w for w, (_, n) in zip(wide, runs)]
        c = toss([x for x, _ in runs], 8) if level == 0 else toss(wide, 64)
        c = toss(toss(c, 8), 8)
        starts = [0] + [k for k in range(1, len(c) - 1) if c[k] < c[k - 1] and c[k] <= c[k + 1]]
        names = []
        for a, b in zip(starts, [*starts[1:], len(c)]):
            total = sum(mix(w) * pow(r | 1, k, 2**64) for k, w in enumerate(wide[a:b]))
            names.append(mix((total + b - a) & m64))
        if level >= fingerprints.LEVELS - 2:
            upper += names
    return upper


def test_equal_substrings_share_their_phrases():
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"abcdefghij klmnop") for _ in range(n))
    shared = word(3000)
    inside = [set(slow_phrases(word(k) + shared + word(2 * k))) for k in (0, 1, 7, 333)]
    assert all(len(inside[0] & x) > 0.9 * len(set(slow_phrases(shared))) for x in inside)


def words_left(rows):
    own = [(NULL_ID if i is None else i, t.encode().split()) for i, t in rows]
    count = collections.Counter(tuple(w[k : k + 35]) for _, w in own for k in range(len(w) - 34))
    out = []
    for i, w in own:
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


@pytest.mark.parametrize("weak", [0, 52])
def test_words(spark, odd, weak):
    """weak: with hashes of 12 bits, so that most claims are wrong and are opened."""
    periodic = [(501, "a " * 60), (502, "p q " * 80), (503, "p q " * 30)]
    rows, table = odd[0] + periodic, odd[1].select("doc_id", "text").unionByName(spark.createDataFrame(periodic, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(table, weak=weak).collect())
    assert got == words_left(rows)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n, a in ((1, 2), (40, 2), (400, 3), (900, 30), (300, 1)):
        t = np.r_[rng.integers(1, a + 1, n), 0].astype(np.uint16)
        for budget in (10**9, 100):  # the second spills
            assert induced_sort.suffix_order(t, 10**6, budget).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def bytes_left(rows):
    own = [(NULL_ID if i is None else i, t.encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, raw in own:
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(first.get(raw[k : k + 50], 2**63), i)
    out = []
    for i, raw in own:
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                hit[k : k + 50] = True
        out.append((i, len(raw), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), sha(bytes(np.frombuffer(raw, np.uint8)[~hit]))))
    return sorted(out)


def test_bytes(odd):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(odd[1]).collect())
    assert got == bytes_left(odd[0])


def test_shard_beyond_its_limit():
    """A phrase of 40 bytes, one minimizer, with neighbours of its own in each of many texts: the shard is cut anew and sorted in passes."""
    rng = random.Random(1)
    some = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 60))) + b"the same common phrase of forty bytes..." + bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    some = [x for x in some + some[5:7] if len(x) >= 50]
    text, sizes, ids = np.frombuffer(b"".join(some), np.uint8), np.array([len(x) for x in some]), np.array([rng.randint(0, 250) for _ in some])
    first: dict[bytes, int] = {}
    for x, i in zip(some, ids):
        for k in range(len(x) - 49):
            first[x[k : k + 50]] = min(first.get(x[k : k + 50], 10**9), i)
    want = [first[x[k : k + 50]] < i for x, i in zip(some, ids) for k in range(len(x) - 49)]
    for limit in (10**9, 4000, 1000, 100):
        assert suffix_dedup.later_windows(text, np.cumsum(sizes) - sizes, sizes - 49, ids, 50, limit).tolist() == want


def test_token_files(spark, docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_shards(docs, scratch_path(spark, "test"), tokenizer=path, end_id=1)
    got = {r.doc_id: r for r in token_files.read_token_shards(manifest).collect()}
    library, start = Tokenizer.from_file(path), 0
    for i, t in rows:
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        assert (got[i].start, got[i].n_tokens) == (start, n)
        start += n
    store, name = token_files._store(manifest.first().path)
    with store.open_input_file(name) as f:
        shard = token_files.ShardReader(f)
        assert shard.document(int(shard.ids[0])).tolist()[-1] == 1


def test_word_encoder_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), token_files.WordEncoder(path), random.Random(3)
    alphabet = [*"ab'S \t\n\r\f\v.,12é한\x1c\x85\xa0🙂\x01", "<|endoftext|>", "<|startoftext|>", " the "]
    texts = ["", "  ", "\n", "same same", "same same", "x" * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    own.encode(pa.array(texts[700:]))  # half of the words are remembered
    for t, raw in zip(texts, own.encode(pa.array(["before", *texts]).slice(1)), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_damaged_frame(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        w = token_files.ShardWriter(f, 2)
        w.add(1, b"abcd" * 50)
        w.close()
    raw = bytearray((tmp_path / "x").read_bytes())
    raw[-25] ^= 1  # the frame's checksum in the seek table
    (tmp_path / "x").write_bytes(raw)
    with pytest.raises(ValueError):
        token_files.ShardReader(open(tmp_path / "x", "rb")).read(0)


def test_bpe(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.model(path)
    rng = random.Random(2)
    more = ["".join(rng.choice("ab c'd\n\té🙂12 .,\x1c\xa0thes") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["<|endoftext|>x", "a" * 3000]
    for t in [*(t for _, t in rows), *more]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_decode(docs, tokenizer=path, with_ids=True).collect()}
    for i, t in rows:
        assert got[i].ids == library.encode(t, add_special_tokens=False).ids and got[i].decoded_sha256 == sha(t)


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.score(docs.join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id").select("doc_id", "text", "y"), model).collect()
    toxic, clean = [r.toxic for r in held if r.y == 1], [r.toxic for r in held if r.y == 0]
    assert len(toxic) > 5 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01
    assert all(0 <= r.expected_severity <= toxicity.LEVELS for r in held) and np.all(np.diff(model.thresholds) > 0)
    # By hand, from the weights: a word counts once, a stem by its density.
    for r in held[:50]:
        words, stems, n = toxicity.features(r.text)
        m = sum(model.weights.get(xxhash.xxh3_64_intdigest(w), 0.0) for w in words)
        m += sum(model.weights.get(xxhash.xxh3_64_intdigest(x, 1), 0.0) * float(toxicity.density(k, n)) for x, k in stems.items())
        assert abs(r.toxic_probability - 1 / (1 + np.exp(model.thresholds[0] - m))) < 1e-9
    odd = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "word " * 200_000, 7)], "doc_id long, text string, TOXIC int")
    assert [r.toxic for r in toxicity.score(odd, model).collect()] == [False] * 3


def test_odd_labels(spark):
    docs = spark.createDataFrame([(k, f"bad{k % 2} word") for k in range(40)] + [(None, "bad1")], "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows, want in (([], False), ([(k, 1, 0) for k in range(40)], False), ([(k, 1, 1) for k in range(40)], True), ([(None, 1, 1), (1, 1, None), (999, 1, 1)], False)):
        model = toxicity.train(docs, label(rows))
        assert {r.toxic for r in toxicity.score(docs, model).collect()} == {want}
    # Labelled twice: toxic if any label says so.
    model = toxicity.train(docs, label([(k, 1, k % 2) for k in range(40)] + [(k, 1, 0) for k in range(40)] + [(1, 1, None)]))
    assert all(r.toxic == r.text.startswith("bad1") for r in toxicity.score(docs, model).collect())
    assert toxicity.train(docs, label([(k, 1, k % 2) for k in range(40)]), sample_bytes=5).weights == {}


EVERY = {
    "op1": line_dedup.dedup_lines, "op2": mixing.mix_to_weights, "op3": jaccard_join.jaccard_join, "op4": exact_dedup.exact_dedup, "op5": fingerprints.fingerprints, "op6": substring_dedup.substring_dedup, "op7": suffix_dedup.suffix_dedup,
    "op8": lambda docs: token_files.read_token_shards(token_files.write_token_shards(docs, scratch_path(docs.sparkSession, "test"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1)),
    "op9": lambda docs: bpe.encode_decode(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json")),
    "op10": lambda docs: toxicity.score(docs, toxicity.OrdinalModel({}, np.array([1.0, 2.0, 3.0]))),
}


@pytest.mark.parametrize("name", EVERY)
def test_empty_table(docs, name):
    assert EVERY[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", EVERY)
def test_null_and_repeated_ids_keep_their_rows(odd, name):
    assert EVERY[name](odd[1]).count() == len(odd[0])


def test_tokenizer_files_that_ask_for_more(tmp_path):
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    for key, value in (("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}), ("pre_tokenizer", {"type": "Whitespace"})):
        (tmp_path / "t.json").write_text(json.dumps(spec | {key: value}))
        with pytest.raises(ValueError):
            bpe.Bpe(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
