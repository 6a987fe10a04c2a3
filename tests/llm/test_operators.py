"""Every operator against a brute-force version or the library it must equal, on rows with nulls, empty
and very long texts, ties, repeated rows, extra columns, and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, licenses, mph, packing, pivots, pretokens, quality, quantise, simhash, substring, tokenfile, urls
from plumbline.llm import textwords as T

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score double, task int, bucket int, id long, label int, raw string"


def docs(spark, rows):
    """Documents with further columns that bear the operators' own names."""
    return spark.createDataFrame([(i, t, 0.5, 7, 8, 9, 1, "x") for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [sentence(rng, 60) for _ in range(12)]
    shared = sentence(rng, 40)
    near = base[0].split()
    near[30] = "changed"
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, " ".join(near)), (22, base[3] + " " + shared + "\n" + base[4]), (23, shared + "  \t" + sentence(rng, 20)), (24, None), (25, ""), (26, " \n "), (27, "one two"), (28, "one two")]
    out += [(29, sentence(rng, 30_000)), (30, "naïve café 東京 İ Σσς é x\x1cy '’s it's 12 <|endoftext|>"), (None, base[5]), (3, base[3]), (31, (shared + " ") * 3), (32, "a a a a a a a a a a a a a a a a a a")]
    return out


EMPTY: list = []


# 1 and 4 and 6: tokens


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_perfect_hash():
    for n in (0, 1, 2, 3, 10, 1000, 5000):
        k = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        m = mph.build(k)
        assert sorted(m.slot(k).tolist()) == list(range(len(k)))
    with pytest.raises(ValueError):
        mph.build(np.array([1, 1], np.uint64))


def test_token_files(spark, rows):
    uri = common.place(spark, "t")
    tokenfile.write(docs(spark, rows), WORDS, uri)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read_digests(spark, uri).collect()), key=lambda r: r[2])
    enc, start, want = library(), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = enc(t) + [1]
        want.append((i is None, i or 0, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert tokenfile.lookup(spark, uri, 21).tolist() == enc(dict(rows)[21]) + [1]
    assert tokenfile.lookup(spark, uri, 999) is None


def test_token_files_of_nothing(spark):
    uri = common.place(spark, "t")
    tokenfile.write(docs(spark, EMPTY), WORDS, uri)
    assert tokenfile.read_digests(spark, uri).count() == 0


def check_pieces(got, rows, window):
    enc = library()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(enc(t) + [1])
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, lists in texts.items():
        ps = sorted(by_doc[i], key=lambda r: (r["doc_tokens"], r["start"]))
        assert sum(p["length"] for p in ps) == sum(map(len, lists))
        for p in ps:
            assert any(len(x) == p["doc_tokens"] and crc(x[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for x in lists)
            assert any(list(p["ids"]) == x[p["start"] : p["start"] + p["length"]] for x in lists)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for ps in by_seq.values():
        ps.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in ps] == list(itertools.accumulate([0] + [p["length"] for p in ps[:-1]]))
        n = sum(p["length"] for p in ps)
        assert n == window or n & (n - 1) == 0


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(spark, rows, window):
    check_pieces(packing.pack(docs(spark, rows), WORDS, window, with_ids=True).collect(), rows, window)


def test_packing_of_nothing(spark):
    assert packing.pack(docs(spark, EMPTY), WORDS).count() == 0


def test_packing_plan_fills_windows():
    rng = np.random.default_rng(1)
    have = np.bincount(rng.integers(1, 256, 20_000), minlength=256)
    p = packing.plan(have, 0, 256)
    assert p.share >= 0.9 and p.rest <= 0.1 * (have * np.arange(256)).sum() and (p.used <= have).all()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_packing_plan_of_real_lengths(sf):
    import pyarrow.parquet as pq

    text = pq.read_table(f"/root/testdata/sf{sf}/documents.parquet")["text"].combine_chunks()
    n = np.diff(pretokens.WordCoder(WORDS).encode(text, 1)[1])
    have = np.bincount(n % 2048, minlength=2048)
    p = packing.plan(have, 0, 2048)
    have[0] = 0
    assert p.share >= 0.9 and p.rest + round(p.share * (have * np.arange(2048)).sum()) == (have * np.arange(2048)).sum() and (p.used <= have).all()


def test_byte_bpe(spark, rows):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs(spark, rows), BYTES).collect())
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(docs(spark, rows[:9]), BYTES), BYTES).collect()}
    assert back == {i: (t or "").encode() for i, t in rows[:9]}
    assert bpe.digests(docs(spark, EMPTY), BYTES).count() == 0


def test_splitting_equals_the_pattern():
    import regex

    rng = random.Random(4)
    p = regex.compile(P.PATTERN)
    texts = ["".join(rng.choice("abS 'stmdreveLL1\n\t é.!東") for _ in range(25)) for _ in range(3000)] + ["", "'", " 's", "''s"]
    s, c, off = pretokens.codepoints(pa.array(texts))
    a, b = pretokens.split(c, off, False)
    assert [s[i:j] for i, j in zip(a, b)] == [m for x in texts for m in p.findall(x)]


# 7: substrings


def brute_substrings(rows, window):
    first, out = {}, []
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):  # nothing is smaller than no id
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i is None, i or 0, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 6, 3])
def test_substrings(spark, rows, window):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs(spark, rows), window).collect())
    assert got == brute_substrings(rows, window)


def test_substrings_keep_rows_and_columns(spark, rows):
    d = docs(spark, rows)
    got = substring.deduplicate(d)
    assert got.columns == [*d.columns, "n_removed"] and got.count() == len(rows)
    left = {r["doc_id"]: r["text"] for r in got.collect()}
    assert left[24] is None and left[25] == "" and left[26] == " \n " and left[1] == dict(rows)[1]
    assert left[20] == "" and WORD.findall(left[22]) == WORD.findall(dict(rows)[22])[60:100]
    assert substring.digests(docs(spark, EMPTY)).count() == 0


# 5: near duplicates


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i is not None and w:
            sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    low = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if low[a] != low[b] and any(5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b]):
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_near_duplicates(spark, rows):
    rng = random.Random(9)
    more = list(rows)
    for k in range(30):  # families of near copies
        base = sentence(rng, 80).split()
        for j in range(4):
            w = list(base)
            for _ in range(j):
                w[rng.randrange(80)] = "edit"
            more.append((100 + 10 * k + j, " ".join(w)))
    rng.shuffle(more)
    got = simhash.classes(docs(spark, more)).collect()
    low = brute_classes(more)
    assert len(got) == len(more)
    assert all(r["class_id"] is None for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == low
    kept = simhash.deduplicate(docs(spark, more))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({v for v in low.values()})
    assert kept.columns == docs(spark, EMPTY).columns and kept.where("doc_id is null").count() == 1


def families(rng, n, apart):
    out = []
    for k in range(n):
        base = sentence(rng, 120).split()
        for j in range(4):
            w = list(base)
            for _ in range(j):
                w[rng.randrange(120)] = "edit"
            out.append((apart * k + j, " ".join(w)))
    return out


@pytest.mark.parametrize("spread", ["least", "all"])
def test_near_duplicates_by_either_way(spark, monkeypatch, spread):
    monkeypatch.setattr(simhash, "SHARD", 40)
    rows, report = families(random.Random(12), 60, 10), {}
    got = {r["doc_id"]: r["class_id"] for r in simhash.classes(docs(spark, rows), report=report, spread=spread).collect()}
    assert got == brute_classes(rows) and report["recall"] >= 0.98 and report["audited"] > 50


def test_the_audit_adds_what_the_index_lost(spark, monkeypatch):
    """With a radius that finds nothing, the audit sees it, the search widens, and audited links are added."""
    monkeypatch.setattr(simhash, "WIDEST", -100)
    rows, report = families(random.Random(13), 20, 10), {}
    got = {r["doc_id"]: r["class_id"] for r in simhash.classes(docs(spark, rows), report=report, wider=-100).collect()}
    assert got == brute_classes(rows) and report["recall"] < 0.5  # all 80 documents are audited


def test_near_duplicates_in_blocks_and_full_beams(spark, monkeypatch):
    rng = random.Random(2)
    base = sentence(rng, 100).split()
    rows = []
    for i in range(150):  # one family larger than every beam, in shards of several blocks
        w = list(base)
        w[rng.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(simhash, "BLOCK", 40)
    got = simhash.classes(docs(spark, rows), width=4, limit=8)
    assert {r["class_id"] for r in got.collect()} == set(brute_classes(rows).values())


def test_graph_finds_what_exact_search_finds():
    rng = np.random.default_rng(0)
    sim = rng.integers(0, 2**63, (3000, 2)).astype(np.uint64)
    sim[2000:] = sim[:1000] ^ np.uint64(0b1011)
    anchor = np.concatenate([np.arange(2000), np.arange(1000)])
    g = simhash.Graph(sim, anchor, np.full(3000, 100), np.ones((3000, simhash.SKETCH), np.uint8), 3000)
    q, j, _, _ = g.run(16, 64)
    eq, ej, _ = g.exact(np.arange(3000), np.arange(3000))
    assert len(set(zip(eq, ej)) - set(zip(q, j))) <= 0.02 * len(eq)


def test_nothing_has_no_duplicates(spark):
    assert simhash.classes(docs(spark, EMPTY)).count() == 0 and simhash.deduplicate(docs(spark, EMPTY)).count() == 0


def test_components(spark):
    e = [(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (None, 1)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7} | {k: 100 for k in range(100, 141)}


# 9: quality


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 9])
    z, good, _ = quality.forward_backward(emit, trans, first)
    for t in range(3):
        e = emit[first[t] : first[t + 1]]
        total, marg = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            p = np.exp(sum(e[i, v] for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += p
            marg += p * np.array(y)
        assert np.isclose(z[t], np.log(total)) and np.allclose(good[first[t] : first[t + 1]], marg / total)


def test_quality(spark, rows):
    rng = random.Random(5)
    data, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = [sentence(rng, 20) if not bad else " | ".join(sentence(rng, 12).split()) + "%%%" for _ in range(5)]
        data.append((i, "\n".join(w)))
        labels.append((i, 0 if bad else 1))
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (999, 1), (7, 1)], "doc_id long, quality int")
    data += [(1000, None), (1001, ""), (None, "text"), (1002, sentence(rng, 20_000)), (1000, None)]
    got = quality.classify(docs(spark, data), lab).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert np.mean([r["predicted"] == dict(labels)[r["doc_id"]] for r in held]) > 0.97
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]  # held-out labels are not read
    again = quality.classify(docs(spark, data), spark.createDataFrame(flipped, "doc_id long, quality int")).collect()
    assert sorted(r["score"] for r in again) == sorted(r["score"] for r in got)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert quality.classify(docs(spark, EMPTY), none).count() == 0


# 2 and 10: vectors


def vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:140] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[140:150] = x[1] * np.arange(1, 11)[:, None]
    x[150] = x[2]
    rows = [(int(i), [float(v) for v in r], 3, 4) for i, r in enumerate(x)]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [1.0, 2.0]), (405, []), (None, [1.0] * 16), (406, [float("inf")] * 16)]
    rows += [(i, v, 3, 4) for i, v in odd] + [rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, w int, key int"), x.astype(np.float64)


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = u @ u.T >= 0.95
    np.fill_diagonal(a, False)
    low = np.arange(300)
    while True:
        new = np.array([min([low[i], *low[a[i]]]) for i in range(300)])
        if (new == low).all():
            break
        low = new
    got = {r["vec_id"]: r for r in pivots.near_duplicates(df, pivots=64).collect()}
    assert len(got) == 308
    assert [got[i]["n_links"] for i in range(300)] == a.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(300)] == low.tolist()
    assert all(got[i]["kept"] == (low[i] == i) for i in range(300))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(400, 407)) and got[None]["kept"] is False


def hot_vectors(spark, n=2400):
    """A third are noisy copies of one vector, at cosines of 0.97 or so; the others are random. Some
    of the copies occur twice more, and the largest ids are equal copies of another vector."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x[: n // 3] = x[0] + 0.17 * x[: n // 3]
    x[n - 300 : n - 200] = x[50:150]
    x[n - 100 :] = x[n - 101]
    x = x[rng.permutation(n)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), x.astype(np.float64)


def test_vector_links_in_a_hot_group(spark):
    df, x = hot_vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = u @ u.T >= 0.95
    np.fill_diagonal(a, False)
    got = {r["vec_id"]: r for r in pivots.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == a.sum(axis=1).tolist()
    low = np.arange(len(x))
    while True:
        new = np.array([min([low[i], *low[a[i]]]) for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()


def test_vector_links_with_many_pivots(spark):
    rng = np.random.default_rng(23)
    n = 10_000
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x[5000:7500] = x[:2500] + 0.2 * rng.normal(size=(2500, 64))
    x[7500:8500] = x[:1000] + 0.3 * rng.normal(size=(1000, 64))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(df).collect()}
    assert want.sum() > 5000 and all(got[i] <= want[i] for i in range(n)) and sum(got.values()) >= 0.98 * want.sum()


def test_vectors_few_or_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.near_duplicates(empty).count() == 0 and quantise.nearest(empty, "vec_id >= 0").count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in pivots.near_duplicates(two).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    got = quantise.nearest(two, "vec_id = 1").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 0.0)]


def test_nearest(spark):
    df, x = vectors(spark)
    got = quantise.nearest(df, "vec_id % 10 = 0").collect()
    hit = n = 0
    for q in range(0, 300, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(300), d))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(r[2] == d[r[1]] for r in own)
        hit += len(set(want.tolist()) & {r[1] for r in own})
        n += 10
    assert hit >= 0.9 * n and not {r["query_id"] for r in got} & {400, 401, 402, 403, 404, 405, 406}


def test_nearest_in_a_hot_group(spark):
    df, x = hot_vectors(spark)
    got = {}
    for r in quantise.nearest(df, "vec_id % 40 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, len(x), 40))
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        assert sorted(own) == [(n + 1, i, d[i]) for n, i in enumerate(want.tolist())]


def test_nearest_of_many_partitions(spark):
    """Three partitions and more, of which the quantiser's shortlists hold a small part."""
    rng = np.random.default_rng(29)
    n = 13_000
    x = (rng.normal(size=(60, 64))[rng.integers(0, 60, n)] + 0.7 * rng.normal(size=(n, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in quantise.nearest(df, "vec_id % 100 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x, hit = x.astype(np.float64), 0
    for q in range(0, n, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(n), d))[:10].tolist()))
    assert hit >= 0.95 * 10 * len(got)


# 3: licenses


def test_licenses(spark):
    rng = random.Random(1)
    mit = licenses.TEMPLATES["mit-permission"]
    words = mit.split()
    changed = " ".join(["other", *words[1:]])
    rows = [(1, sentence(rng, 300) + "\n" + mit.upper() + " " + sentence(rng, 40)), (2, changed), (3, " ".join(words[: len(words) // 2])), (4, None), (5, ""), (6, "Released under the MIT License"), (7, "released, under THE mit (license)!"), (8, sentence(rng, 30_000)), (1, mit), (None, mit)]
    got = sorted((r["doc_id"] or 0, r["license"], r["containment"] == 1) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(0, "mit-permission", True), (1, "mit-permission", True), (1, "mit-permission", True), (2, "mit-permission", False), (6, "mit", True), (7, "mit", True)]
    assert licenses.scan(docs(spark, EMPTY)).count() == 0 and licenses.scan(docs(spark, rows), {}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, rows), {"short": "too short"})


# 8: URLs


@pytest.mark.parametrize("limit", [200_000, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", limit)
    ev = spark.createDataFrame(
        [("Bad.com", "block", "2024-01-05"), ("bad.com", "remove", "2024-01-10"), ("ok.bad.com", "allow", "2024-01-01"), ("x.org/p", "block", "2024-01-02"), ("x.org", "allow", "2024-01-01"), (None, "block", "2024-01-01"), ("y.org", "odd", "2024-01-01"), ("z.org", "block", "2024-01-03"), ("z.org", "remove", "2024-01-03")],
        "entry string, action string, day string",
    ).selectExpr("entry", "action", "cast(day as date) day")
    caps = [(1, "http://a.bad.com/", "2024-01-04"), (2, "http://a.bad.com/", "2024-01-05"), (3, "HTTPS://u@A.BAD.com.:80/q", "2024-01-09"), (4, "http://bad.com", "2024-01-10"), (5, "http://ok.bad.com/x", "2024-01-06"), (6, "http://x.org/P/1?a", "2024-01-06"), (7, "http://x.org/q", "2024-01-06"), (8, None, "2024-01-06"), (9, "", "2024-01-06"), (10, "no url", "2024-01-06"), (11, "http://a.bad.com/", None), (12, "http://z.org", "2024-01-04"), (2, "http://a.bad.com/", "2024-01-05"), (None, "http://bad.com", "2024-01-06")]
    df = spark.createDataFrame(caps, "page_id long, url string, day string").selectExpr("*", "1 as entry", "2 as action", "3 as salt")
    got = {(r["page_id"], r["url"]): (r["decision"], r["n_rows"]) for r in urls.judge(df, ev).collect()}
    want = {1: "none", 2: "block", 3: "block", 4: "none", 5: "allow", 6: "block", 7: "allow", 8: "none", 9: "none", 10: "none", 11: "none", 12: "none", None: "block"}
    assert {k[0]: v[0] for k, v in got.items()} == want and got[(2, "http://a.bad.com/")][1] == 2
    assert urls.judge(df.limit(0), ev).count() == 0 and urls.judge(df, ev.limit(0)).where("decision <> 'none'").count() == 0


# words


def test_words_and_windows():
    texts = ["", None, " a  b\tc\n", "é ü", "a b c d e f", "x"]
    w = T.of(pa.array(texts))
    assert w.n_words.tolist() == [len(WORD.findall(t or "")) for t in texts]
    h, ok = w.windows(3)
    assert ok.sum() == 1 + 4
    for lo, hi in ((0, 3), (2, 9), (8, len(h))):
        part, fits = w.windows(3, lo, hi)
        assert (part[fits] == h[lo:hi][ok[lo:hi]]).all() and (fits == ok[lo:hi]).all()
    _, count = w.shingles(5)
    assert count.tolist() == [0, 0, 1, 1, 2, 1]
    assert list(T.chunks(pa.array(["aaaa", "b", None, "cc"]), 4)) == [(0, 1), (1, 4)]


def test_bit_set_has_no_false_negatives(spark):
    ids = spark.range(0, 500).selectExpr("id * 7 as k")
    df = spark.range(0, 4000).selectExpr("id", "'x' as __word", "1 as __AT", "2 as __mask").unionByName(spark.sql("select cast(null as long) as id, 'y' as __word, 1 as __AT, 2 as __mask"))
    got = common.with_hit(df, "id", common.bits(ids, "k"), "hit")
    assert got.columns == ["id", "__word", "__AT", "__mask", "hit"] and {r["__mask"] for r in got.collect()} == {2}
    hits = {r["id"] for r in got.where("hit").collect()}
    assert {7 * i for i in range(500)} <= hits and None not in hits and len(hits) < 520


def test_url_paths_of_any_depth_and_parents(spark):
    events = spark.createDataFrame([("x.org/a/b", "block", "2024-01-01"), ("bad.com/p", "block", "2024-01-01")], "entry string, action string, day string").withColumn("day", F.to_date("day"))
    pages = ["https://x.org/a/b/c?q", "https://x.org/a/bc", "https://x.org/a", "http://www.bad.com/p", "http://bad.com/p/q", "http://bad.com/q"]
    df = spark.createDataFrame([(i, u, "2024-01-05") for i, u in enumerate(pages)], "page_id long, url string, day string").withColumn("day", F.to_date("day"))
    got = {r["page_id"]: (r["decision"], r["entry"]) for r in urls.judge(df, events).collect()}
    a, b, none = ("block", "x.org/a/b"), ("block", "bad.com/p"), ("none", None)
    assert got == {0: a, 1: none, 2: none, 3: b, 4: b, 5: none}


# what only equal bytes may make equal


def mirrored(n=2048):
    """A Thue-Morse word and its complement: every polynomial hash modulo a power of two takes them for equal."""
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


def test_words_that_fool_polynomials(spark):
    import tiktoken

    a, b = mirrored()
    texts = pa.array([a, b, f"x {b} {a}"])
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    coder = bpe.ByteCoder(BYTES)
    ids, cut = coder.encode(texts)
    for x, i, j in zip(texts.to_pylist(), cut, cut[1:]):
        assert ids[i:j].tolist() == enc.encode_ordinary(x) and coder.decode(ids[i:j].tolist()).decode() == x
    lib = library()
    ids, cut = pretokens.WordCoder(WORDS).encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(cut, cut[1:])] == [lib(x) for x in texts.to_pylist()]
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}"), (4, " ".join(a)), (5, " ".join(b))]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs(spark, rows)).collect())
    assert got == brute_substrings(rows, 13) and [r[3] for r in got[:3]] == [0, 0, 13]
    found = {r["doc_id"]: r["class_id"] for r in simhash.classes(docs(spark, [(1, a), (2, b), (3, a), (6, " ".join(a + a)), (7, " ".join(b + b))])).collect()}
    assert found[2] == 2 and found[3] == 1
    w = T.of(pa.array([a, b, " ".join(a), " ".join(b)]))
    assert len(set(w.whole().tolist())) == 4 and len(set(w.whole(1).tolist())) == 4
    assert licenses.scan(docs(spark, [(1, f"a b c d {a}")]), {"x": f"a b c d {b}"}).count() == 0


def test_equal_hashes_of_different_words(monkeypatch):
    """With a hash that is worth nothing, ids are still right: bytes decide."""
    texts = pa.array(["the cat and the dog", "a b c 12 ab abc", "東京 é the naïve"])
    want = pretokens.WordCoder(WORDS).encode(texts)[0].tolist()
    monkeypatch.setattr(T, "hashed", lambda data, start, size, lane=0: (size % 3).astype(np.uint64))
    assert pretokens.WordCoder(WORDS).encode(texts)[0].tolist() == want


@pytest.mark.parametrize("piece", [20, 2 << 20])
def test_special_tokens_and_pieces(monkeypatch, piece):
    import tiktoken

    monkeypatch.setattr(pretokens, "PIECE", piece)
    rng = random.Random(8)
    texts = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>a<|endoftext|", "don<|endoftext|>'t", "a <|endoftext|>\u0301b", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(["a", "b ", " ", "\n", "'s", "1", "é", "東", "<|endoftext|>", "!?", "\x1c", "  "]) for _ in range(60)) for _ in range(200)]
    lib, enc = library(), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    for coder, want in ((pretokens.WordCoder(WORDS), lib), (bpe.ByteCoder(BYTES), enc.encode_ordinary)):
        ids, cut = coder.encode(pa.array(texts))
        for x, i, j in zip(texts, cut, cut[1:]):
            assert ids[i:j].tolist() == want(x)
    assert 49407 in lib(texts[0])


def test_the_largest_id_is_an_id(spark):
    top = 2**63 - 1
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(top, text), (None, text), (3, text), (None, text), (-(2**63), "x")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substring.digests(docs(spark, rows)).collect())
    assert got == [(False, -(2**63), 0), (False, 3, 0), (False, top, 20), (True, 0, 0), (True, 0, 0)]
    uri = common.place(spark, "t")
    tokenfile.write(docs(spark, rows), WORDS, uri)
    read = sorted((r["start"], r["doc_id"]) for r in tokenfile.read_digests(spark, uri).collect())
    assert [i for _, i in read] == [-(2**63), 3, top, None, None]
    assert tokenfile.lookup(spark, uri, top).tolist() == library()(text) + [1]


def test_columns_with_the_operators_own_names(spark):
    text = " ".join(f"w{i}" for i in range(20))
    names = ["__at", "__mask", "__word", "__hit", "hit", "gone", "__gone", "score", "__score", "n_removed", "__n_removed", "class_id", "shard", "task"]
    df = spark.createDataFrame([(1, text, *names), (2, text, *names), (3, "other text of its own", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in df.where("doc_id <> 2").collect())
    cut = substring.deduplicate(df)
    assert cut.columns == [*df.columns, "_n_removed"] and {r["doc_id"]: r["_n_removed"] for r in cut.collect()} == {1: 0, 2: 20, 3: 0}
    field = quality.fit_rows(np.zeros((0, 17)), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    scored = quality.scored(df, field)
    assert scored.columns == [*df.columns, "_score"] and {r["score"] for r in scored.collect()} == {"score"}


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": lambda self: Conf(), "master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        common.shared(Cluster())


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_LINKS", 0)
    test_components(spark)
