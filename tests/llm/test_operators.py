"""The training-text operators against brute force, round trips and their edge cases."""

import hashlib
import itertools
import re
import shutil
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import bpe, decontaminate, dedup, idstore, licenses, pii, quality, registry, sharding, toxicity, webp
from kinloom.llm import text as tx
from kinloom.llm.registry import tokenizer_path

from ..conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, cid long, key long, size long"
LONG = " ".join(f"w{k}" for k in range(40_000))
ODD = [None, "", " ", "a", "one two", "Ünïcode déjà vu", "x" * 5000, LONG, "same text here it is now", "same text here it is now", "\n\n", "1 2 3", "\x00\x1c\x85 odd", "日本語 テキスト", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use themselves."""
    rows = [(k, t, None if k % 3 == 0 else "en", None, None, "x", 1, 2, 3) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", "en", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(text, n=5):
    w = words(text)
    return Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else Counter()


def similarity(a, b):
    if not a or not b:
        return float(not a and not b)
    x, y = ({k: 1 + np.log(n) / 4 for k, n in c.items()} for c in (a, b))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})


# near-duplicates


def test_classes_against_all_pairs(spark, docs):
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if (texts[a].keys() & texts[b].keys() or not texts[a]) and similarity(texts[a], texts[b]) >= 0.8 - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.class_id for r in dedup.classes(docs).collect()}
    assert got == {i: find(i) for i in texts}
    assert len(set(got.values())) < len(got)


def test_star_of_copies(spark):
    """Edited copies that only the original links are one class, whatever leads their buckets."""
    rng = np.random.default_rng(0)
    base = [f"t{k}" for k in rng.integers(0, 10**6, 150)]
    rows = []
    for k in range(120):
        w = list(base)
        for at in rng.choice(150, 2, replace=False):
            w[at] = f"e{k}x{at}"
        rows.append((k, " ".join(w)))
    rows += [(500, " ".join(base)), (501, " ".join(f"u{k}" for k in range(150)))]
    got = {r.doc_id: r.class_id for r in dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[501] == 501 and {got[k] for k in [*range(120), 500]} == {0}


def test_pairs_in_large_buckets_without_hub(spark):
    """Copies of one text with two words replaced are linked only where both stand at the same two places."""
    places = [(i, j) for i in range(4, 96) for j in range(i + 5, 96)]
    chosen = [places[k] for k in np.random.default_rng(1).choice(len(places), 400, replace=False)]
    rows = [(2 * k + c, " ".join(f"e{k}x{c}x{w}" if w in at else f"t{w}" for w in range(100))) for k, at in enumerate(chosen) for c in (0, 1)]
    got = {r.doc_id: r.class_id for r in dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(800)}


def test_one_id_on_different_texts(spark):
    """Rows are compared by what they say, whatever their ids."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (None, a + " more"), (None, "alone")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    got = Counter((r.doc_id, r.n_checked_links) for r in dedup.classes(df).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (None, 1): 1, (None, 0): 1}
    assert {r.n for r in dedup.deduplicate(df).collect()} == {0, 1, 4}
    same = spark.createDataFrame([(7, a, 1), (7, a, 2), (8, a, 3)], df.schema)
    assert [r.doc_id for r in dedup.deduplicate(same).collect()] == [7]


def test_links_are_named_as_checked(empty):
    assert dedup.classes(empty).columns == ["doc_id", "class_id", "n_checked_links"]


def test_outlines_are_never_less_alike():
    rng = np.random.default_rng(3)
    x, y = (np.where(rng.random((200, 64)) < 0.5, 0, rng.integers(1, 4, (200, 64)) / 1.0) for _ in range(2))
    y = np.where(rng.random((200, 64)) < 0.7, x, y)
    shares = lambda m: m / m.sum(axis=1, keepdims=True)
    sets = lambda row: (np.flatnonzero(row), row[row > 0])
    exact = np.array([dedup.probability_jaccard(*sets(a), *sets(b)) for a, b in zip(x, y, strict=True)])
    assert np.allclose(dedup.row_similarity(shares(x), shares(y)), exact)
    merged = lambda m: shares(m).reshape(200, 16, 4).sum(axis=2)
    assert (dedup.row_similarity(merged(x), merged(y)) >= exact - 1e-9).all()


def test_signature_estimates_probability_jaccard():
    run = np.random.default_rng(9).integers(0, 1 << 63, 60, dtype=np.uint64)
    a, b = run[:50], run[10:]
    x, y = 1.0 + np.arange(50) % 3, 1.0 + np.arange(50) % 3
    sig = dedup.signatures(np.repeat([0, 1], 50), np.concatenate([a, b]), np.concatenate([x, y]), 2, 4000)
    order = lambda h, w: (np.sort(h), w[np.argsort(h)])
    exact = dedup.probability_jaccard(*order(a, x), *order(b, y))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_dedup_edges(odd, empty):
    got = dedup.classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.class_id for r in got}
    assert by[8] == by[9] == 8 and by[0] == by[1] == by[2] == by[10] == 0 and by[7] == 7
    assert dedup.classes(empty).collect() == []
    kept = dedup.deduplicate(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 0, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14}


# decontamination


def test_tiles_catch_reordered_passages():
    item = [f"w{k}" for k in range(30)]
    number = lambda ws: [zlib.crc32(w.encode()) for w in ws]
    text = ["a", *item[20:], "b", "c", *item[:12], "d", *item[12:20]]
    assert sorted(decontaminate.tiles(number(item), number(text))) == [(8, 12, 26), (10, 20, 1), (12, 0, 13)]
    assert decontaminate.tiles(number(item[:4]), number(["x", *item[:4]])) == [(4, 0, 1)]


def naive_tiles(p, t, least):
    mp, mt, covered = [False] * len(p), [False] * len(t), 0
    while True:
        best = []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k >= least:
                    best.append((k, i, j))
        if not best:
            return covered
        top = max(b[0] for b in best)
        for k, i, j in sorted(b for b in best if b[0] == top):
            if not any(mp[i : i + k]) and not any(mt[j : j + k]):
                mp[i : i + k] = mt[j : j + k] = [True] * k
                covered += k


def test_tiles_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        p, t = rng.integers(0, 3, 14).tolist(), rng.integers(0, 3, 40).tolist()
        assert sum(x[0] for x in decontaminate.tiles(p, t, 3)) == naive_tiles(p, t, 3)


def test_leaks(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items, want = {r.item_id: words(r.text) for r in bench.collect()}, set()
    for r in docs.collect():
        w = words(r.text)
        grams = {tuple(w[k : k + 5]) for k in range(len(w))}
        for i, p in items.items():
            if any(tuple(p[k : k + 5]) in grams for k in range(len(p) - 4)) and naive_tiles(p, w, 5) >= len(p) / 2:
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and got


def test_leaks_through_a_full_filter(spark, docs, monkeypatch):
    """A filter that lets everything through changes nothing."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = Counter(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    assert Counter(tuple(r) for r in decontaminate.leaks(docs, bench).collect()) == want


def test_tiles_of_repetitive_text():
    assert decontaminate.tiles([1] * 3000, [1] * 40_000)[0] == (3000, 0, 0)
    assert sum(k for k, _, _ in decontaminate.tiles([1] * 3000 + [2], [1] * 2000 + [3] * 9 + [1] * 900)) == 2900


def test_leak_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text here it is"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).collect())
    assert got == {(8, 1): 1, (9, 1): 1, (4, 4): 2}
    assert decontaminate.leaks(empty, bench).collect() == [] and decontaminate.leaks(odd, bench.limit(0)).collect() == []
    clean = decontaminate.decontaminate(odd, bench)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {None, *range(len(ODD))} - {4, 8, 9}
    nobody = spark.createDataFrame([(None, "same text here it is now"), (1, None)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(nobody, bench).collect()] == [1]


# tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    def get(name):
        t = Tokenizer.from_file(tokenizer_path(name))
        t.no_truncation()
        t.no_padding()
        return t

    return get


EXTRA = [" ", " a", "a ", "\n", "a\n", "a.\nB c\nd\n", "x\n\ny z\n", "\nq w,\n", "a \nb", "it's THE Ｆoo ½ Ⅷ 12 <|endoftext|> hmm<|startoftext|>x ΣΑΣ Σ é é \x1c\x1d a\x85b İstanbul ☃☃ 'll 've'", " \n\t ", "a" * 3000, "a  b   c \n d\n e", "tab\tx  ", "  lead", "x y  z"]


def test_bpe_as_the_library(spark, docs, odd, empty, library):
    path = tokenizer_path("word_bpe_49k.json")
    theirs, ours = library("word_bpe_49k.json"), bpe.loaded(path)
    for text in [r.text for r in docs.collect()] + [t or "" for t in ODD] + EXTRA:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.written(text)[1] == ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.digests(odd, path).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(odd, path).count() == odd.count() and bpe.digests(empty, path).count() == 0
    assert bpe.encoded(odd.withColumn("ids", F.lit(1)), path).columns[-3:] == ["n_tokens", "ids", "decoded"]


def test_encoded_leaves_no_words_in_workers(spark, docs, odd, empty, tmp_path):
    path = shutil.copy(tokenizer_path("word_bpe_49k.json"), tmp_path / "own.json")
    ours = bpe.Bpe(path)
    for rows in (docs, odd, empty):
        want = sorted((repr(r.doc_id), ours.encode(r.text or ""), ours.written(r.text or "")[1]) for r in rows.collect())
        got = bpe.encoded(rows.repartition(8), str(path)).collect()
        assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(c) + len(c.old) for b in [bpe._loaded.get(str(path))] if b for c in (b.cache, b.chunks)], pa.int64())], ["n"])

    left = [r.n for r in spark.range(0, 64, 1, 16).select("id").mapInArrow(held, "n long").collect()]
    assert left and not any(left)


def test_segment_tree_is_the_minimum():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1000, 13).tolist()
    tree = bpe.SegmentTree(keys)
    for at, value in rng.integers(0, 1000, (50, 2)).tolist():
        keys[at % 13] = value
        tree.set(at % 13, value)
        assert tree.node[1] == min(keys)


def test_id_store(spark, docs, odd, empty, library, tmp_path):
    path, theirs = tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    encoder = idstore.loaded(path)
    for text in [t or "" for t in ODD] + EXTRA:
        assert encoder.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    many = [r.text for r in docs.collect()] + [t or "" for t in ODD] + EXTRA
    seen = []
    for own, ids, ends in encoder.encode_all(many):
        for k, part in zip(own, np.split(ids, ends[:-1]), strict=True):
            seen.append(k)
            assert part.tolist() == [*theirs.encode(many[k], add_special_tokens=False).ids, 2]
    assert sorted(seen) == list(range(len(many)))
    store = str(tmp_path / "store")
    got = {r.doc_id: r for r in idstore.round_trip(docs, path, store).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*theirs.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        mine = got[r.doc_id]
        assert (mine.start, mine.n_tokens, mine.ids_crc32, mine.verified) == (start, len(ids), zlib.crc32(ids.tobytes()), True)
        start += len(ids)
    pool = spark.read.parquet(f"{store}/pool")
    chunks = pool.where("kind = 'chunk'")
    assert chunks.count() == chunks.select("address").distinct().count()
    assert chunks.count() < pool.where("kind = 'recipe'").agg(F.sum(F.length("addresses") / 16)).collect()[0][0]
    manifest = spark.read.parquet(f"{store}/manifest").where("part is null").collect()[0]
    assert (manifest.docs, manifest.ids) == (docs.count(), start)
    raw = {r.doc_id: r.text for r in docs.limit(20).collect()}
    for r in idstore.streams(spark, store).where(F.col("doc_id").isin(list(raw))).collect():
        assert list(r.ids) == [*theirs.encode(raw[r.doc_id], add_special_tokens=False).ids, 2]
    edge = idstore.round_trip(odd, path).collect()
    assert len(edge) == odd.count() and all(r.verified for r in edge)
    assert sorted(r.n_tokens for r in edge if r.doc_id in (0, 1)) == [1, 1]
    assert idstore.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("part", ["pool", "index", "manifest"])
def test_id_store_notices_changes(spark, docs, tmp_path, part):
    """A lost or altered row of any of the tables is an error."""
    path, store = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "store")
    idstore.write(docs.limit(30), store, path)
    good = idstore.read(spark, store).collect()
    assert len(good) == 30 and all(r.verified for r in good)
    rows = spark.read.parquet(f"{store}/{part}")
    if part == "pool":
        lost = rows.where("kind = 'chunk'").orderBy("address").limit(1).collect()[0].address
        changes = [rows.where((F.col("kind") == "recipe") | (F.col("address") != F.lit(lost)))]
        flipped = F.concat(F.expr("substring(data, 1, length(data) - 1)"), F.lit(b"\x7f"))
        changes.append(rows.withColumn("data", F.when(F.col("address") == F.lit(lost), flipped).otherwise(F.col("data"))))
        changes.append(rows.where("kind = 'chunk' or doc_id <> 3"))
    elif part == "index":
        changes = [rows.where("doc_id <> 3"), rows.withColumn("n_tokens", F.col("n_tokens") + (F.col("doc_id") == 3).cast("int")), rows.withColumn("start", F.col("start") + (F.col("doc_id") == 3).cast("int"))]
    else:
        changes = [rows.where("part is not null"), rows.withColumn("root", F.unhex(F.sha1("root")))]
    for k, changed in enumerate(changes):
        other = tmp_path / f"changed{k}"
        shutil.copytree(store, other)
        shutil.rmtree(other / part)
        changed.write.parquet(f"{other}/{part}")
        with pytest.raises(Exception, match="not as stored|manifest"):
            idstore.read(spark, str(other)).collect()
    if part == "pool":
        assert not all(r.verified for r in idstore.read(spark, str(other), strict=False).collect())


def test_cuts_and_checksums():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    a, b = (idstore.cut_points(len(x), idstore.marks(x).tolist()) for x in (ids, np.concatenate([ids[:77], ids])))
    assert a[-1] == len(ids) and all(idstore.LEAST <= y - x <= idstore.MOST for x, y in itertools.pairwise([0, *a[:-1]]))
    assert len({x + 77 for x in a} & set(b)) > 0.9 * len(a)  # cuts move with the passage
    parts = [rng.bytes(n) for n in (5, 1, 1000, 64)]
    crcs, sizes = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts])
    assert idstore.crcs_joined(crcs, sizes, np.array([1, 4])).tolist() == [zlib.crc32(parts[0]), zlib.crc32(b"".join(parts[1:]))]
    assert idstore.crcs_joined(crcs, sizes, np.array([4])).tolist() == [zlib.crc32(b"".join(parts))]
    assert idstore.merkle_root([b"a", b"b", b"c"]) != idstore.merkle_root([b"a", b"c", b"b"])


# licenses and personal data


def license_twin(text):
    w = words(text)
    at = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for label, p in licenses.BASE.items()}
    every = [x for xs in at.values() for x in xs]
    base = {label for label, xs in at.items() if xs}
    own, best = set(), 0.0
    for k in range(0, len(w), licenses.SPAN):
        have = set(w[k : k + 2 * licenses.SPAN])
        for label, templates in licenses.TEMPLATES.items():
            for t in templates:
                share = len(have & set(t.split())) / len(set(t.split()))
                if share >= 0.8 - 1e-9:
                    own.add(label)
                    best = max(best, share)
    return (len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if base else best)


MORE = ["CC BY-NC cc/by\nnc under the MIT, license under the mit license", "Apache License, Version 2.0!", "this work is licensed under the gnu general public license version 3 but with words\nlicensed", "unlicensed under the mit licenses", "cc by ncx"]


def test_licenses_against_brute_force(spark, docs, odd, empty):
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(MORE)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").union(extra), odd.where("doc_id is not null").distinct()):
        want = {r.doc_id: license_twin(r.text) for r in df.collect()}
        got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(df).collect()}
        assert got == want
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    twice = spark.createDataFrame([(1, wrapped), (1, "nothing"), (None, wrapped)], "doc_id long, text string")
    assert Counter((r.doc_id, r.labels) for r in licenses.scan(twice).collect()) == {(1, "mit"): 1, (1, ""): 1, (None, "mit"): 1}


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_twin(text):
    def holds(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return 9 <= len(digits) <= 15 if kind == "phone" else True

    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


PRIVATE = ["a@b.c_d@e.f x@y@z.w", "1.2.3.4.5.6.7.8 300.1.1.1 0300.1.1.1 1.2.3.000255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999 +1 23", "é.%a+b-c@ex-a.co.uk, 12 34", "9" * 30_000, "1 " * 20_000, "a" * 30_000 + "@" + "b." * 5000 + "c", "+1" + "(" * 30_000]


def test_pii_against_brute_force(spark, docs, odd):
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(PRIVATE)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").union(extra), odd.where("doc_id is not null").distinct()):
        got = {r.doc_id: r for r in pii.report(df, slack=-100.0).collect()}
        for r in df.collect():
            want, mine = pii_twin(r.text), got[r.doc_id]
            assert [x for x in mine.spans.split(",") if x and not x.startswith("secret")] == want and mine.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [mine[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want) for k in KINDS]


def test_terms_that_give_entities_away(spark, odd, empty):
    told = [(k, f"Zorbulon {w} wrote from ann@x.org the other day.\nnothing else {w}") for k, w in enumerate(("today", "then", "late", "soon"))]
    rest = [(10 + k, f"the other day {w} went on") for k, w in enumerate(("wrote", "from") * 20)]
    df = spark.createDataFrame(told + rest, "doc_id long, text string")
    assert {(r.entity, r.term) for r in pii.disclosures(df).collect()} == {("email:ann@x.org", "zorbulon")}
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert got[0].n_terms == 1 and got[0].spans.startswith("term:0:8,email:") and got[10].spans == ""
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": [r[0] for r in told + rest], "text": [r[1] for r in told + rest]}))
    sql = db.sql(registry.op7_sql())
    assert {tuple(r) for r in sql.fetchall()} == {tuple(r[c] for c in sql.columns) for r in got.values()}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0].startswith("<TERM> today wrote from <EMAIL> the other day.") and clean[10] == rest[0][1]
    copies = spark.createDataFrame([(k, told[0][1]) for k in range(9)], "doc_id long, text string")
    terms = lambda d: {r.term for r in pii.disclosures(d).collect()}
    assert terms(copies) == terms(copies.limit(1)) == {"zorbulon", "wrote", "from", "the", "other", "day"}  # copies weigh alike
    assert pii.disclosures(spark.createDataFrame([(1, "ann@x.org told")], "doc_id long, text string")).count() == 0  # no other line
    key = spark.createDataFrame([(1, 'a token = "0123456789abcdef0" here'), (1, "other words"), (None, "me@x.org me@x.org b")], "doc_id long, text string")
    assert sorted(r.spans for r in pii.report(key).collect()) == ["", "email:0:8,email:9:17,term:18:19", "term:0:1,secret:2:29,term:30:34"]
    assert {r.text for r in pii.sanitise(key).collect()} == {"<TERM> <SECRET> <TERM>", "other words", "<EMAIL> <EMAIL> <TERM>"}
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == odd.count() and pii.report(empty).count() == 0
    assert {r.text for r in pii.sanitise(odd).where("doc_id = 0").collect()} == {None}


# media


def image(rng, h, w):
    c = (rng.integers(0, 256, (h, w, 4)).cumsum(1) // 3 % 256).astype(np.uint32)
    return (c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]).astype(np.uint32)


def test_webp_transforms():
    rng = np.random.default_rng(1)
    im = image(rng, 13, 21)
    assert (webp.decode(webp.encode_argb(im)) == im).all()
    for mode in range(14):
        assert (webp.decode(webp.encode_argb(im, predictor=np.full((4, 6), mode))) == im).all()
    assert (webp.decode(webp.encode_argb(im, cross=rng.integers(-128, 128, (4, 6, 3)))) == im).all()
    every = {"subtract_green": True, "predictor": rng.integers(0, 14, (4, 6)), "cross": rng.integers(-128, 128, (4, 6, 3)), "cache_bits": 6}
    assert (webp.decode(webp.encode_argb(im, **every)) == im).all()
    for k in (1, 2, 3, 4, 9, 16, 17, 200):
        flat = rng.integers(0, 1 << 32, k).astype(np.uint32)[rng.integers(0, k, (7, 19))]
        assert (webp.decode(webp.encode_argb(flat, palette=True)) == flat).all()
        assert (webp.decode(webp.encode_argb(flat, cache_bits=4)) == flat).all()


def test_webp_payloads():
    for text in ["", "a", "\n" * 3000, "x" * 100_000, "ab\n" * 5000, "a line that repeats itself often\n" * 3000, "é" * 575]:
        media = webp.store(webp.padded(text))
        assert webp.load(media) == webp.padded(text) and media[:4] == b"RIFF"
    with pytest.raises(ValueError):
        webp.decode(b"RIFF\0\0\0\0WEBPVP8 ")
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)


def test_media_features(docs, odd, empty):
    for df in (docs, odd):
        for r, t in zip(webp.features(df).collect(), df.collect(), strict=True):
            raw = (t.text or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert webp.features(empty).count() == 0


# shards


def test_equal_rows_are_dealt_like_others(spark):
    same = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    got = sharding.shard(same, part_rows=100).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {250}


def test_matrix():
    counts, targets = [10, 0, 25, 7], [11, 11, 10, 10]
    m = sharding.communication_matrix(counts, targets, 3)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == targets
    mean = np.mean([sharding.communication_matrix(counts, targets, s) for s in range(800)], axis=0)
    assert np.allclose(mean, np.outer(counts, targets) / 42, atol=0.35)
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 750) < 5 and 8 < np.std(big) < 20


def test_shards(docs, odd, empty):
    for df, part in ((docs, 7), (docs, 2000), (odd, 3)):
        got = sharding.shard(df, part_rows=part).collect()
        n = df.count()
        assert len(got) == n and {r.law for r in got} == {"rows"}
        held = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
        assert all(v == list(range(len(v))) for v in held.values())
        assert {len(v) for v in held.values()} <= {n // 16, n // 16 + 1}
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard(empty).count() == 0


# quality


def kneser_ney(texts, order):
    """Probability of a symbol after a context, straight from the definition."""
    count = {order: Counter()}
    for t in texts:
        s = b"\n" * (order - 1) + t.encode()
        count[order].update(s[k : k + order] for k in range(len(t.encode())))
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    disc = {}
    for k, c in count.items():
        n = [0, *[sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [0.0]
        for i in (1, 2, 3):
            v = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else -1
            d.append(v if 0 < v < i else 0.5 * i)
        disc[k] = d

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        same = {h: v for h, v in count[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, d = sum(same.values()), disc[k]
        taken = sum(d[min(v, 3)] for v in same.values())
        own = same.get(g, 0)
        return (own - d[min(own, 3)]) / total + taken / total * p(g[1:]) if own else taken / total * p(g[1:])

    return p


def test_perplexity_from_the_definition(spark):
    good = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "déjà vu the the"]
    df = spark.createDataFrame([(k, "en", t) for k, t in enumerate([*good, "zebra cat", "the", "", None])], "doc_id long, lang string, text string")
    seen, contexts = quality.model(df.where("doc_id < 4"), 3)
    got = {r.doc_id: r.log_perplexity__ for r in quality.score(df, seen, contexts, 3).collect()}
    other = {r.doc_id: r.log_perplexity__ for r in quality.score(df, seen, contexts, 3, block_bytes=9).collect()}
    p = kneser_ney(good, 3)
    for k, t in enumerate([*good, "zebra cat", "the"]):
        s = b"\n\n" + t.encode()
        want = -np.mean([np.log(p(s[i : i + 3])) for i in range(len(t.encode()))])
        assert np.isclose(got[k], want) and np.isclose(other[k], want)
    assert got[6] is None and got[7] is None and other[6] is None


def test_quality_on_labels(spark, docs, labels, odd, empty):
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = ([r.keep for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4
    none = labels.limit(0)
    kept = {r.doc_id for r in quality.accepted(odd, none).collect()}
    assert kept == {None, *range(len(ODD))} - {0, 1}
    assert quality.accepted(odd, none).columns == odd.columns and quality.classify(empty, labels).count() == 0
    twice = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, twice).count() == odd.count()


# toxicity


def test_kernel_from_the_definition():
    def naive(a):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(a)), 3):
            if k - i < toxicity.SPAN:
                out[a[i] + a[j] + a[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def value(a, b):
        x, y = naive(a), naive(b)
        dot = lambda p, q: sum(p[g] * q[g] for g in p)
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    for a, b in [("idiot", "idiot"), ("idiot", "idxiot"), ("banana", "bandana"), ("abc", "xyz")]:
        assert np.isclose(toxicity.kernel(a, b), value(a, b))
    assert toxicity.kernel("слово", "делать") < 0.2 and toxicity.kernel("слово", "слово") > 0.99 and toxicity.kernel("ídiot", "idiot") > 0.99
    assert toxicity.units("id*iot")[:3] == ["id", "iot", "idiot"] and "moron" in toxicity.units("m0ron")


def test_bound_clears_no_near_unit():
    rng = np.random.default_rng(4)
    marks = toxicity.Landmarks(["idiot", "worthless", "scum"])
    pool = ["".join(rng.choice(list("idotscumwrhle"), 7)) for _ in range(3000)]
    near = set(marks.near(pool))
    assert all(marks.value(u) is None for u in pool if u not in near)


def test_toxicity_held_out(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    a, b = (np.array([r.score for r in got if r.toxic == t]) for t in (1, 0))
    assert (a[:, None] > b).mean() > 0.75  # some labels are noise
    assert (b < 0.5).mean() > 0.95
    marks = toxicity.Landmarks(model.landmarks)
    plain, bent, spaced, clean = model.score(["an idiot said", "an id-iot said", "an i d i o t said", "an other said"], marks)
    assert min(plain, bent, spaced) > 0.5 > clean
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    nobody = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, nobody).collect()} == {0.0}
    out = toxicity.classify(docs, labels)
    assert {"doc_id", "held_out", "score", "predicted"} <= set(out.columns)


# words


def test_word_hashes_tell_words_apart():
    texts = ["Ab cd", "ab  CD", "abc d", "", "ab cd\n", "ünd ab"]
    raw, at = tx.as_bytes(pa.array(texts))
    starts, ends, bounds = tx.words(raw, at)
    h = tx.word_hashes(raw, starts, ends)
    by = [h[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))]
    assert by[0] == by[1] == by[4] and by[0] != by[2] and by[3] == [] and by[5][1] == by[0][0]
    k1, k2 = tx.sequence_keys(h, bounds)
    assert k1[0] == k1[1] == k1[4] != k1[2] and len({*k2.tolist()}) == 4
