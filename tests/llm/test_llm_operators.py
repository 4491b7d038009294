"""Operators on text against brute force, on a small table with every awkward case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "The quick brown fox jumps over the lazy dog while Ünïcode words stay whole and 12 numbers follow. "


def rows():
    r = np.random.default_rng(5)
    vocab = ["".join(r.choice(list("abcdefghij"), int(r.integers(2, 9)))) for _ in range(400)]
    texts = [" ".join(r.choice(vocab, int(n))) for n in r.integers(60, 300, 40)]
    passage = " ".join(r.choice(vocab, 70))
    texts += [texts[0], texts[0].upper(), texts[1], passage + " " + texts[2], texts[3] + "\n" + passage, "x " + passage + passage]
    texts += ["", None, " ", "a", "a b", "a\n\n  b  ", "\0\x01 odd", "<|endoftext|> in <|endoftext|>text", "ab" * 900, " " * 400, "é" * 300, "é" * 301]
    texts += ["Released under the MIT License. Apache License, Version 2.0 and CC BY-NC", "under the mit license under the mit license"]
    texts += [BASE * 3, BASE * 3 + "end", " ".join(r.choice(vocab, 30_000))]
    out = [(i, t, ["en", "fr", None][i % 3], None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[0], out[0], (None, "no id " + passage, None, "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns named as what operators add or use inside, one of them twice."""
    return docs.selectExpr("*", "1 AS piece", "2 AS digest", "3 AS kept", "4 AS th", "5 AS c0", "6 AS Text", "7 AS fp", "8 AS kept", "9 AS doc", "0 AS score")


def text(t):
    return t or ""


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def tokenizer(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids_equal_the_library(name):
    from heliochron.llm.tokens import Encoder
    r = np.random.default_rng(1)
    parts = ["a", "The", " the", " ", "  ", "\n", "\t", "'s", "don't", "é", "É", "ß", " ", "　", "<|endoftext|>", "1", "23", "!", "...", "́", "İ", "Σ", "😀",
             "\x1c", "ª", "½", "\r\n", "中文", "_", "'LL", "\0", "\x01"]
    texts = ["".join(r.choice(parts, int(r.integers(0, 14)))) for _ in range(3000)] + [text(x[1]) for x in rows()]
    enc, lib = Encoder(P.path(name), keep=300), tokenizer(name)
    for _ in range(2):
        got = [x for at in range(0, len(texts), 700) for x in enc.encode(texts[at:at + 700])]
        assert [g.tolist() for g in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, empty, clashing):
    from heliochron.llm.packing import pack_documents, sequences
    path, lib = P.path("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    got = pack_documents(clashing, path, 256).cache()
    pieces = got.collect()
    want = Counter()
    for r in rows():
        ids = lib.encode(text(r[1]), add_special_tokens=False).ids + [0]
        head = len(ids) % 256 or min(256, len(ids))
        edges = [0, *range(head, len(ids) + 1, 256)]
        want.update((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.01 * sum(p.length for p in pieces) / 256 + 1
    assert {r.sequence_id: len(r.ids) // 4 for r in sequences(got, 256).collect()} == {k: sum(x[1] for x in v) for k, v in bins.items()}
    assert pack_documents(empty, path).count() == 0


def test_fullest_bin_against_all_subsets():
    from itertools import combinations

    from heliochron.llm.packing import fullest
    r = np.random.default_rng(2)
    for _ in range(60):
        items = sorted(r.integers(1, 30, 9).tolist(), reverse=True)
        got = fullest(items[0], dict(Counter(items)), 50)
        best = max(items[0] + sum(c) for k in range(9) for c in combinations(items[1:], k) if items[0] + sum(c) <= 50)
        assert sum(got) == best and not Counter(got) - Counter(items) and got[0] == items[0]


def test_token_files(spark, docs, empty, clashing, tmp_path):
    from heliochron.llm.binary import document, read_tokens, write_tokens
    path, lib = P.path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    folder = str(tmp_path / "ids")
    manifest = write_tokens(clashing, folder, path, 1, parts=5)
    got = sorted(read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    want = Counter((r[0], np.array(lib.encode(text(r[1]), add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in rows())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    part = max((m.asDict() for m in manifest.collect()), key=lambda m: m["documents"])
    assert document(folder, part, 0).tolist() == np.frombuffer(next(r.ids for r in got if r.start == part["base"]), "<u4").tolist()
    write_tokens(empty, str(tmp_path / "none"), path, 1)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_bpe_chunks(docs, empty, clashing, monkeypatch):
    from heliochron.llm.bpe import decode_documents, encode_documents
    path, lib = P.path("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    got = decode_documents(encode_documents(clashing, path), path).collect()
    want = Counter()
    for r in rows():
        ids = lib.encode(text(r[1]), add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded) for r in got) == want
    assert decode_documents(encode_documents(empty, path), path).count() == 0


def test_joins_of_tiny_chunks():
    from heliochron.llm.bpe import Codec, cuts
    from heliochron.llm.tokens import Encoder
    lib, enc = tokenizer("byte_bpe_50k.json"), Encoder(P.path("byte_bpe_50k.json"))
    c = Codec(enc.library.get_vocab(True), enc)
    for r in rows():
        t = text(r[1])[:6000]
        raw, a, parts = t.encode(), 0, []
        for b in cuts(raw, average=4, least=3, most=40):
            parts.append(raw[a:b].decode())
            a = b
        assert a == len(raw)
        assert c.join(c.enc.encode(parts)).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_license_scan(docs, empty, clashing):
    from heliochron.llm.licenses import PHRASES, WORD, scan
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(clashing).collect())
    want = Counter()
    for r in rows():
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text(r[1])))
        places = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        want[(r[0], len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
    assert got == want
    assert scan(empty).count() == 0


def test_license_notice_with_changes(spark):
    from heliochron.llm.licenses import NOTICES, scan
    words = NOTICES[2][0].split()
    words[6:6] = ["really"]
    r = scan(spark.createDataFrame([(1, " ".join(words)), (2, "redistribution and use")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "bsd-notice" and 0.6 < r[0].score < 1 and r[0].spans[0].hi == len(words) - 1
    assert r[1].labels == "" and 0 < r[1].score < 0.2


def test_suffix_dedup(docs, empty, clashing):
    from heliochron.llm.suffix import repeat_digests, without_repeats
    got = by_id(repeat_digests(clashing))
    seen, done = set(), {}
    for r in sorted(rows(), key=lambda r: -1 if r[0] is None else r[0]):
        if r[0] is None:
            continue
        b = text(r[1]).encode()
        if r[0] not in done:
            gone = bytearray(len(b))
            for p in range(len(b) - 99):
                if b[p:p + 100] in seen:
                    gone[p:p + 100] = b"\1" * 100
                seen.add(b[p:p + 100])
            runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
            done[r[0]] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    # Rows without id come first of all; here they share only the passage, which then goes from the others.
    first = {r[0]: text(r[1]).encode() for r in rows()}
    own = [x for r in rows() if r[0] is None for x in [text(r[1]).encode()]]
    lead = {x[p:p + 100] for x in own for p in range(len(x) - 99)}
    for k, v in done.items():
        b = first[k]
        if any(b[p:p + 100] in lead for p in range(len(b) - 99)):
            assert got[k][0].n_removed >= v[1]
        else:
            assert all((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == v for g in got[k]), k
    assert sum(map(len, got.values())) == len(rows())
    assert repeat_digests(empty).count() == 0
    left = without_repeats(clashing)
    assert left.columns == clashing.columns and left.count() == len(rows())
    assert without_repeats(empty).columns == empty.columns


def test_suffix_order():
    from heliochron.llm.suffix import SuffixOrder, cover, distances, repeated
    d = distances()
    assert d.max() < 64 and all((i + d[i, j]) % 64 in set(cover().tolist()) and (j + d[i, j]) % 64 in set(cover().tolist()) for i in range(64) for j in range(64))
    r = np.random.default_rng(3)
    for k in range(24):
        n = int(r.integers(150, 1500))
        t = r.integers(97, 97 + int(r.integers(1, 4)), n).astype(np.uint8)
        if k % 3 == 0:
            t[n // 2:n // 2 + n // 3] = t[:n // 3]
        if k % 5 == 0:
            t[:] = np.resize(np.frombuffer(b"abcab", np.uint8), n)
        if k % 7 == 0:
            t[-40:] = 0
        places, b = np.arange(n - 100), t.tobytes()
        assert SuffixOrder(t).sort(places)[0].tolist() == sorted(places.tolist(), key=lambda i: b[i:])
        seen = set()
        want = [(x := b[i:i + 100]) in seen or seen.add(x) is not None for i in places]
        assert repeated(t, places, 100, bucket=64).tolist() == want


def test_anchor_splits_of_many_contexts(spark, monkeypatch):
    """More spans of one anchor than a task takes are dealt by their windows, with the same result."""
    from heliochron.llm import suffix
    r = np.random.default_rng(9)
    line = "this very common line stands in all of the documents of this corpus, whatever else may stand around it in them, and is long enough to go. "
    docs = spark.createDataFrame([(i, "".join(map(chr, r.integers(97, 123, 150))) + line + "".join(map(chr, r.integers(97, 123, 150)))) for i in range(60)], "doc_id long, text string")
    whole = sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect()))
    monkeypatch.setattr(suffix, "SPLIT", 7)
    assert sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect())) == whole
    assert sum(x[2] > 0 for x in whole) == 59


def test_common_windows_are_sent_once_a_task(spark, monkeypatch):
    """A window in very many documents reaches its share once per task and HELD spans; documents read twice change nothing."""
    from heliochron.llm import suffix
    r = np.random.default_rng(9)
    line = "this very common line stands in all of the documents of this corpus, whatever else may stand around it in them, and is long enough to go. "
    rows = [(i, "".join(map(chr, r.integers(97, 123, 150))) + line + "".join(map(chr, r.integers(97, 123, 150)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    twice = spark.createDataFrame(rows + rows[::-1], "doc_id long, text string")
    whole = sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect()))
    monkeypatch.setattr(suffix, "SPLIT", 7)
    texts = suffix.keyed(docs)
    pieces = suffix._pieces(texts.coalesce(1), suffix._judged(suffix._dealt_spans(texts, 100, 4)).where("fan > 0").coalesce(1), 100, 4).repartition(1).collect()
    times = Counter(bytes(p.bytes[i:i + 100]) for p in pieces if p.bytes is not None for i, own in enumerate(p.mine) if own)
    common = [n for w, n in times.items() if w.decode() in line]
    assert common and max(common) <= 4  # partitions of the shuffle; one piece a document before
    for held in (4_000, 5):
        monkeypatch.setattr(suffix, "HELD", held)
        assert sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect())) == whole
        assert sorted(map(tuple, suffix.repeat_digests(twice).drop("kept").collect())) == sorted(whole + whole)


def in_many_contexts(n=60, around=150):
    r = np.random.default_rng(9)
    line = "this very common line stands in all of the documents of this corpus, whatever else may stand around it in them, and is long enough to go. "
    return [(i, "".join(map(chr, r.integers(97, 123, around))) + line + "".join(map(chr, r.integers(97, 123, around)))) for i in range(n)]


def test_windows_without_an_equal_are_not_sent(spark, monkeypatch):
    """Of an anchor with very many differing spans only windows that stand twice are fetched for the suffix order."""
    from heliochron.llm import suffix
    rows = in_many_contexts()
    twice = Counter(t[i:i + 100] for _, t in rows for i in range(len(t) - 99))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect()))
    monkeypatch.setattr(suffix, "SPLIT", 7)
    monkeypatch.setattr(suffix, "HELD", 5)
    texts = suffix.keyed(docs)
    wide = suffix._judged(suffix._dealt_spans(texts, 100, 4)).where("fan > 1")
    pieces = [p for p in suffix._pieces(texts, wide, 100, 4).collect() if p.bytes is not None]
    sent = [bytes(p.bytes[i:i + 100]).decode() for p in pieces for i, own in enumerate(p.mine) if own]
    assert sent and all(twice[w] > 1 for w in sent)
    assert sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect())) == whole


def test_suffixes_are_sorted_a_chunk_at_a_time(spark, monkeypatch):
    """What a bucket holds is sorted in chunks that don't part the pieces of one key; the size of a chunk changes nothing."""
    import pyarrow as pa
    from heliochron.llm import suffix
    docs = spark.createDataFrame(in_many_contexts(), "doc_id long, text string")
    whole = sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect()))
    monkeypatch.setattr(suffix, "SPLIT", 7)
    for chunk in (1, 700):
        monkeypatch.setattr(suffix, "CHUNK", chunk)
        assert sorted(map(tuple, suffix.repeat_digests(docs).drop("kept").collect())) == whole
    table = pa.table({"key": [1, 1, 2, 3, 3, 4, 5], "bytes": [b"x" * n for n in (5, 5, 1, 30, 30, 2, 2)]})
    assert [c.column("key").to_pylist() for c in suffix._chunks(table, 10)] == [[1, 1], [2, 3, 3], [4, 5]]
    assert not suffix._chunks(table.slice(0, 0), 10)


def test_spans_are_dealt_many_at_once(spark, monkeypatch):
    """A bucket gets a packet for many spans of a task, however small the slices are that are hashed."""
    from heliochron.llm import suffix
    texts = suffix.keyed(spark.createDataFrame(in_many_contexts(), "doc_id long, text string").coalesce(1))
    monkeypatch.setattr(suffix, "SLICE", 1000)
    dealt = suffix._dealt_spans(texts, 100, 16).collect()
    assert len(dealt) <= 17 and {r.bucket for r in dealt} <= {*range(16)}


def test_shuffle_files_of_the_spans_are_released(spark, monkeypatch):
    """Spans are stored with Spark told to delete the shuffle behind them; the setting is as before afterwards."""
    from heliochron.llm import suffix
    key, stored, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", suffix.stored, []
    monkeypatch.setattr(suffix, "stored", lambda df, name: (seen.append(spark.conf.get(key)), stored(df, name))[1])
    was = spark.conf.get(key)
    suffix.repeat_digests(spark.createDataFrame(in_many_contexts(5), "doc_id long, text string"))
    assert seen == ["true"] and spark.conf.get(key) == was


def test_ids_with_two_texts_are_told_apart(spark):
    """The hash of the text is left out of the keys only where no id has two texts; repeated rows are one document."""
    from heliochron.llm import suffix
    rows = in_many_contexts(6)
    one, other = rows + rows[:2], [(3, t) for _, t in rows] + rows[3:4]
    assert [suffix.measured(suffix.keyed(spark.createDataFrame(x, "doc_id long, text string"))) for x in (one, other)] == [
        (False, sum(len(t) for _, t in one)), (True, sum(len(t) for _, t in other))]
    gone = [r.n_removed for r in suffix.repeat_digests(spark.createDataFrame(other, "doc_id long, text string")).collect()]
    assert sorted(n > 100 for n in gone) in ([False] + [True] * 6, [False] * 2 + [True] * 5)  # the first may be the document read twice
    left = suffix.without_repeats(spark.createDataFrame(one, "doc_id long, text string")).collect()
    assert all((r.text == dict(rows)[r.doc_id]) == (r.doc_id == 0) for r in left) and len(left) == 8


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    import xxhash
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if h and 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash(docs, empty, clashing):
    from heliochron.llm.simhash import near_duplicates
    got = near_duplicates(clashing, leaf=8).collect()  # tiny leaves: the upper levels are walked in Spark
    f = np.array([fingerprint(text(r[1])) for r in rows()], np.uint64)
    ids = [r[0] for r in rows()]
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    label = np.arange(len(f))
    while True:
        new = np.where(near, label[None, :], len(f)).min(1)
        if (new == label).all():
            break
        label = new
    name = {k: min((ids[i] for i in np.flatnonzero(label == k) if ids[i] is not None), default=None) for k in set(label.tolist())}
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter((ids[i], int(f[i]), name[label[i]]) for i in range(len(f)))
    assert near_duplicates(empty).count() == 0


def test_trie_walk():
    from heliochron.llm.simhash import walk
    r = np.random.default_rng(1)
    for _ in range(10):
        base = r.integers(0, 1 << 64, 40, dtype=np.uint64)
        v = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
        for budget in range(4):
            got = {(int(v[i]), int(v[j])) for x, y in walk(v, v, 0, 0, budget, True, brute=4, width=8, expand=16) for i, j in zip(x, y)}
            want = np.bitwise_count(v[:, None] ^ v[None, :]) <= budget
            assert got == {(int(v[i]), int(v[j])) for i, j in zip(*np.nonzero(want)) if i < j}


def test_components_of_long_chains(spark):
    from heliochron.llm.graph import components
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}


def test_near_copies(spark, empty, clashing):
    from heliochron.llm.simhash import drop_near_copies
    r = np.random.default_rng(4)
    vocab = ["".join(r.choice(list("abcdefghij"), int(r.integers(2, 9)))) for _ in range(3000)]
    texts = [r.choice(vocab, 400) for _ in range(30)]
    copies = []
    for t in texts[:10]:
        c = t.copy()
        c[[30, 200, 330]] = "changed"  # 15 of 396 shingles differ: similarity 0.93
        copies.append(c)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, *copies])], "doc_id long, text string")
    assert sorted(x.doc_id for x in drop_near_copies(docs, leaf=8).collect()) == list(range(30))
    assert drop_near_copies(empty).count() == 0
    assert drop_near_copies(clashing).columns == clashing.columns


def edited(r, words, vocab, similarity, block):
    """Words changed in one block or in scattered places until the shingles' similarity is about ``similarity``."""
    n = len(words) - 4
    part = 2 * similarity / (1 + similarity)  # of each text's shingles
    c = words.copy()
    if block:
        k = max(1, int(n * (1 - part)) - 4)
        at = int(r.integers(0, len(words) - k))
        c[at:at + k] = r.choice(vocab, k)
    else:
        c[r.choice(len(words), int(-np.log(part) / 5 * len(words)), replace=False)] = r.choice(vocab, int(-np.log(part) / 5 * len(words)))
    return c


def test_near_copies_around_the_threshold(spark):
    """The documents left equal those of all pairs' exact similarity, from 0.7 to 0.95."""
    from heliochron.llm.simhash import drop_near_copies, shingles
    r = np.random.default_rng(21)
    vocab = np.array(["".join(r.choice(list("abcdefghij"), int(r.integers(3, 9)))) for _ in range(4000)])
    pairs = []
    for k in range(240):
        w = r.choice(vocab, int(r.integers(120, 500)))
        pairs.append((" ".join(w), " ".join(edited(r, w, vocab, 0.7 + 0.25 * (k % 60) / 59, k % 2 == 0))))
    exact = [len(x & y) / len(x | y) for a, b in pairs for x, y in [(set(shingles(a).tolist()), set(shingles(b).tolist()))]]
    table = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    left = {x.doc_id for x in drop_near_copies(table).collect()}
    lost = [2 * i + 1 not in left for i in range(len(pairs))]
    assert all(2 * i in left for i in range(len(pairs)))
    assert not [e for e, gone in zip(exact, lost) if gone and e < 0.8]
    assert sum(e >= 0.8 for e in exact) > 100 and sum(e < 0.8 for e in exact) > 60
    assert sum(gone for e, gone in zip(exact, lost) if e >= 0.8) >= 0.99 * sum(e >= 0.8 for e in exact)


def test_one_key_with_many_values_is_walked_in_blocks(monkeypatch):
    from heliochron.llm import simhash
    r = np.random.default_rng(2)
    v = np.sort((np.uint64(5) << np.uint64(32)) | np.arange(700, dtype=np.uint64) * np.uint64(6_000_000))
    sizes, compare = [], simhash._compare
    monkeypatch.setattr(simhash, "_compare", lambda a, b, alo, na, blo, nb, *rest: sizes.append(int((na * nb).sum())) or compare(a, b, alo, na, blo, nb, *rest))
    for grouped in (False, True):
        g = np.arange(700) // 650 if grouped else np.arange(700)
        got = [(i, j) for x, y in simhash.walk(v, v, 0, 0, 3, True, expand=1000, counted=32, ga=g, gb=g) for i, j in zip(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) == (650 * 50 if grouped else 700 * 699 // 2) and all(i < j and g[i] != g[j] for i, j in got)
        assert max(sizes) <= 2000
    same = np.full(700, 7, np.uint64)  # equal in all bits: nothing left to split by
    sizes.clear()
    assert sum(len(x) for x, _ in simhash.walk(same, same, 0, 0, 3, True, expand=1000, counted=32)) == 700 * 699 // 2 and max(sizes) <= 2000


def test_large_group_of_near_copies(spark):
    """Nearly all pairs of a large group are never made; the group goes but for one, other documents stay."""
    from heliochron.llm import simhash
    from heliochron.llm.common import stored
    r = np.random.default_rng(22)
    vocab = np.array(["".join(r.choice(list("abcdefghij"), int(r.integers(3, 9)))) for _ in range(4000)])
    base, texts = r.choice(vocab, 600), []
    for _ in range(400):
        c = base.copy()
        c[int(r.integers(0, 600))] = "changed" + str(len(texts))
        texts.append(" ".join(c))
    texts += [" ".join(r.choice(vocab, 300)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = stored(simhash.sketches(docs), "sketches")
    assert simhash.near_links(docs, own).count() < 400 * 399 / 2 / 10
    assert sorted(x.doc_id for x in simhash.drop_near_copies(docs).collect()) == [0, *range(400, 450)]


def test_exact_dedup(docs, empty, clashing):
    from heliochron.llm.common import stored
    from heliochron.llm.exact import decide, digests, exact_dedup
    keys = [re.sub("[A-Z]", lambda m: m[0].lower(), text(r[1])) for r in rows()]
    groups = {}
    for k, r in zip(keys, rows()):
        groups.setdefault(k, []).append(r[0])
    want = Counter()
    for k, r in zip(keys, rows()):
        top = max((i for i in groups[k] if i is not None), default=None)
        want[(r[0], top, len(groups[k]), r[0] == top, hashlib.sha256(k.encode()).hexdigest())] += 1
    for heavy in (4, 512):  # with and without frequent digests
        got = decide(stored(digests(clashing), "digests"), heavy).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got) == want
        left = exact_dedup(clashing, heavy)
        assert left.columns == clashing.columns
        assert Counter(r[0] for r in left.collect()) == Counter(max((i for i in g if i is not None), default=None) for g in groups.values())
    assert exact_dedup(empty).count() == 0


def test_quality(spark, docs, empty, clashing):
    from heliochron.llm.quality import classify, keep_good
    r = np.random.default_rng(8)
    good = [" ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(80)) + "." for _ in range(150)]
    bad = [g.upper().replace(" ", "!! ") for g in good[:75]] + [g.replace(" ", " | ") for g in good[75:]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = classify(table, labels, sample=200).collect()
    assert np.mean([x.predicted == (x.doc_id < 150) for x in got if x.held_out]) > 0.95
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in got)
    assert keep_good(clashing, labels, sample=50).columns == clashing.columns
    assert len(classify(docs, labels.limit(0)).collect()) == len(rows())
    assert classify(empty, labels).count() == 0


def test_rules(spark, docs, empty, clashing):
    from heliochron.llm.rules import in_words, judge, learn
    x = np.random.default_rng(1).random((3000, 2))
    rules = learn(x, (x[:, 0] > 0.7) & (x[:, 1] < 0.4), ["a", "b"])
    hit = np.zeros(3000, bool)
    for conditions, *_ in rules:
        ok = np.ones(3000, bool)
        for name, op, cut in conditions:
            v = x[:, "ab".index(name)]
            ok &= v > cut if op == ">" else v <= cut
        hit |= ok
    assert np.mean(hit == ((x[:, 0] > 0.7) & (x[:, 1] < 0.4))) > 0.97 and all(in_words(rules))
    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = Counter(tuple(r)[:6] for r in judge(clashing, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in rows():
        t = text(r[1])
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(r[0], len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == want
    assert judge(empty, labels).count() == 0


def test_language(spark, empty, clashing):
    from heliochron.llm.language import identify
    r = np.random.default_rng(6)
    make = lambda letters: " ".join("".join(r.choice(list(letters), int(r.integers(2, 7)))) for _ in range(40))
    table = spark.createDataFrame([(i, make(["abcdefg", "fghijkl"][i % 2]), ["xx", "yy"][i % 2]) for i in range(120)]
                                  + [(500, "12 .. 34", "xx"), (501, None, "xx"), (502, "日本", None), (None, "abc", "zz")], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in identify(table).collect()}
    assert all(got[i].lang_pred == ["xx", "yy"][i % 2] and 0.5 < got[i].score <= 1 for i in range(120))
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred in ("xx", "yy")
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert identify(clashing).count() == len(rows())
    assert identify(empty).count() == 0


def test_rare_language_is_learnt(spark):
    from heliochron.llm.common import smallest_each
    from heliochron.llm.language import identify, train
    r = np.random.default_rng(16)
    make = lambda letters: " ".join("".join(r.choice(list(letters), int(r.integers(2, 7)))) for _ in range(40))
    table = spark.createDataFrame([(i, make("abcdefg" if i % 100 else "tuvwxyz"), "xx" if i % 100 else "rare") for i in range(1200)], "doc_id long, text string, lang string")
    assert train(table, sample=20).names == ["rare", "xx"]
    assert {x.lang_pred for x in identify(table, sample=20).collect() if x.doc_id % 100 == 0} == {"rare"}
    got = Counter(x.lang for x in smallest_each(table.select("lang", "doc_id"), "lang", "doc_id", 50).collect())
    assert got == {"xx": 50, "rare": 12}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    r = np.random.default_rng(12)
    vocab = ["".join(r.choice(list("abcdefghij"), int(r.integers(2, 9)))) for _ in range(3000)]
    body = [" ".join(r.choice(vocab, 150)) for _ in range(60)]
    passage = " ".join(r.choice(vocab, 60))
    texts = body + [body[0], body[1].upper().lower(), body[2] + " end", passage + " " + body[3][:300], "start " + passage] + [b.upper().replace(" ", "!! ") for b in body[:40]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 65), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], str(tmp_path)).cache())
        assert steps[-1].columns == docs.columns
    ids = [{x.doc_id for x in s.collect()} for s in steps]
    assert ids[1] == set(range(65))
    assert ids[2] == set(range(65)) - {0, 1}
    assert ids[3] == ids[2] - {62}  # a near copy of 2
    left = {x.doc_id: x for x in steps[4].collect()}
    assert passage in left[63].text and passage not in left[64].text and left[64].n_chars == len(left[64].text)
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == ids[4]


def plain_labels(text, near=3, enough=0.6):
    """(labels, score) of the license scan by loops over all places and templates."""
    import re
    from heliochron.llm.licenses import K, NOTICES, PHRASES, WORD
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, labels, score = re.findall(WORD, low), set(), 0.0
    for t, (phrase, label) in enumerate([*PHRASES, *NOTICES]):
        own = re.findall(WORD, phrase)
        runs = len(own) - K + 1
        found = {}
        for at in range(len(words) - K + 1):
            for p in range(runs):
                if words[at:at + K] == own[p:p + K]:
                    found.setdefault(at - p, set()).add(p)
        bands, last = [], None
        for d in sorted(found):
            if last is None or d - last > max(near, runs // 4):
                bands.append(set())
            bands[-1] |= found[d]
            last = d
        full = t < len(PHRASES) and any(len(p) == runs for p in found.values())
        best = max((len(b) / runs for b in bands), default=0.0)
        if full or best >= enough:
            labels.add(label)
        score = max(score, 1.0 if full else best)
    return ",".join(sorted(labels)), score


def test_license_labels_against_loops(spark):
    import random
    from heliochron.llm.licenses import NOTICES, PHRASES, scan
    rnd = random.Random(12)
    texts = ["the mit license the mit license", "under the mit license", "x " * 5000 + NOTICES[0][0]]
    for _ in range(250):
        out = []
        for _ in range(rnd.randint(0, 4)):
            words = rnd.choice([*PHRASES, *NOTICES])[0].split()
            a, b = sorted((rnd.randint(0, len(words)), rnd.randint(0, len(words))))
            for w in words[a:b] if rnd.random() < 0.5 else words:
                r = rnd.random()
                out += [] if r < 0.04 else [w, "put", "in"] if r < 0.08 else [w]
            out += ["other"] * rnd.randint(0, 6)
        texts.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in scan(df).collect()}
    for i, text in enumerate(texts):
        labels, score = plain_labels(text)
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), text
    assert got[0] == ("", 0.5)


def test_joins_without_spaces_are_linear():
    import random
    import time
    import numpy as np
    import public_tokenizers
    from heliochron.llm.bpe import codec, cuts
    c, rnd = codec(public_tokenizers.path("byte_bpe_50k.json")), random.Random(13)
    text = "".join(chr(rnd.randrange(0x4E00, 0x4E00 + 3000)) for _ in range(700_000))  # two megabytes
    t = time.time()
    whole = c.enc.library.encode(text, add_special_tokens=False).ids
    library = time.time() - t
    raw, at, parts = text.encode(), 0, []
    for end in cuts(raw):
        parts.append(raw[at:end].decode())
        at = end
    ids = c.enc.encode(parts)
    t = time.time()
    got = c.join(ids)
    assert time.time() - t < 3 * library + 1 and np.array_equal(got, whole)


def test_joins_of_letters_of_many_scripts():
    import random
    import numpy as np
    import public_tokenizers
    from heliochron.llm.bpe import codec
    c, rnd = codec(public_tokenizers.path("byte_bpe_50k.json")), random.Random(14)
    letters = ["的一是不了人我在有他这中大来上国", "abcdefgh", "äöüßéèaeiouns", "あいうえおカキクケ", "абвгде", "한국어가나다", " .,!?'\n12", "'s're", " ", "🙂e\u0301"]
    for _ in range(1500):
        kinds = rnd.sample(letters, rnd.randint(1, 4))
        text = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(2, 300)))
        cut = sorted(rnd.sample(range(1, len(text)), min(rnd.randint(1, 12), len(text) - 1)))
        parts = [c.enc.encode([text[a:b]])[0] for a, b in zip([0, *cut], [*cut, len(text)])]
        assert np.array_equal(c.join(parts), c.enc.library.encode(text, add_special_tokens=False).ids), text


def test_language_scores_against_loops(spark):
    """Every score by plain counting: words first, then shorter and shorter runs."""
    import math
    import random
    from heliochron.llm.language import ORDER, identify, runs_of, train, words_of
    rnd = random.Random(15)
    langs = {"x": "abcde", "y": "cdefg", "z": "éèfgh"}
    word = lambda s: "".join(rnd.choice(s) for _ in range(rnd.randint(1, 6)))
    vocab = {k: [word(s) for _ in range(30)] for k, s in langs.items()}
    docs = [(i, " ".join(rnd.choice(vocab[k]) for _ in range(rnd.randint(1, 40))), k) for i in range(300) for k in [rnd.choice("xyz")]]
    docs += [(1000 + i, " ".join(word("abcdefghéq") for _ in range(9)), None) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learn = [(t, k) for i, t, k in docs if k and zlib.crc32(str(i).encode()) % 4 != 2]
    n = {}
    for t, k in learn:
        for w in words_of(t):
            for kind in range(ORDER + 1):
                for token in runs_of(w, kind) if kind else [w]:
                    c = n.setdefault((k, kind), Counter())
                    c[token] += 1

    def log(k, kind, token):
        c = n.get((k, kind), Counter())
        seen = c[token] if c[token] >= 2 else 0
        return math.log((seen + 0.5) / (sum(c.values()) + len(c) + 1))

    def plain(text):
        total = {k: 0.0 for k in "xyz"}
        for w in words_of(text):
            known = lambda kind, token: any(n.get((k, kind), Counter())[token] >= 2 for k in "xyz")
            if known(0, w):
                kind, tokens = 0, [w]
            else:
                kind, tokens = next(((m, r) for m in range(ORDER, 0, -1) if (r := [x for x in runs_of(w, m) if known(m, x)])), (1, []))
            for k in total:
                total[k] += sum(log(k, kind, x) for x in tokens) / max(1, len(tokens))
        best = max(sorted(total), key=total.get)
        return best, 1 / sum(math.exp(v - total[best]) for v in total.values())
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, train(df)).collect()}
    for i, text, _ in docs:
        if words_of(text):
            k, score = plain(text)
            assert got[i][0] == k and got[i][1] == pytest.approx(score), text


def test_machine_scores_against_all_pairs(spark):
    """The linear-time score equals the sum written out over all pairs, and the fit's gradient that of differences."""
    import numpy as np
    from heliochron.llm.quality import Machine, STRUCTURE
    rng = np.random.default_rng(17)
    buckets, rank = 64, 3
    m = Machine(0.3, rng.normal(size=buckets + len(STRUCTURE)), rng.normal(size=(buckets + len(STRUCTURE), rank)), rng.normal(size=len(STRUCTURE)),
                1 + rng.random(len(STRUCTURE)), buckets)
    for text in ["", "one", "Some words, some more words and some MORE.\n\nAnd 12 numbers!", "x " * 500, "é ü ß"]:
        idx, x = m.row(text)
        raw = m.bias + sum(m.linear[i] * v for i, v in zip(idx, x))
        raw += sum(float(m.factors[i] @ m.factors[j]) * x[a] * x[b] for a, i in enumerate(idx) for b, j in enumerate(idx) if a < b)
        assert m.score(text) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packing_learns_a_word_once(monkeypatch):
    """A hundred and twenty thousand different words stay with the worker from slice to slice."""
    from heliochron.llm import common, packing, tokens
    common.worker_state().pop("encoders", None)
    learned, learn = [], tokens.Encoder._learn
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, words: learned.append(len(words)) or learn(self, words))
    texts = [" ".join(f"w{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760 % 26)}" for i in range(120_000))] * 6
    made = [(r, len(ids)) for r, ids in packing.encode_slices(((i, t) for i, t in enumerate(texts)), P.path("byte_bpe_50k.json"), 1 << 18, keep=packing.KEEP)]
    assert len({n for _, n in made}) == 1 and len(made) == 6
    assert sum(learned) <= 120_001 + 6  # the first word of a text has no space before it
    common.worker_state().pop("encoders", None)


def test_language_scores_by_rows_of_one_table():
    """Sums over rows of a table, unknown words' rows behind it, whatever room they have; the model travels without them."""
    import pickle
    from heliochron.llm.language import Languages, runs_of
    r = np.random.default_rng(6)
    runs = sorted({x for w in ("abcab", "bca", "cabba") for n in range(1, 6) for x in runs_of(w, n)})
    words = ["abcab", "ab", "cc"]
    table = -10 * r.random((len(words) + len(runs), 3))
    at = {t: i + len(words) for i, t in enumerate(runs)}

    def word(w):
        if w in words:
            return table[words.index(w)]
        for n in range(5, 0, -1):
            found = [table[at[x]] for x in runs_of(w, n) if x in at]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(3)
    texts = [" ".join("".join(r.choice(list("abcd"), int(r.integers(1, 7)))) for _ in range(int(n))) for n in r.integers(1, 80, 60)]
    for room in (3, 40, 1000):
        model = Languages(["x", "y", "z"], {w: i for i, w in enumerate(words)}, at, table, room)
        for text in texts:
            total = np.zeros(3)
            for w, n in Counter(text.split()).items():
                total += n * word(w)
            name, score = model.predict(text)
            assert name == "xyz"[int(np.argmax(total))] and score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-12)
        assert len(pickle.loads(pickle.dumps(model)).memo) == 0 and len(model.memo) <= room
    assert model.predict("") == model.predict("12 !") == ("und", 0.0)


def test_candidates_are_fewer_than_nodes(spark):
    """A task links what candidates connect; members that resemble each other just below the similarity make no pairs to be joined."""
    from heliochron.llm import simhash
    from heliochron.llm.common import stored
    r = np.random.default_rng(23)
    vocab = np.array(["".join(r.choice(list("abcdefghij"), int(r.integers(3, 9)))) for _ in range(4000)])
    base, texts = r.choice(vocab, 400), []
    for _ in range(120):  # about 0.72 alike, one to four
        c = base.copy()
        at = int(r.integers(0, 360))
        c[at:at + 34] = r.choice(vocab, 34)
        texts.append(" ".join(c))
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    alike = [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    near = sum(len(a & b) >= 0.6 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert near > 3000 and len(alike) > 50
    label = list(range(120))
    for _ in range(120):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = stored(simhash.sketches(docs), "sketches")
    fps = own.select(F.lit(0).alias("tree"), F.shiftleft(F.col("keys")[0], 32).alias("fp"), "node", F.col("node").alias("grp"), "n", "sketch")
    assert 0 < simhash.candidates(fps, 32, 90, 0.8).count() < 120
    assert simhash.near_links(docs, own).count() < 120
    assert sorted(x.doc_id for x in simhash.drop_near_copies(docs).collect()) == sorted(set(label))
    parts = own.select("node", F.lit(1).alias("root"))
    blocks = simhash.alike(docs, own, parts, 90, 0.8, block=20_000)  # dealt out: every two blocks meet
    from heliochron.llm.graph import components
    assert components(blocks).select("root").distinct().count() + 120 - len({x for p in alike for x in p}) == len(set(label))


def test_key_halves_find_what_all_pairs_find():
    """Tries that begin with either half of a key, with half the differing bits there, find all pairs of near keys."""
    from heliochron.llm.simhash import walk
    r = np.random.default_rng(24)
    keys = np.unique(r.integers(0, 1 << 32, 600, dtype=np.uint64))
    keys = np.unique(np.concatenate([keys, keys[:300] ^ sum((np.uint64(1) << r.integers(0, 32, 300, dtype=np.uint64) for _ in range(5)), np.uint64(0))]))
    want = {(i, j) for i in range(len(keys)) for j in range(i) if int(keys[i] ^ keys[j]).bit_count() <= 5}
    got = set()
    for turned in (keys, ((keys & np.uint64(0xFFFF)) << np.uint64(16)) | (keys >> np.uint64(16))):
        order = np.argsort(turned)
        fp = turned[order] << np.uint64(32)
        for x, y in walk(fp, fp, 0, 0, 5, True, brute=1, counted=32, first=(16, 2)):
            got |= {(max(order[i], order[j]), min(order[i], order[j])) for i, j in zip(x.tolist(), y.tolist())}
    assert got == want and len(want) > 100
