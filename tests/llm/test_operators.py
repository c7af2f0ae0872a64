"""Each operator against a brute-force version, an exact round trip, or held-out accuracy, and its edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandframe.llm import bpe, caps, cotrain, hamming, id_files, langid, mixing, simhash, substring, token_counts
from strandframe.llm._common import HashTable, sieve
from strandframe.llm.classify import Sparse, features, metadata
from strandframe.llm.queries import BYTE_BPE, PATTERN, PIECES, QUERIES, WORD_BPE

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, key string"
SF = "/root/testdata/sf0.001"
ODD = [(None, "a b c d e", None, None, None, 1, "x"), (1, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, "x"), (3, "a b c d e f", "en", "s", 1, 1, "x"), (3, "a b c d e f", "en", "s", 1, 1, "x"), (9, " x\n\ta b c d ", "de", "t", 1, 1, "x"), (4, "ab" * 6000 + " é" * 3000, "en", "s", 1, 1, "x"), (5, "?! 12", "en", "s", 1, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_byte_bpe_is_tiktoken(spark, docs, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    mess = ["".join(rng.choice(["a", "the", " ", "\n", "\x1c", "é", "中", "'s", "9", "!", "\U0001f600", "　"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["a" * 5000, " " * 3000]
    own = bpe.ByteBpe(BYTE_BPE, PATTERN)
    ids, n = own.encode_texts(mess)
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [enc.encode_ordinary(x) for x in mess]
    for df in (docs, odd):
        texts = sorted(((i, t or "") for i, t in df.select("doc_id", "text").collect()), key=repr)
        got = sorted((tuple(r) for r in bpe.bpe_digests(df, BYTE_BPE, PATTERN).collect()), key=repr)
        want = [(i, len(x := enc.encode_ordinary(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
        assert got == sorted(want, key=repr)
    back = bpe.bpe_decode(bpe.bpe_encode(odd, BYTE_BPE, PATTERN), BYTE_BPE, PATTERN)
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((r[1] or "").encode() for r in ODD)
    assert bpe.bpe_digests(odd.limit(0), BYTE_BPE, PATTERN).count() == 0


def test_id_files_round_trip(spark, docs, odd):
    tok = Tokenizer.from_file(WORD_BPE)  # as the library has it
    marks = [t.content for t in tok.get_added_tokens_decoder().values()]
    assert marks
    rng = random.Random(10)
    quoting = [(10**6 + i, " ".join(rng.choice(["x", "The", "end.", "é", "<|", "|>", *marks, *(m.upper() for m in marks), *(m[1:] for m in marks), f"a{marks[0]}b", f"{marks[-1]}{marks[0]}"]) for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    quoting += [(2 * 10**6, "long " * 30_000 + marks[0]), (2 * 10**6 + 1, "ab" * 50_000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(quoting, "doc_id long, text string"))
    start, want = 0, []
    for i, t in sorted(both.collect()):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, id_files.id_file_digests(both, WORD_BPE).collect())) == want
    got = id_files.id_file_digests(odd, WORD_BPE).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 4, 5, 9] and got[0]["start"] == 0
    assert id_files.id_file_digests(odd.limit(0), WORD_BPE).count() == 0


def test_id_files_deal_hot_ids(spark, tmp_path):
    """Null ids and one id with most of the rows fill several shards, and every document is read back once, in order."""
    n = 900
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"w{i} text") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = id_files.write_id_files(df, WORD_BPE, f"file://{tmp_path}/a", shards=9).collect()
    assert max(r["docs"] for r in made) < n / 4 and sum(r["docs"] for r in made) == n
    back = id_files.read_id_files(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    tok = Tokenizer.from_file(WORD_BPE)
    crc = lambda t: zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in back) == sorted((str(i), crc(t)) for i, t in rows)
    alone = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert [r["doc_id"] for r in id_files.id_file_digests(alone, WORD_BPE).collect()] == [None, None]


def test_elias_fano():
    x = np.sort(np.random.default_rng(0).integers(0, 10**6, 3000))
    e = id_files.EliasFano.of(x)
    assert [e.select(i) for i in range(0, 3000, 13)] == x[::13].tolist()
    assert (e.select_range(500, 1700) == x[500:1700]).all()
    assert (len(e.low) + len(e.high)) * 8 <= 3000 * (2 + np.ceil(np.log2(10**6 / 3000)) + 1)
    assert id_files.EliasFano.of(np.zeros(5, int)).select(4) == 0


@pytest.mark.parametrize("crowd", [256, 1])
def test_substrings_match_brute_force(spark, docs, odd, crowd):
    for df, window, mer in ((docs, 50, 10), (odd, 3, 2)):
        got = substring.dedup_substrings(df, window, mer, crowd).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        want = substring.brute_force([tuple(r) for r in df.select("doc_id", "text").collect()], window)
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert substring.substring_digests(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [256, 2])
def test_substrings_with_crowds_and_repeated_ids(spark, crowd):
    """A passage that most documents share in other surroundings, copies of one row, one doc_id with several texts, words that go on and on."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for i in range(120):
        own = [word() for _ in range(rng.randrange(0, 25))]
        at = rng.randrange(len(own) + 1)
        a, b = sorted(rng.sample(range(31), 2))
        texts.append((i if i % 10 else 7, " ".join(own[:at] + passage[a:b] + own[at:])))
    texts += [(500, texts[3][1])] * 40 + [(3, "x " * 60), (4, "x " * 90 + "y"), (501, "x " * 4000)]
    df = spark.createDataFrame([(*r, 1, "s1") for r in texts], "doc_id long, text string, start int, mz string")
    got = substring.dedup_substrings(df, 6, 3, crowd).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(substring.brute_force(texts, 6))


def plain_fingerprint(text):
    """By the contract, word for word: A-Z lowered, words between the six ASCII spaces, 4-word shingles with repeats, XXH64 with seed 42, a bit if over half have it."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_by_the_contract(spark, docs):
    rng = random.Random(61)
    texts = ["", " \t", "one", "One two\x0bTHREE", "ÄÖ É İ ǅ K", "a\u00a0b c\x1cd e", "x " * 300, None]
    texts += [" ".join(rng.choice(["A", "b", "Ç", "the", "THE", "\u2003", "ı", "end.", "7"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.limit(60).selectExpr("doc_id + 1000 AS doc_id", "text"))
    want = {r["doc_id"]: f"{plain_fingerprint(r['text']):016x}" for r in df.collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(df, 4, 4).collect()} == want


def test_simhash_matches_all_pairs(spark, odd):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(40)]
    texts = [(i, t if rng.random() < 0.4 else t.replace(t[:7], "zz yy", 1)) for i, t in enumerate(base * 3)]
    for rows in (texts, [(r[0], r[1]) for r in ODD if r[0] is not None]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        fp = [(i, plain_fingerprint(t)) for i, t in rows]
        of = {i: i for i, _ in fp}
        for _ in fp:
            for i, a in fp:
                for j, b in fp:
                    if (a ^ b).bit_count() <= 4:
                        of[i] = min(of[i], of[j])
        got = simhash.near_duplicates(df, 4, 4).collect()
        assert {tuple(r) for r in got} == {(i, f"{a:016x}", of[i]) for i, a in fp} and len(got) == len(rows)
    assert simhash.near_duplicates(odd, 4, 4).where("doc_id is null").first()["component_id"] is None
    assert simhash.near_duplicates(odd.limit(0), 4, 4).count() == 0


def test_hot_bucket_blocks_lose_nothing(spark):
    from strandframe.llm.buckets import in_buckets

    import pyarrow as pa

    def kernel(table, pairs):
        n = sum(len(a) for a, _ in pairs)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df = spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id").alias("node"))
    assert in_buckets(df, kernel, "n long", block=7).agg(F.sum("n")).first()[0] == 34 * 33 // 2 + 2 * (33 * 32 // 2)


def test_language_held_out_accuracy(spark, docs, odd):
    got = langid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PIECES).where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 0
    rows = langid.identify(odd, PIECES).collect()
    assert len(rows) == len(ODD) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 5)) and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(odd.limit(0), PIECES).count() == 0


def segmentations(word, pieces):
    if not word:
        return [[]]
    return [[x, *rest] for x in pieces if word.startswith(x) for rest in segmentations(word[len(x) :], pieces)]


def test_segmentations_against_enumeration():
    """Word probabilities and expected piece counts against all segmentations, one by one, for two languages."""
    rng = random.Random(31)
    pieces = sorted({"▁", "a", "b", "c", *("▁" * rng.randrange(2) + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25))})
    g = np.random.default_rng(31)
    p = g.dirichlet(np.ones(len(pieces)), 2).T
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(30)]
    weight = g.integers(0, 4, (len(words), 2)).astype(float)
    model, finder = langid.LanguageModel(["x", "y"], np.ones(2) / 2, pieces, p), langid.Pieces(pieces)
    number, want = {x: i for i, x in enumerate(pieces)}, np.zeros((len(pieces) + 2, 2))
    for w, n, got in zip(words, weight, model.score_words(finder, words)):
        ways = segmentations("▁" + w, pieces)
        q = np.array([np.prod([p[number[x]] for x in way], axis=0) for way in ways])
        assert np.allclose(got, np.log(q.sum(axis=0)))
        for way, r in zip(ways, q / q.sum(axis=0)):
            for x in way:
                want[number[x]] += n * r
    assert np.allclose(langid.expected_pieces(finder, model.table(), words, weight), want)


def test_languages_of_ties_and_long_words(spark):
    model = langid.LanguageModel(["aa", "bb"], np.ones(2) / 2, ["▁", "x"], np.full((2, 2), 0.5))
    long = "x" * 100_000
    df = spark.createDataFrame([(1, "x xx"), (2, long), (2, long), (None, "é"), (3, "1 2")], "doc_id long, text string").selectExpr("*", "1 AS lang_pred_", "2 AS id")
    got = sorted((tuple(r) for r in langid.predict(df, model).drop("foreign").collect()), key=repr)
    assert got == sorted([(1, "aa", 0.5), (2, "aa", 0.5), (2, "aa", 0.5), (None, "aa", 0.5), (3, "und", 0.0)], key=repr)
    finder, word = langid.Pieces(["▁", "a", "ab", "b"]), "ab" * 700
    other = langid.LanguageModel(["x"], np.ones(1), ["▁", "a", "ab", "b"], np.array([[0.1], [0.2], [0.3], [0.4]]))
    assert np.isclose(other.score_words(finder, [word])[0, 0], np.log(0.1) + 700 * np.log(0.3 + 0.2 * 0.4))


def test_cap_decoding_finds_all_filters():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for blocks in (1, 2, 3):
        c = caps.ProductCode(24, 6, blocks, 0.45, 5)
        y = x @ c.rotation
        sums = np.zeros((200, 1))
        for a, b, w in zip(c.cuts, c.cuts[1:], c.code):
            sums = (sums[:, :, None] + (y[:, a:b] @ w.T)[:, None, :]).reshape(200, -1)
        want = {(int(i), int(f)) for i, f in zip(*np.nonzero(sums >= 0.45))}
        want |= {(int(i), int(sums[i].argmax())) for i in np.flatnonzero(~(sums >= 0.45).any(axis=1))}
        assert set(zip(*(v.tolist() for v in c.decode(x)))) == want


def link_counts(x, least=0.95):
    d = x.astype(float)
    n = np.linalg.norm(d, axis=1)
    return ((d @ d.T) / n / n[:, None] >= least).sum(axis=1) - 1


@pytest.mark.parametrize("block", [caps.BLOCK, 16])
def test_caps_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 32))
    x = np.concatenate([x, x[:100] + 0.25 * rng.normal(size=(100, 32)), x[:30], x[140] + 0.1 * rng.normal(size=(60, 32))]).astype(np.float32)
    rows = [(i, v.tolist(), "k") for i, v in enumerate(x)] + [(900, None, ""), (901, [0.0] * 32, ""), (902, [float("nan")] * 32, ""), (903, [None] * 32, ""), (904, [], ""), (905, [1.0, 2.0], ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = {r["vec_id"]: r for r in caps.near_vectors(df.withColumn("copies", F.lit(1))).collect()}
    links = link_counts(x)
    assert len(got) == len(rows) and sum(got[i]["n_links"] for i in range(len(x))) >= 0.97 * links.sum() > 0
    assert all(got[i]["n_links"] <= links[i] for i in range(len(x))) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert {got[i]["component_id"] for i in range(280, 340)} == {140}
    assert caps.near_vectors(df.limit(0)).count() == 0
    twice = [tuple(r) for r in caps.near_vectors(spark.createDataFrame([(1, [1.0, 2.0, 0.5], 0), (1, [1.0, 2.0, 0.5], 0), (2, [-1.0, 0.5, 3.0], 0)], "vec_id long, embedding array<double>, h int")).collect()]
    assert sorted(twice) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_caps_decide_in_double_precision(spark):
    """Cosines so near the least one that only double precision tells them."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for i in range(40):
        u, v = rng.normal(size=(2, 48))
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        c = 0.95 + (1e-7 if i % 2 else -1e-7)
        w = 3.0 * (c * u + np.sqrt(1 - c * c) * v)
        rows += [(2 * i, u.tolist()), (2 * i + 1, w.tolist())]
        want[2 * i] = i % 2
    got = {r["vec_id"]: r["n_links"] for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = {i: got[i] for i in want}
    assert all(found[i] <= n for i, n in want.items()) and sum(found.values()) >= 0.9 * sum(want.values())


def test_caps_miss_nothing_if_exact(spark, monkeypatch):
    """Many pairs barely near enough: filters alone miss some of them. The rows of a block are few, so that all vectors are several."""
    monkeypatch.setattr(caps, "BLOCK", 1000)
    rng = np.random.default_rng(8)
    u, v = rng.normal(size=(2, 2500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (v * u).sum(axis=1, keepdims=True) * u
    w = 0.9501 * u + np.sqrt(1 - 0.9501**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(2 * i + k, x[i].tolist()) for k, x in enumerate((u, w)) for i in range(len(u))] + [(9000, [1.0, 2.0]), (9001, [1.0, 2.1]), (9002, None)], "vec_id long, embedding array<double>")
    links = link_counts(np.stack([u, w], axis=1).reshape(-1, 64)).tolist()
    got = {r["vec_id"]: r for r in caps.near_vectors(df, exact=True).collect()}
    assert [got[i]["n_links"] for i in range(5000)] == links and [got[i]["component_id"] for i in range(5000)] == [i // 2 * 2 for i in range(5000)]
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(9000, 9003)] == [(1, 9000), (1, 9000), (0, 9002)]
    assert sum(r["n_links"] for r in caps.near_vectors(df).collect()) < sum(links) + 2


def test_caps_of_wide_and_mixed_vectors(spark):
    rng = np.random.default_rng(11)
    rows, near = [], {}
    for dim in (3, 64, 4100, 5000):
        x = rng.normal(size=(3, dim))
        for i, v in enumerate((x[0], x[0] + 1e-3 * x[1], x[2])):
            near[len(rows)] = int(i < 2)
            rows.append((len(rows), v.tolist()))
    rows.append((99, rows[6][1][:4099]))
    got = {r["vec_id"]: r for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: got[i]["n_links"] for i in near} == near and got[99]["n_links"] == 0
    assert [got[i]["component_id"] for i in range(12)] == [0, 0, 2, 3, 3, 5, 6, 6, 8, 9, 9, 11]


def test_wide_rotations_keep_angles():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 1500))
    code = caps.Filters(1500, 50, 0.95).codes[0]
    y = code.rotate(x)
    assert y.shape == (20, 2048) and np.allclose(y @ y.T, x @ x.T)


@pytest.mark.parametrize("shard, full, block", [(hamming.SHARD, hamming.FULL, hamming.QUERIES), (16, 64, 9)])
def test_hamming_is_exact(spark, monkeypatch, shard, full, block):
    for name, value in (("SHARD", shard), ("FULL", full), ("QUERIES", block)):
        monkeypatch.setattr(hamming, name, value)
    rng = np.random.default_rng(6)
    codes = rng.integers(-(2**63), 2**63 - 1, 400)
    codes = np.concatenate([codes, codes[:50] ^ 5, codes[:20], [7] * 30])  # near codes, repeated ones, and one that many rows have
    rows = spark.createDataFrame([(i, int(c), 1, "s") for i, c in enumerate(codes)] + [(None, 1, 1, ""), (999, None, 1, "")], "id long, code long, shard int, q string")
    asked = rows.where("id % 10 = 0")
    got = hamming.nearest_codes(rows, asked, 5).orderBy("query_id", "rank").collect()
    want = []
    for q in range(0, len(codes), 10):
        d = np.bitwise_count(codes.view(np.uint64) ^ codes.view(np.uint64)[q]).astype(int)
        want += [(q, r + 1, int(i), int(d[i])) for r, i in enumerate(np.lexsort((np.arange(len(d)), d))[:5])]
    assert [tuple(r) for r in got] == want
    twice = hamming.nearest_codes(rows, asked.unionByName(asked.where("id = 20")), 5).where("query_id = 20").orderBy("rank").collect()
    assert [tuple(r) for r in twice] == [w for w in want if w[0] == 20 for _ in (0, 1)]
    assert len(hamming.nearest_codes(rows.where("id < 3"), asked.where("id = 0"), 5).collect()) == 3
    assert hamming.nearest_codes(rows.limit(0), rows, 5).count() == 0 == hamming.nearest_codes(rows, rows.limit(0), 5).count()


@pytest.mark.parametrize("shard, full", [(hamming.SHARD, hamming.FULL), (8, 32)])
def test_hamming_of_long_and_mixed_vectors(spark, monkeypatch, shard, full):
    monkeypatch.setattr(hamming, "SHARD", shard)
    monkeypatch.setattr(hamming, "FULL", full)
    rng = np.random.default_rng(12)
    x = [rng.normal(size=n) for n in [128] * 60 + [200] * 20 + [64] * 20 + [3] * 5] + [np.full(130, -1.0), np.zeros(0)]
    x += [x[0] * 2, np.concatenate([x[70][:190], -x[70][190:]])]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 200)], "vec_id long, embedding array<double>")
    codes = hamming.sign_codes(rows)
    got = hamming.nearest_codes(codes, codes.where("id % 7 = 0"), 4).orderBy("query_id", "rank").collect()
    bits = [sum(1 << i for i, c in enumerate(v) if c > 0) for v in x]
    want = [(q, r + 1, i, d) for q in range(0, len(x), 7) for r, (d, i) in enumerate(sorted(((bits[q] ^ b).bit_count(), i) for i, b in enumerate(bits))[:4])]
    assert [tuple(r) for r in got] == want


def test_sections(spark, docs, odd):
    enc = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc.encode_special_tokens = True
    for rule in token_counts.RULES:
        got = token_counts.section_tokens(docs, BYTE_BPE, PATTERN, rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
        want = {i: len(enc.encode(t, add_special_tokens=False).ids) for i, t in docs.select("doc_id", "text").collect()}
        assert {r["doc_id"]: round(r["n"], 6) for r in got} == want
    text = spark.createDataFrame([(1, "hello world", [(0, 7), (7, 11)])], "doc_id long, text string, s array<struct<start:int,end:int>>")
    counts = lambda rule: [r["n_tokens"] for r in token_counts.section_tokens(text, BYTE_BPE, PATTERN, "s", rule).orderBy("section").collect()]
    assert counts("majority") == [1, 1] and counts("first") == [2, 0] and np.allclose(counts("split"), [1 + 2 / 6, 4 / 6])
    assert token_counts.section_tokens(odd.where("text is null or text = ''"), BYTE_BPE, PATTERN).count() == 0


def plain_sections(enc, text, sections, rule):
    """Tokens of each section, one token after another and character by character."""
    at, raw, where = 0, text.encode(), []
    for i, c in enumerate(text):
        where += [i] * len(c.encode())
    counts, crossing, outside = [0.0] * len(sections), [0] * len(sections), 0
    for b in enc.decode_tokens_bytes(enc.encode_ordinary(text)):
        chars = sorted(set(where[at : at + len(b)]))
        at += len(b)
        share = {k: n for k, (x, y) in enumerate(sections) if (n := sum(x <= c < y for c in chars))}
        if not share:
            outside += 1
        elif len(share) == 1:
            counts[next(iter(share))] += 1
        else:
            for k in share:
                crossing[k] += 1
            if rule == "split":
                for k, n in share.items():
                    counts[k] += n / sum(share.values())
            else:
                counts[min(share) if rule == "first" else max(share, key=lambda k: (share[k], -k))] += 1
    assert at == len(raw)
    out = {k: (x, y - x, counts[k], crossing[k]) for k, (x, y) in enumerate(sections)}
    return out | ({-1: (0, 0, float(outside), 0)} if outside else {})


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_token_by_token(spark, rule):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(71)
    rows = []
    for i in range(120):
        text = "".join(rng.choice(["hello", " world", "é", "中文", "\n", " ", "the quick", "😀", "12345", "!!", "  "]) for _ in range(rng.randrange(1, 25)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randrange(0, 9)) // 2 * 2))
        sections = list(zip(cuts[::2], cuts[1::2]))
        if rng.random() < 0.5 and sections:  # next to each other
            sections = [(a, b) for a, b in zip(cuts, cuts[1:])]
        rows.append((i, text, [x for x in sections if x[0] < x[1]], "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<start:int,end:int>>, section string")
    got: dict = {}
    for r in token_counts.section_tokens(df, BYTE_BPE, PATTERN, "s", rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["n_chars"], round(r["n_tokens"], 9), r["n_crossing"])
    for i, text, sections, _ in rows:
        want = plain_sections(enc, text, sections, rule)
        assert got.get(i, {}) == {k: (a, b, round(c, 9), d) for k, (a, b, c, d) in want.items()}, (i, text, sections)


def nnls_cost(a, goal, metric):
    """Least squares of a @ r - goal in a metric over r >= 0, one coordinate after another until nothing moves."""
    r, gap = np.ones(a.shape[1]), a.sum(axis=1) - goal
    curve = np.einsum("ki,kl,li->i", a, metric, a)
    for _ in range(20_000):
        moved = 0.0
        for i in np.flatnonzero(curve > 0):
            to = max(0.0, r[i] - a[:, i] @ metric @ gap / curve[i])
            gap, moved, r[i] = gap + a[:, i] * (to - r[i]), max(moved, abs(to - r[i]) * np.sqrt(curve[i])), to
        if moved < 1e-10:
            break
    return float(gap @ metric @ gap)


@pytest.mark.parametrize("goal, keep, alpha", [((0.2, 0.4, 0.4), 32, (0.5, 0.2, 0.1)), ((0.2, 0.3, 0.5), 5, (0.5, 0.2, 0.1)), ((0.2, 0.4, 0.4), 32, (8, 1, 0.4))])
def test_mixing_against_nnls(spark, goal, keep, alpha):
    rng = np.random.default_rng(12)
    n, goal = 120, np.array(goal)
    t, p = rng.integers(0, 400, n), rng.dirichlet(alpha, n)
    soft = spark.createDataFrame([(i, int(x), q.tolist()) for i, (x, q) in enumerate(zip(t, p))], "doc_id long, n_tokens long, posterior array<double>").coalesce(1)
    done, reached = mixing.solve(soft, goal, keep=keep, patience=25)
    got = done.orderBy("doc_id").toPandas()
    a = (p * t[:, None]).T / t.sum()
    assert (got.rate >= 0).all() and np.allclose(a @ got.rate.to_numpy(), reached)
    moments = a @ p
    metric = np.linalg.inv(moments + 1e-4 * np.trace(moments) * np.eye(3))
    best, gap = nnls_cost(a, goal, metric), reached - goal
    if alpha[0] == 8:  # every document is mostly of the first domain: no rates reach the targets
        assert best > 1e-3 and gap @ metric @ gap <= best * 1.1 and np.abs(gap).max() > 1e-3
    else:
        assert best < 1e-8 and np.abs(gap).max() <= 1e-3
    with pytest.raises(RuntimeError, match="no rates found"):
        mixing.solve(soft, goal, rounds=1)


def test_mixing_meets_targets(spark, docs, odd, labels):
    for targets in (None, {"plain": 0.2, "poor": 0.4, "toxic": 0.4}):
        r = mixing.mix(docs, labels, targets).toPandas()
        for d, goal in (targets or mixing.TARGETS).items():
            assert abs((r.rate * r.n_tokens * r[f"p_{d}"]).sum() / r.n_tokens.sum() - goal) <= 1e-3
        assert (r.rate >= 0).all() and r.share_gap.max() <= 1e-3
    assert mixing.mix(odd, labels).count() == len(ODD) and mixing.mix(odd.limit(0), labels).count() == 0
    lost = mixing.mix(odd, labels.limit(0)).toPandas()
    assert len(lost) == len(ODD) and (lost.share_gap > 0.1).all()
    clash = labels.selectExpr("doc_id", "quality", "toxic", "doc_id AS text", "1 AS label", "0 AS y")
    doubled = clash.unionByName(clash.limit(20)).unionByName(clash.limit(9).selectExpr("doc_id", "null AS quality", "toxic", "text", "label", "y"))
    assert mixing.mix(docs.withColumn("label_quality", F.lit(1)), doubled).count() == docs.count()


def test_cotraining_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = cotrain.score(docs, cotrain.train(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert (r.quality_pred == r.quality).mean() >= 0.95
    assert cotrain.score(odd, cotrain.train(odd, labels)).count() == len(ODD) and cotrain.score(odd.limit(0), cotrain.train(odd, labels.limit(0))).count() == 0
    some = docs.limit(200)
    clash = labels.selectExpr("doc_id", "quality", "doc_id AS text", "1 AS source", "2 AS y", "true AS test")
    mixed = clash.unionByName(clash.limit(30)).unionByName(clash.limit(20).selectExpr("doc_id", "null AS quality", "text", "source", "y", "test"))
    assert cotrain.score(some, cotrain.train(some, mixed)).count() == 200


def test_views_are_apart(spark):
    """The metadata view doesn't change with the text, nor the content view with the metadata."""
    rows = [(1, "one text here", "en", "s", 10), (2, "Quite ANOTHER 77\ntext", "en", "s", 10), (3, "one text here", "de", "t", 9999)]
    a, b, c = features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), ["doc_id"], cotrain.PAGE).orderBy("doc_id").collect()
    assert a["page"] == b["page"] != c["page"] and a["content"] == c["content"] != b["content"]
    assert len(metadata(None, None, None)) == 0 and len(metadata("s", "en", "12")) == 6


def test_cotraining_pool_is_every_unlabelled_document(spark, odd):
    rng = random.Random(8)
    n = 6000  # more than the 5,000 once sampled
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghij", k=5)), "de", rng.choice("st"), rng.randrange(900)) for i in range(n)] + [(None, "a", "de", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    pool = cotrain.unlabelled(docs, spark.createDataFrame([(i, None) for i in range(0, n, 10)] + [(None, 1), (1, 1)], "doc_id long, quality int")).cache()
    rows = pool.collect()
    assert len(rows) == n - n // 10 - 1
    x = [Sparse([np.frombuffer(r[c], "<i4") for r in rows], width) for c, width in zip(("content", "page"), cotrain.WIDTHS)]
    g = np.random.default_rng(8)
    views = [(g.normal(size=w) * 3, 0.1) for w in cotrain.WIDTHS]
    z = [cotrain.log_odds(*views[v], x[v]) for v in (0, 1)]
    counts, least, bounds = cotrain.histogram(pool, views, 1.0), 1.0, []
    for v in (0, 1):
        assert [sum(counts[v][k].values()) for k in (1, 0)] == [(z[v] >= 1).sum(), (z[v] <= -1).sum()]
        bounds.append({k: cotrain.threshold(counts[v][k], 300) for k in (1, 0)})
    y = [cotrain.pseudo_labels(z[1 - v], bounds[1 - v], least) for v in (0, 1)]
    for v in (0, 1):
        for k, q in ((1, z[1 - v]), (0, -z[1 - v])):
            best = np.sort(q)[::-1]
            floor = max(1.0, np.floor(best[299] * 256) / 256)
            assert set(np.flatnonzero(y[v] == k)) == set(np.flatnonzero(q >= floor))
    pseudo = cotrain.exchanged(pool, [(views, bounds)], least)
    assert pseudo.count() == ((y[0] >= 0) | (y[1] >= 0)).sum() > 0
    for v, got in enumerate(cotrain.gradient_sums(pseudo, views)):
        some = np.flatnonzero(y[v] >= 0)
        part = Sparse([np.frombuffer(rows[i][("content", "page")[v]], "<i4") for i in some], cotrain.WIDTHS[v])
        assert np.allclose(got, cotrain.gradient(*views[v], part, y[v][some], 0.5), rtol=1e-4, atol=1e-4)
    assert cotrain.unlabelled(odd.limit(0), odd.select("doc_id")).count() == 0


def test_cotraining_bounds_the_tasks_of_a_gradient(spark):
    """Each task sends a sum, however few its rows, so many small partitions are gathered; the sums stay the same."""
    g = np.random.default_rng(2)
    rows = [(*(np.unique(g.integers(0, w, 20)).astype("<i4").tobytes() for w in cotrain.WIDTHS), int(g.integers(-1, 2)), int(g.integers(0, 2))) for _ in range(200)]
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // cotrain.SPARE)
    one = spark.createDataFrame(rows, "content binary, page binary, y0 int, y1 int").coalesce(1)
    many = one.repartition(most + 20)
    assert cotrain.gathered(many).rdd.getNumPartitions() == most
    views = [(g.normal(size=w), 0.1) for w in cotrain.WIDTHS]
    for a, b in zip(cotrain.gradient_sums(many, views), cotrain.gradient_sums(one, views)):
        assert a.any() and np.allclose(a, b, rtol=1e-4, atol=1e-4)


FOREIGN = [
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
    "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem",
    "все люди рождаются свободными и равными в своем достоинстве и правах",
]


@pytest.fixture(scope="module")
def stages():
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    return [f for _, f in corpus_pipeline.STAGES], corpus_pipeline.COLUMNS


def test_pipeline_stages_against_brute_force(spark, labels, stages, tmp_path):
    (language, near_copies, passages, mixture, tokens), columns = stages
    rng = random.Random(81)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = [r["text"] for r in docs.where("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    gibberish = [" ".join("".join(rng.choice("bcdfghjkqvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(40)) for _ in range(3)]
    planted = [(10_000 + i, x) for i, x in enumerate([*FOREIGN, *gibberish, None, "", "12 !? 34"])]
    short = [(20_000 + i, " ".join(x.split()[5:9])) for i, x in enumerate(prose)]
    copies = [(30_000 + i, x + " ") for i, x in enumerate(prose)] + [(30_500 + i, " ".join(x.split()[:-1])) for i, x in enumerate(prose)]
    twice = [(40_000, prose[0] + " " + prose[1]), (40_000, prose[2] + " " + prose[3]), (40_001, " ".join(prose[5].split()[:55]))] * 2
    more = spark.createDataFrame([(i, x, None if 10_000 <= i < 20_000 else "en", "planted", len(x or "")) for i, x in planted + short + copies + twice], docs.select(*columns).schema)
    now = keep = docs.select(*columns).unionByName(more.select(*columns))

    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    seen = sorted(map(tuple, now.collect()), key=repr)
    now = stored(language(spark, now, SF), "language")
    assert now.columns == columns
    # foreign, gibberish, null, empty and letterless texts go; all that the table has by itself stays, short ones too
    assert sorted(map(tuple, now.collect()), key=repr) == sorted((r for r in seen if not 10_000 <= r[0] < 20_000 and re.search(r"[^\W\d_]", r[1] or "")), key=repr)

    rows = sorted(map(tuple, now.collect()), key=repr)
    now = stored(near_copies(spark, now, SF), "near")
    fp = [(r[0], plain_fingerprint(r[1])) for r in rows]
    near = {i: {j for j, b in fp if any((a ^ b).bit_count() <= 4 for k, a in fp if k == i)} for i, _ in fp}
    root = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += near[j]
    want = {r[:2] for r in rows if root[r[0]] == r[0]}
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == sorted(want) and len(want) < len({r[:2] for r in rows})

    rows = [tuple(r) for r in now.collect()]
    now = stored(passages(spark, now, SF), "passages")
    left = {}
    for (i, total, gone, digest), r in zip(substring.brute_force([r[:2] for r in rows], 50), rows):
        if total > gone:
            left.setdefault(i, []).append((digest, gone, r[1], r[2:4]))
    got = {}
    for r in now.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(left) and any(g for x in left.values() for _, g, _, _ in x)
    for i, own in left.items():
        mine = sorted((hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest(), (r["lang"], r["source"])) for r in got[i])
        assert mine == sorted((d, about) for d, _, _, about in own)
        assert all(any(r["text"] == text and r["n_chars"] is not None for r in got[i]) for _, gone, text, _ in own if not gone)

    other = [r["text"] for r in now.orderBy(F.length("text").desc()).limit(3).collect()]
    two = spark.createDataFrame([(50_000, x, "en", "planted", len(x)) for x in (other[0] + " one", other[1] + " two", other[2] + " two", "?? !")] + [(50_001, other[0] + " one", "en", "planted", 9)] * 2, now.schema)
    now = now.unionByName(two)  # texts that share an id, and equal rows
    rates = {(r["doc_id"], r["text"]): (r["copies"], r["rate"]) for r in mixing.mix(now, labels, carry=("text",)).collect()}
    assert len({x for (i, _), (_, x) in rates.items() if i == 50_000}) > 1
    before = [(r["doc_id"], r["text"]) for r in now.collect()]
    now = stored(mixture(spark, now, SF), "mixture")
    assert now.columns == columns and sorted((r["doc_id"], r["text"]) for r in now.collect()) == sorted(i for i in before for _ in range(rates[i][0]))
    assert all(np.floor(x) <= n <= np.ceil(x) for n, x in rates.values())

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(r["doc_id"], len(x := enc.encode_ordinary(r["text"])), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in now.collect()]
    assert sorted(tuple(r) for r in tokens(spark, now, SF).collect()) == sorted(want)
    assert keep.count() == len(seen)


def test_pipeline_on_odd_and_empty_tables(spark, odd, stages, tmp_path):
    (*first, tokens), columns = stages
    for name, docs in (("odd", odd.withColumnRenamed("id", "copies").withColumnRenamed("key", "n_removed")), ("none", odd.limit(0))):
        for k, stage in enumerate(first):
            out = stage(spark, docs, SF)
            assert out.columns == columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k == 0:
                assert {r["doc_id"] for r in docs.collect()} <= {3, 4, 9}  # the others have no id, no text or no letter
        assert tokens(spark, docs, SF).count() == docs.count()


def test_helpers(spark):
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    t = HashTable(keys, np.arange(len(keys)))
    assert (t.get(keys) == np.arange(len(keys))).all() and (t.get(keys + np.uint64(1)) <= 0).mean() > 0.99
    a = spark.range(1000).withColumnRenamed("id", "k")
    marked = sieve(a.where("k < 100"), "k")(a)
    assert marked.where("k < 100 and not maybe").count() == 0 and marked.where("maybe").count() < 300
    assert set(QUERIES) >= {"op4_byte_bpe", "op10_id_files"}
