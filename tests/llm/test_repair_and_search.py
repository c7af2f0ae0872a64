"""Conversation repair, the tokenization automaton and ranked search against brute-force versions and the library."""

import hashlib
import math
import random
import re
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandframe.llm import conversations, lexical, token_automaton
from strandframe.llm.queries import BYTE_MERGES, PATTERN, table

SF = "/root/testdata/sf0.001"
sys.setrecursionlimit(20_000)
TURNS = "conv_id long, turn long, role string, text string, at long, code int, edit string"


def next_of(known, role):
    return {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((known, role))


def cheapest(turns, known="n", spent=0):
    """Every way to edit turns (initial, fault), as (cost, audit) of the cheapest and least, by trying all edits."""
    best = {}

    def go(i, known, row):
        key = i, known, row
        if key not in best:
            ways = [(0, "")] if i == len(turns) and known in "na" else []
            if row < 2:  # more than two insertions in a row never pay
                ways += [(c + 2, "I" + a) for r in "ua" if (to := next_of(known, r)) for c, a in [go(i, to, row + 1)] if c < 10**9]
            if i < len(turns):
                initial, fault = turns[i]
                c, a = go(i + 1, known, 0)
                ways.append((c + 3, "D" + a))
                if fault not in ("blank", "duplicate"):
                    more = int(fault == "truncated")
                    ways += [(c + more, "K" + a) for to in [next_of(known, initial)] if to for c, a in [go(i + 1, to, 0)]]
                    ways += [(c + more + 2, "R" + a) for r in "ua" if (to := next_of(known, r)) for c, a in [go(i + 1, to, 0)]]
            best[key] = min(ways, default=(10**9, ""))
        return best[key]

    return go(0, known, 0)


def plain_repair(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = cheapest([(role[:1], f) for (_, role, _), f in zip(rows, faults)])
    out, left, put = [], iter(rows), "su" if len(re.sub("D", "", audit)) % 2 else "ua"
    for e in audit:
        role, text = next(left)[1:] if e != "I" else ("", "")
        if e == "D":
            continue
        want = "s" if len(re.sub("D", "", audit)) % 2 and not out else "ua"[(len(out) + (put == "su")) % 2]
        out.append((e, role if e == "K" else {"u": "user", "a": "assistant"}[want], text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in out).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest), out


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for t in range(rng.randrange(14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"])
            text = rng.choice(["Yes.", "No!", "cut", "cut off ", " \t", "", None, f"Turn {t}.", f"Turn {t}?\n", f"Turn {t},"])
            rows.append((conv, rng.choice([t, t, t, None, t + 5]), role, text, 1, 2, "x"))
    return rows


@pytest.mark.parametrize("chunk", [16, 1, 2])
def test_repairs_are_the_cheapest(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = random_rows(chunk)
    long = [(99, t, random.Random(t).choice(["user", "assistant"]), f"{t}" + random.Random(-t).choice([".", ""]), 1, 2, "x") for t in range(60)]
    df = spark.createDataFrame(rows + long, TURNS)
    ids = {r[0] for r in rows} | {99, 1000}
    want = {c: plain_repair([r[1:4] for r in rows + long if r[0] == c]) for c in ids}
    got = conversations.repair_summaries(df, spark.createDataFrame([(c,) for c in ids], "conv_id long")).collect()
    assert len(got) == len(ids)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: x[0] for c, x in want.items()}
    turns = {}
    for r in conversations.repaired_turns(df).orderBy("place").collect():
        turns.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert turns == {c: x[1] for c, x in want.items() if x[1]}


def test_a_conversation_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 3)
    rows = [(1, None, "user" if t % 3 else "assistant", f"{t}.", 0, 0, "") for t in range(300)] + [(1, 7, "user", "same", 0, 0, "")] * 300
    got = conversations.repair_summaries(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
    assert [tuple(r)[1:] for r in got] == [plain_repair([r[1:4] for r in rows])[0]]
    assert got[0]["duplicate"] == 299


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversations.repair_summaries(none, none).count() == 0 and conversations.repaired_turns(none).count() == 0
    only = conversations.repair_summaries(none, spark.createDataFrame([(None,), (3,), (3,)], "conv_id long")).collect()
    assert sorted((tuple(r) for r in only), key=str) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (None, 3)], key=str)


def test_damage_by_crc32(spark):
    import zlib

    rows = [(c, t, "assistant", "A. B! C?", 0, 0, "") for c in (None, 1, 2) for t in (None, *range(40))] + [(5, 5, None, None, 0, 0, "")]
    got = sorted((tuple(r) for r in conversations.damage(spark.createDataFrame(rows, TURNS)).collect()), key=repr)
    want = []
    for c, t, role, text, *_ in rows:
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if k == 0 else [(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    assert got == sorted(want, key=repr)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_MERGES)


def mess(n, seed):
    rng = random.Random(seed)
    letters = ["a", "the", " ", "\n", "\x1c", "é", "中", "'s", "9", "!", "\U0001f600", "　", "<|endoftext|>", "<|endoftext", "\x85", "\x00", "abcdefghij"[rng.randrange(10)], "Zq"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(rng.randrange(400))) for _ in range(n)]


@pytest.mark.parametrize("states", [1 << 17, 300])
def test_automaton_is_the_library(monkeypatch, library, states):
    monkeypatch.setattr(token_automaton, "STATES", states)
    own = token_automaton.TokenAutomaton(BYTE_MERGES, PATTERN)
    texts = mess(300, states) + ["a" * 5000, " " * 3000, "ab" * 3000, ""]
    for batch in (texts, texts[::-1]):
        ids, n = own.encode_texts(batch)
        ends = np.cumsum(n)
        for text, end, k, want in zip(batch, ends, n, library.encode_batch(batch, add_special_tokens=False)):
            assert ids[end - k : end].tolist() == want.ids
            assert own.decode(ids[end - k : end]) == library.decode(want.ids, skip_special_tokens=False) == text
    assert own.decode(np.array([250, 97])) == library.decode([250, 97], skip_special_tokens=False)
    with pytest.raises(ValueError):
        own.decode(np.array([60_000]))


def test_automaton_has_the_arcs_that_merges_leave(library):
    """A pair of tokens has an arc just if the library gives that pair for its text."""
    own, rng = token_automaton.TokenAutomaton(BYTE_MERGES, PATTERN), random.Random(2)
    letters = {i: library.id_to_token(i) for i in own.born}
    by_byte = token_automaton.byte_letters()
    plain = [i for i, t in letters.items() if re.fullmatch("[a-z]+", t)]
    for _ in range(3000):
        x, y = rng.choice(plain), rng.choice(plain)
        text = bytes(by_byte[c] for c in letters[x] + letters[y]).decode()
        assert own.has_arc(x, y) == (library.encode(text, add_special_tokens=False).ids == [x, y]), text


def test_automaton_digests_and_odd_rows(spark, library):
    odd = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (2, "", 3), (3, "x y", 4), (3, "x y", 4), (4, "ab" * 50_000 + " é" * 3000, 5), (5, "q <|endoftext|>\n", 6)], "doc_id long, text string, ids long")
    for df in (odd, table(spark, SF, "documents")):
        want = []
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [tuple(r) for r in token_automaton.automaton_digests(df, BYTE_MERGES, PATTERN).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    back = token_automaton.automaton_decode(token_automaton.automaton_encode(odd, BYTE_MERGES, PATTERN), BYTE_MERGES, PATTERN)
    assert sorted(r["decoded"] for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())
    assert token_automaton.automaton_digests(odd.limit(0), BYTE_MERGES, PATTERN).count() == 0


def terms_of(text):
    return re.findall(lexical.TERM, (text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def plain_ranks(docs, queries, k):
    docs = [(i, w) for i, t in docs if (w := terms_of(t))]
    n_all, l_all, df = len(docs), sum(len(w) for _, w in docs), {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked, out = {}, []
    for q, t in queries:
        asked.setdefault(q, set()).update(terms_of(t))
    for q, terms in asked.items():
        found = []
        for i, w in docs:
            m = 10 + 90 * len(w) * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c // (1000 * c + 8 * m)) for t in terms if (c := w.count(t)))
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(q, rank + 1, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("shard,block", [(1 << 16, 1 << 13), (7, 3)])
def test_search_against_every_score(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    rng = random.Random(shard)
    words = ["alpha", "Beta", "gamma", "É", "é", "x1", "中文", "the", "the", "a_b", "K", "rare"]
    docs = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(300)]
    docs += [(i, "beta the copies") for i in range(1000, 1200)] + [(1000, "beta the copies"), (7, None), (8, ""), (9, "-- !"), (2000, "the " * 30_000 + "rare")]
    queries = [(1, "alpha beta"), (2, "THE the. the!"), (3, None), (4, ""), (5, "nowhere"), (6, "copies"), (None, "gamma x1 é"), (7, "rare"), (7, "É"), (7, "É"), (8, " ".join(words))]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score long, rank long").repartition(5)
    items = spark.createDataFrame([(*r, 1, 2) for r in queries], "item_id long, text string, doc_id long, shard long")
    got = [tuple(r) for r in lexical.search(lexical.build_index(df), items, 10).collect()]
    assert sorted(got, key=repr) == sorted(plain_ranks(docs, queries, 10), key=repr)
    few = [tuple(r) for r in lexical.search(lexical.build_index(df), items, 1).collect()]
    assert sorted(few, key=repr) == sorted(plain_ranks(docs, queries, 1), key=repr)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs, items), (spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items), (spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)), (spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.selectExpr("item_id", "'b' as text"))):
        out = lexical.search(lexical.build_index(d), q)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_branches_are_cut():
    """A query opens few nodes where one document is far ahead, and those as high as the k-th."""
    n, opened = 4096, []
    head = {"lengths": np.full(n, 10, "<i8").tobytes(), "ids": np.arange(n, dtype="<i8").tobytes()}
    tf = np.ones(n, "<u1")
    tf[3000] = 9
    trees = lexical._Trees(head, [{"term": "t", "df": n, "docs": np.arange(n, dtype="<u2").tobytes(), "counts": tf.tobytes()}], n, 10 * n)
    at, own = trees.at, np.ndarray.__getitem__

    class Spy(np.ndarray):
        def __getitem__(self, i):
            opened.append(i)
            return own(self, i)

    trees.at = at.view(Spy)
    assert [d for _, d in sorted(trees.best(["t"], [5], 1, None), reverse=True)] == [3000] and len(opened) == 2
    opened.clear()
    assert sorted(d for _, d in trees.best(["t"], [5], 4, None)) == [0, 1, 2, 3000] and len(opened) <= 4
