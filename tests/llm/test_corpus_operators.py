"""Copies, near copies, fingerprints, packing, pieces, reply trees and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("loomframe.llm")

import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loomframe.llm import chat_trees, exact_dedup, minhash_dedup, packing, simhash  # noqa: E402
from loomframe.llm import sentencepiece_lattice as sp  # noqa: E402
from loomframe.llm.queries import CONTROL, op10_chat_trees  # noqa: E402


def prose(rng, n):
    return [rng.choice(["the", "of", "tion", "er", "and", "ing"]) + rng.choice("abcdefghijklmnop") + rng.choice("abcdefghij") for _ in range(n)]


def corpus(seed=1):
    """Documents with exact and near copies, chains of near copies, short, empty and null texts."""
    rng = random.Random(seed)
    docs = []
    for _ in range(60):
        words = prose(rng, rng.randint(3, 120))
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.random())[2:6]
            words = copy if rng.random() < 0.5 else words
            docs.append(" ".join(copy))
    hub = prose(rng, 150)
    for k in range(150):  # a large group of near copies
        copy = list(hub)
        copy[k % 150] = f"edit{k}"
        docs.append(" ".join(copy))
    docs += ["", None, "One", "one", "ONE", " \t", "a b", "A  b", "a\xa0b", docs[0], docs[0]]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_exact(spark):
    rows = [*corpus(), (3, "twice"), (3, "twice"), (None, "One")]
    docs = frame(spark, rows).withColumn("kept", F.lit(1)).withColumn("_len", F.lit(2))
    got = exact_dedup.mark_copies(docs).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids)
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup.mark_copies(docs.limit(0)).count() == 0


def shingle_set(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def near_by_force(rows, n):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n", [2, 5])
def test_near(spark, n):
    rows = corpus(n)
    got = minhash_dedup.near_duplicates(frame(spark, rows).withColumn("sig", F.lit(1)).withColumn("component_id", F.lit(1)), words=n)
    assert sorted(tuple(r)[:4] for r in got.collect()) == near_by_force(rows, n)


def test_near_among_texts_that_share_a_passage(spark):
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(240))
    tails = [[f"t{k}x{j}" for j in range(39)] for k in range(600)]  # any two texts are alike by about 0.75
    for a, b in zip(range(0, 60, 2), range(1, 60, 2), strict=True):
        same = rng.randint(11, 17)  # pairs by 0.81 to 0.85
        tails[b][:same] = tails[a][:same]
    rows = list(zip(rng.sample(range(10_000), 600), [f"{passage} {' '.join(t)}" for t in tails], strict=True))
    want = near_by_force(rows, 5)
    assert sum(not r[3] for r in want) == 30
    assert sorted(tuple(r)[:4] for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()) == want


def test_near_joins_across_blocks_of_a_common_shingle(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rows = corpus(3)
    sets = [shingle_set(t, 5) for _, t in rows]
    found = {}
    for (d, t), own in zip(rows, sets, strict=True):
        if own:
            x = minhash_dedup.shingles_of(5)(t)
            found.setdefault(minhash_dedup.digest(x)[0], (d, own))
    classes = spark.createDataFrame([(c, d, c) for c, (d, _) in found.items()], "c long, rep long, comp long")
    got = {(r.a, r.b) for r in minhash_dedup.joined(frame(spark, rows), classes, 5).collect()}
    names = sorted(found)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 100 * len(found[a][1] & found[b][1]) >= 80 * len(found[a][1] | found[b][1])}
    assert want and want <= got


def test_near_edges(spark):
    none = frame(spark, corpus()).limit(0)
    assert minhash_dedup.near_duplicates(none).count() == 0
    odd = frame(spark, [(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (5, "x " * 50_000)])
    got = [(str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(odd, words=2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("None", 2, 4, False), ("None", 0, None, True), ("4", 2, 4, True), ("4", 2, 4, True), ("5", 1, 5, True)]))
    kept = minhash_dedup.drop_near_duplicates(frame(spark, corpus(2)))
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(r[3] for r in near_by_force(corpus(2), 5))


def test_near_copies_of_clashing_ids(spark):
    t, u, w = "one two three four five six seven", "another text of its own words", "what nobody else has said"
    rows = [(2, t), (4, t), (4, u), (None, t), (None, w), (7, "a b c d e f"), (7, "a b c d e f"), (None, ""), (None, ""), (None, "x y z"), (None, "x y z"), (9, "A b C d E f g h i j k l m n o p q r s t"), (9, "a b c d e f g h i j k l m n o p q r s t")]
    kept = sorted(map(str, (tuple(r) for r in minhash_dedup.drop_near_duplicates(frame(spark, rows)).collect())))
    want = [(2, t), (4, u), (None, w), (7, "a b c d e f"), (None, ""), (None, ""), (None, "x y z")]
    nine = [r for r in kept if r.startswith("(9")]
    assert len(nine) == 1 and sorted(r for r in kept if r not in nine) == sorted(map(str, want))


def test_exact_copies_of_null_and_empty(spark):
    rows = [(3, None), (3, ""), (1, ""), (5, "a"), (5, "a"), (None, "b"), (None, "b")]
    kept = [tuple(r) for r in exact_dedup.drop_copies(frame(spark, rows)).collect()]
    assert sorted((i is None, i, t or "") for i, t in kept) == [(False, 3, ""), (False, 5, "a"), (True, None, "b")]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    got = {r.c: r.root for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert set(got) == set(near)


def xx(data, seed=42):
    import xxhash

    v = xxhash.xxh64_intdigest(data, seed=seed)
    return v - (1 << 64) if v >> 63 else v


def simhash_by_hand(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    h = [xx(w.encode()) for w in words]
    terms = []
    for i in range(max(1, len(h) - 4) if h else 0):
        s = 42
        for x in h[i : i + 5]:
            s = xx((x & (2**64 - 1)).to_bytes(8, "little"), s & (2**64 - 1))
        s &= 2**64 - 1
        more = xx((1).to_bytes(4, "little"), xx(s.to_bytes(8, "little")) & (2**64 - 1)) & (2**64 - 1)
        terms.append(s | more << 64)
    return sum(1 << b for b in range(128) if 2 * sum(t >> b & 1 for t in terms) > len(terms))


def test_simhash(spark):
    rows = [(i, t) for i, t in corpus(3) if i % 3 == 0] + [(10_000, "é" * 7 + " x y z"), (-5, None)]
    docs = frame(spark, rows).withColumn("_block", F.lit(1))
    got = {r.doc_id: r for r in simhash.compare_edited(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        a, b, c = (simhash_by_hand(x) for x in (t, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (a, b), t
        assert r.near_edited == 1 - (a ^ b).bit_count() / 128 and r.near_next == 1 - (a ^ c).bit_count() / 128
    assert simhash.compare_edited(docs.limit(0)).count() == 0
    one = simhash.compare_edited(docs.filter("doc_id = 10000")).first()
    assert one.near_next == 1.0
    same = simhash.fingerprints(docs)
    assert {r.doc_id: joined(r.fingerprint) for r in same.collect()} == {i: int(r.fingerprint, 16) for i, r in got.items()}


def test_simhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    docs = spark.range(0, 200, 3).selectExpr("id * id as doc_id", "concat('text ', id) as text").repartition(4)
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in simhash.compare_edited(docs).collect()}
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def joined(lanes):
    return sum((x & (2**64 - 1)) << 64 * n for n, x in enumerate(lanes))


def test_block_tables(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for p in prints[:30]:
        q = p
        for _ in range(rng.randint(1, 9)):
            q ^= 1 << rng.randrange(128)
        prints.append(q)
    signed = [[(x := p >> 64 * n & 2**64 - 1) - (x >> 63 << 64) for n in range(2)] for p in prints]
    got = {(frozenset((joined(r.a), joined(r.b))), r.distance) for r in simhash.near(spark.createDataFrame([(p,) for p in [*signed, None, signed[0]]], "fingerprint array<long>"), 6).collect()}
    want = {(frozenset((a, b)), (a ^ b).bit_count()) for i, a in enumerate(prints) for b in prints[:i] if a != b and (a ^ b).bit_count() <= 6}
    assert got == want and want


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*[(i, t) for i, t in corpus(4) if t is None or len(t) < 5000][:120], (9000, "long text with words " * 3000), (9001, "  spaces \n \n and   runs\t\t x "), (9002, "日本語 ünï 🙂"), (9001, "again")]
    docs = frame(spark, rows).withColumn("shard", F.lit(0)).withColumn("offset", F.lit(1))
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, shard=50).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert {(i, len(x)) for i, xs in want.items() for x in xs} == set(pieces)
    for (i, n), rs in pieces.items():
        ids = next(x for x in want[i] if len(x) == n)
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == n
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(len(x) for xs in want.values() for x in xs)
    assert len(sequences) <= total / 1024 + 6  # one that isn't full a shard
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_packing_by_force(spark, monkeypatch):
    """Every document of a window is the best unused one by BM25 over all ids of the whole texts; without one, the longest."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    words = [[f"{x}{y}" for y in ("ing", "er", "ful", "less", "ment", "ed")] for x in ("paint", "count", "harm", "point", "care", "state")]
    texts = [" ".join([*(rng.choice(words[i % 6]) for _ in range(rng.randint(1, 14))), *(str(rng.randint(10, 99)) for _ in range(rng.randint(0, 16)))]) for i in range(150)]
    texts += [" ".join(words[i] * 60) + " zebra" * 9 for i in range(6)] + [""]  # with full windows on what others are about
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    df = {x: sum(x in set(d) for d in ids) for d in ids for x in d}
    idf = {x: np.log(1 + (len(ids) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    mean, k1, b = sum(map(len, ids)) / len(ids), packing.K1, packing.B

    def score(seed, d):
        return sum(idf[x] * (tf := ids[d].count(x)) * (k1 + 1) / (tf + k1 * (1 - b + b * len(ids[d]) / mean)) for x in set(ids[seed]) if x in ids[d])

    for dense, window in ((4096, 256), (0, 256), (4096, 1024)):
        monkeypatch.setattr(packing, "DENSE", dense)
        got = packing.pack(frame(spark, list(enumerate(texts))), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, window=window).collect()
        left = [(len(d) + 1) % window for d in ids]
        assert any(r.length == window for r in got) == (window == 256)
        sequences = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            if r.length < window:
                sequences.setdefault(r.sequence_id, []).append(r)
        for i, rs in enumerate(sequences.values()):
            seed = rs[0].doc_id
            assert sum(r.length for r in rs) == (window if i < len(sequences) - 1 else sum(left))
            left[seed] -= rs[0].length
            for r in rs[1:]:
                best = max(score(seed, d) for d, n in enumerate(left) if n and d != seed)
                assert score(seed, r.doc_id) >= best * (1 - 1e-5) and (best or left[r.doc_id] == max(left))
                left[r.doc_id] -= r.length
        assert not any(left)


def test_ids_of_white_space(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    odd = [*" \n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u3000\u200b", "  ", "a", "don't", "'s", "12", "é", "日本", "--", "word"]
    texts = ["", *odd, *("".join(rng.choice(odd) for _ in range(rng.randint(1, 30))) for _ in range(2000))]
    for most in (packing.LONG, 5):
        monkeypatch.setattr(packing, "LONG", most)
        ids_of = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        for t in texts:
            assert np.frombuffer(ids_of(t), dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def tiny_vocabulary():
    pieces = {"▁": -3.0, "▁a": -2.0, "a": -3.5, "b": -3.0, "ab": -2.5, "▁ab": -4.9, "ba": -2.2, "bab": -4.0, "▁▁": -2.9, "é": -5.0}
    return sp.Pieces(tuple((300 + i, p, s) for i, (p, s) in enumerate(pieces.items())), tuple(range(3, 259)), 0)


def test_parts_in_one_pass():
    """Whole texts are parted by one pattern as their words are, one by one."""
    rng = random.Random(11)
    model = sp.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    odd = sp.Pieces(tuple((i, p, -1.0) for i, p in enumerate(["'s", "a.", "▁▁", "▁1", "--", "^]", "]b", "é"])), (), 0)
    for v in (model, odd, tiny_vocabulary(), sp.Pieces((), (), 0)):
        parts = sp.Parts(v)
        pairs = [*sorted(parts.pairs), "x", "ⅫǅŹ", "² ", " \n", "  "]
        texts = ["".join(rng.choice("abst▁.,é1日-'_²Ⅻ \n=^]  ") for _ in range(rng.randint(0, 15))) for _ in range(5000)]
        texts += ["".join(rng.choice(pairs) for _ in range(rng.randint(1, 6))) for _ in range(5000)]
        for t in texts:
            assert parts.of_text(t) == [p for w in parts.words(t) for p in parts.of(w)], t


def best_by_force(word, v):
    score = {p: (s, i) for i, p, s in v.pieces}
    best = [(0.0, [])]
    for j in range(1, len(word) + 1):
        found = []
        for i in range(j):
            p = word[i:j]
            if p in score:
                found.append((best[i][0] + score[p][0], -i, best[i][1] + [score[p][1]]))
            elif j - i == 1:
                found.append((best[i][0] + v.worst - sp.PENALTY, -i, best[i][1] + [v.bytes[0] + b for b in p.encode()]))
        s, _, ids = max(found, key=lambda x: x[:2])
        best.append((s, ids))
    return best[-1][1]


def test_pieces_by_force(spark):
    v = tiny_vocabulary()
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab bé\nz") for _ in range(rng.randint(1, 25))) for _ in range(60)] + ["", "   ", "ab" * 200]
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("ids", F.lit(1))
    for frequent in (0, 5, 1000):
        got = {r.doc_id: r for r in sp.encode(docs, v, frequent=frequent).collect()}
        for i, t in enumerate(texts):
            marked = "▁" + t.replace(" ", "▁") if t else ""
            parts = sp.Parts(v)
            words = parts.words(t)
            assert "".join(words) == marked and all("".join(parts.of(w)) == w for w in words)
            assert list(got[i].ids) == best_by_force(marked, v) and got[i].round_trip and got[i].n_pieces == len(got[i].ids)
            assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert list(got[900].ids) == []
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(docs, v), v, "doc_id").collect()}
    assert all(back[i] == " " + t for i, t in enumerate(texts) if t)
    assert sp.encode(docs.limit(0), v).count() == 0
    no_bytes = sp.Pieces(v.pieces, (), 0)
    assert list(sp.encode(docs.limit(0).union(spark.createDataFrame([(1, "zz", "x", 1)])), no_bytes).first().ids) == [300, 0, 0]


def merges_by_force(word, v):
    """Joins the neighbours whose join has the best score, the leftmost of equal ones, until none has one."""
    score = {p: (s, i) for i, p, s in v.pieces}
    left = list(word)
    while True:
        best = max(((score[a + b][0], -k) for k, (a, b) in enumerate(zip(left, left[1:])) if a + b in score), default=None)
        if best is None:
            return [i for x in left for i in ([score[x][1]] if x in score else [v.bytes[b] for b in x.encode()])]
        k = -best[1]
        left[k : k + 2] = [left[k] + left[k + 1]]


def test_merges_by_force(spark):
    rng = random.Random(7)
    for late in (False, True):
        pieces = {"▁": -30.0, "a": -31.0, "b": -32.0, "c": -33.0, "ab": -1.0, "bc": -2.0, "▁a": -3.0, "abab": -4.0, "▁ab": -5.0, "ca": -6.0, "cab": -7.0, "aa": -8.0}
        if late:  # "bcab" is spelled by "bca", of a worse score, and "b"
            pieces |= {"bca": -40.0, "bcab": -0.5, "aaa": -0.2}
        v = sp.Pieces(tuple((300 + i, p, s) for i, (p, s) in enumerate(pieces.items())), tuple(range(3, 259)), 0, merges=True)
        assert bool(v.late()) == late
        texts = ["".join(rng.choice("abcabcabc é,") for _ in range(rng.randint(1, 40))) for _ in range(80)] + ["abc" * 300]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r for r in sp.encode(docs, v, frequent=20).collect()}
        for i, t in enumerate(texts):
            assert list(got[i].ids) == merges_by_force("▁" + t.replace(" ", "▁"), v), t
            assert got[i].round_trip


def test_pieces_of_the_model_round_trip(spark):
    v = sp.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, "a  b   c "), (-2, " x\n\ny\t1234 z"), (-3, "日本語 🙂 naïve"), (-4, "e" * 60 + " = == === ----"), (-5, ""), (-5, ""), (None, None), (-6, "x" * 100_000), (-7, "ab-" * 30_000)]
    every = docs.union(docs.limit(20)).union(spark.createDataFrame(odd, "doc_id long, text string"))
    given = sorted(((r.doc_id, r.text or "") for r in every.collect()), key=str)
    rows = sorted(((r.doc_id, list(r.ids), r.round_trip) for r in sp.encode(every, v, frequent=500).collect()), key=str)
    assert rows == sorted(((i, library.encode(t), True) for i, t in given), key=str)
    assert v.merges and not sp.encode(spark.createDataFrame([(1, "a ▁b")], "doc_id long, text string"), v).first().round_trip


def test_texts_are_parted_by_distinct_words(spark, monkeypatch):
    """Counting parted each text as a whole where spaces follow spaces, which took CPU time for every occurrence of a word."""
    v = sp.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    of, steps, parted = sp.Parts._pattern, [], []

    class Pattern:
        def __init__(self, parts):
            self.own = of(parts)

        def findall(self, text):
            parted.append(len(text))
            return self.own.findall(text)

    docs = spark.createDataFrame([("x",)], "text string")
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, f, *_: steps.append(f) or self.selectExpr("_text as word", "1L as n"))
        m.setattr(sp.Parts, "_pattern", lambda self: Pattern(self))
        sp.distinct_parts(docs, v)
        texts = ["one  two three-four " * 50, "one two three-four" + " one" * 50] * 40
        found = list(steps[0](iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 8])], ["_text"]) for i in range(0, 80, 8)])))
    assert sum(parted) < sum(map(len, texts)) / 10
    parts = sp.Parts(v)
    assert Counter({w: n for b in found for w, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}) == Counter(p for t in texts for p in parts.of_text(t))


def test_most_frequent_parts_by_their_counts(spark):
    known = spark.createDataFrame([(f"w{i}", 9 if i < 30 else 4 if i < 2030 else 1) for i in range(5000)], "word string, n long")
    for frequent, least in ((0, 9), (10, 9), (30, 4), (1030, 4), (2030, 1), (5000, 0), (9000, 0)):
        n, some = sp._least(known, frequent)
        assert n == least
        tied = sum(r.n == n for r in known.collect())
        assert abs(sum(r.n > n for r in known.collect()) + tied * some / sp.SHARES - min(frequent, 5000)) < 1


def test_gathered_words(spark):
    v = sp.Pieces(tuple((i, p, -1.0) for i, p in enumerate(["▁", "▁▁", "ab", "▁ab", "a\n"])), (), 99, merges=True)
    parts = sp.Parts(v)
    texts = ["ab ba ab", "", " ab", "ab  ab   ", "▁", " ", "   ", "a▁b a\nab", "é ab", "ab"]
    given = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 2)), pa.array(texts[i : i + 2])], ["i", "t"]) for i in range(0, len(texts), 2)]
    got = {}
    for b, plain, sizes, words in parts.gathered(iter(given), 1):
        flat, n = parts.of_words(words, plain)
        ends, of_text = np.cumsum(n).tolist(), np.cumsum(sizes).tolist()
        for i, a, z in zip(b.column(0).to_pylist(), [0, *of_text], of_text, strict=False):
            got[i] = flat[[0, *ends][a] : [0, *ends][z]]
    assert got == {i: parts.of_text(t) for i, t in enumerate(texts)}
    assert not list(parts.gathered(iter([]), 0))


def test_reply_trees(spark):
    rows = [  # tree, node, parent, score, role, text
        (1, 1, None, 0.1, "user", "q"), (1, 2, 1, 0.9, "assistant", "good [/INST] </s>"), (1, 3, 1, 0.2, "assistant", "bad"), (1, 4, 3, 0.3, "user", None),
        (2, 7, 99, None, None, "\\e<]"), (None, 1, None, 0.0, "user", "x" * 200_000), (None, 2, 1, 0.0, "assistant", "of no tree"), (3, 1, 2, 1.0, "user", "loop"), (3, 2, 1, 1.0, "user", "loop"),
    ]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    best = {(r.tree, r.path, r.pos): r.node for r in chat_trees.best_paths(nodes, 2).collect()}
    assert best == {(1, 1, 1): 1, (1, 1, 2): 2, (1, 2, 1): 1, (1, 2, 2): 3, (1, 2, 3): 4, (2, 1, 1): 7, (None, 1, 1): 1, (None, 1, 2): 2}
    read = {tuple(r.conv): r for r in chat_trees.read_back(chat_trees.format_trees(nodes, 2)).collect()}
    assert [tuple(x) for x in read[1, 1].turns] == [("user", "q"), ("assistant", "good [/INST] </s>")]
    assert read[1, 1].learnt == ["good [/INST] </s>"]
    assert [tuple(x) for x in read[2, 1].turns] == [("", "\\e<]")] and read[2, 1].learnt == []
    assert read[None, 1].learnt == ["of no tree"] and len(read[None, 1].turns[0].text) == 200_000
    assert chat_trees.format_trees(nodes.limit(0)).count() == 0


def test_deep_tree(spark):
    nodes = spark.range(1, 301).selectExpr("1L as tree", "id as node", "if(id > 1, id - 1, null) as parent", "0D as score", "'user' as role", "string(id) as text")
    got = chat_trees.best_paths(nodes).orderBy("pos").collect()
    assert [r.node for r in got] == list(range(1, 301)) and [r.pos for r in got] == list(range(1, 301))


def test_conversation_query(spark):
    rows = {r.conv_id: r for r in op10_chat_trees(spark, "/root/testdata/sf0.001").collect()}
    own = rows[-1]
    told = f"user\n{CONTROL}\nassistant\n{CONTROL}\n"
    assert (own.n_turns, own.turns_sha256) == (2, hashlib.sha256(told.encode()).hexdigest())
    assert (own.loss_chars, own.loss_sha256) == (len(CONTROL), hashlib.sha256(CONTROL.encode()).hexdigest())


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.limit(1).selectExpr("90000L as doc_id", "'12 34' as text", "lang", "source", "5L as n_chars")
    more = more.unionByName(docs.limit(1).selectExpr("90001L as doc_id", "'ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ' as text", "cast(null as string) as lang", "source", "10L as n_chars"))
    docs = docs.unionByName(more).withColumn("kept", F.lit(True)).withColumn("_language", F.lit("x"))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, "/root/testdata/sf0.001")
        if name != "packed":
            assert out.columns == docs.columns
        rows = out.collect()
        if name == "language":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows} == {90000, 90001}
        elif name == "exact":
            texts = [r.text for r in before.collect()]
            assert sorted(r.text for r in rows) == sorted(set(texts))
        elif name == "near":
            want = near_by_force([(r.doc_id, r.text) for r in before.collect()], 5)
            assert {r.doc_id for r in rows} == {d for d, _, _, kept in want if kept}
        elif name == "private":
            assert all(len(r.text) == r.n_chars for r in rows)
        else:
            pieces = {}
            for r in rows:
                pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
            assert {d for d, _ in pieces} == {r.doc_id for r in before.collect()}
            for (_, n), found in pieces.items():
                ends = [0, *(start + length for start, length in sorted(found))]
                assert [start for start, _ in sorted(found)] == ends[:-1] and ends[-1] == n
        before = spark.createDataFrame(rows, out.schema) if name != "packed" else out


def test_pipeline_of_nothing(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
