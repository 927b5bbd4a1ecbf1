"""Near duplicates by a chosen-path set similarity join on minwise tokens; links are confirmed on full sets.

A text is the set of its distinct word shingles. Texts of equal sets form a class, and classes are what is joined.
Each tree sends a class down paths: at a node some positions of the signature are chosen by the node's own hash, and
the minwise tokens there name the children. Small nodes are compared exhaustively by signature, larger ones branch
on, at every level into as many children as keep a pair at the threshold together in one of them on average.
Independent trees are repeated until such a pair meets with the recall aimed at. What meets is confirmed with the full
sets, each of which travels once for every small block of pairs.

Nodes that stay large to the last level hold texts that agree all along their path. There each text is first compared
with the node's first one and with its predecessors, which joins most of a group of near copies. All texts of such
nodes are then joined exactly, by a prefix filter on their full sets, but for pairs that are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import durable, once, per_text, small, without_rows

#: Words of a shingle where no contract says otherwise; percent of the union that the intersection must reach.
WORDS, PERCENT = 5, 80
#: Trees, positions of a signature, levels, documents of a node that are compared exhaustively, pairs of a hub in a block.
TREES, POSITIONS, LEVELS, LEAF, CHUNK = 10, 32, 6, 64, 256
#: Counters of shingles that order prefixes, rows of a shingle that are compared at once.
COUNTERS, BLOCK = 1 << 20, 1024
#: Share of the signature that must agree for a pair to be confirmed: four deviations below the threshold.
AGREE = 16

_U = np.uint64
_K1, _K2, _K3, _K4 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_FACTORS = np.random.default_rng(20240607).integers(1, 2**63, POSITIONS, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _K3
        x = (x ^ (x >> _U(33))) * _K4
        return x ^ (x >> _U(33))


def shingles_of(n: int, remembered: int = 200_000):
    """text -> sorted distinct 64-bit hashes of its n-word shingles; words are parted by ASCII white space, A-Z lower-cased.

    Fewer words than n make one shingle of them all; no words make the empty set.
    """
    from xxhash import xxh3_64_intdigest

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            h = xxh3_64_intdigest(word)
            if len(self) < remembered:
                self[word] = h
            return h

    known = Hashes()

    def shingles(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        k = min(n, len(words))
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if not k:
            return h
        x = np.full(len(h) - k + 1, k, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                x = mix(x * _K1 + h[i : len(h) - k + 1 + i] * _K2)
        return np.unique(x)

    return shingles


def signature(x: np.ndarray) -> bytes:
    low = np.full(POSITIONS, np.iinfo(np.uint32).max, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 4096):
            low = np.minimum(low, ((x[i : i + 4096, None] * _FACTORS) >> _U(32)).min(axis=0).astype(np.uint32))
    return (mix(low.astype(np.uint64)) >> _U(48)).astype("<u2").tobytes()


def _long(x) -> int:
    return int(np.int64(np.uint64(x).view(np.int64)))


def digest(x: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, equal for equal sets."""
    with np.errstate(over="ignore"):
        return _long(x.sum(dtype=np.uint64)), _long(mix(x ^ _K1).sum(dtype=np.uint64))


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """doc_id, n, two digests and a signature of each text's set; text_hash, if asked for, is the xxhash64 of the text."""

    def make():
        from xxhash import xxh64_intdigest

        shingles = shingles_of(words)

        def one(text: str) -> tuple:
            x = shingles(text)
            own = (len(x), *digest(x), signature(x) if len(x) else b"")
            return (*own, _long(xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42))) if with_hash else own

        return one

    names = {"n": "long", "c": "long", "c2": "long", "sig": "binary"} | ({"text_hash": "long"} if with_hash else {})
    return per_text(docs, make, names, id_col, text_col)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<u2").reshape(-1, POSITIONS)


def _child(node: np.ndarray, sig: np.ndarray, salt: int) -> np.ndarray:
    """The node below along one position, which the node's own hash chooses."""
    with np.errstate(over="ignore"):
        pick = mix(node + _U(salt) * _K1)
        pos = (pick >> _U(7)) % _U(POSITIONS)
        token = sig[np.arange(len(sig)), pos.astype(np.int64)].astype(np.uint64)
        return mix(pick ^ mix(token * _K2 + pos))


def _forks(node: np.ndarray) -> np.ndarray:
    """Every fourth node has two children: 1.25 on average, of which a pair at the threshold shares one."""
    return (mix(node ^ _K2) & _U(3)) == 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _roots(parts: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Two levels down at once, along one position or, at every fourth node, two."""
    for b in parts:
        if not b.num_rows:
            continue
        sig = _matrix(b.column(2))
        for tree in range(trees):
            with np.errstate(over="ignore"):
                root = mix(np.full(len(sig), tree + 1, dtype=np.uint64) * _K4)
            first = [(_child(root, sig, 1), None)] + ([(_child(root, sig, 2), None)] if tree % 4 == 0 else [])
            for node, _ in first:
                yield pa.RecordBatch.from_arrays([_signed(_child(node, sig, 1)), *b.columns], NODE)
                more = np.flatnonzero(_forks(node))
                if len(more):
                    part = b.take(pa.array(more))
                    yield pa.RecordBatch.from_arrays([_signed(_child(node[more], sig[more], 2)), *part.columns], NODE)


NODE = ["node", "c", "n", "sig"]
FOUND = ["node", "a", "b", "n", "sig"]
FOUND_SCHEMA = "node long, a long, b long, n long, sig binary"


def _alike(n: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (100 * lo >= PERCENT * hi) & ((sig[i] == sig[j]).sum(axis=1) >= AGREE)


def _pairs(node, a, b) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    none = pa.nulls(len(lo), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), none, pa.nulls(len(lo), pa.binary())], FOUND)


def _split(parts: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node: pairs of small nodes; of others rows one level down (b null), or at the last level their rows and hub pairs."""
    held: pa.Table | None = None
    big, hub, tail, seen = None, None, None, 0

    def deeper(node, c, n, raw, sig):
        nonlocal hub, tail, seen
        if not last:
            here = node.view(np.uint64)
            for salt, of in ((1, np.arange(len(c))), (2, np.flatnonzero(_forks(here)))):
                if len(of):
                    below = _child(here[of], sig[of], salt)
                    yield pa.RecordBatch.from_arrays([_signed(below), pa.array(c[of], pa.int64()), pa.nulls(len(of), pa.int64()), pa.array(n[of], pa.int64()), raw.take(pa.array(of))], FOUND)
            return
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(c, pa.int64()), pa.nulls(len(c), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(c), pa.binary())], FOUND)
        if hub is None:
            hub, tail, seen = (c[:1], n[:1], sig[:1]), (c[:0], n[:0], sig[:0]), 0
        rows = [np.concatenate([h, t, x]) for h, t, x in zip(hub, tail, (c, n, sig), strict=True)]
        k, at = 1 + len(tail[0]), np.arange(len(c))
        with np.errstate(over="ignore"):
            block = mix(node.view(np.uint64) + (_U(1) + ((seen + at) // CHUNK).astype(np.uint64)) * _K2).view(np.int64)
        for other in (np.zeros(len(c), dtype=np.int64), *(np.maximum(at + k - d, 0) for d in (1, 2, 3))):
            i = at + k
            ok = (rows[0][i] != rows[0][other]) & _alike(rows[1], rows[2], i, other)
            if ok.any():
                yield _pairs(block[ok], rows[0][i][ok], rows[0][other][ok])
        tail = tuple(r[-3:] for r in rows)
        seen += len(c)

    def runs(t: pa.Table, final: bool):
        nonlocal held, big, hub
        node, c, n = (t.column(i).combine_chunks().to_numpy() for i in range(3))
        raw = t.column(3).combine_chunks()
        cuts = np.flatnonzero(np.diff(node)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(node)]
        held = None
        many = np.flatnonzero(ends - starts > 1)
        if len(starts) and (not len(many) or many[-1] != len(starts) - 1):
            many = np.r_[many, len(starts) - 1]
        if len(starts) and (not len(many) or many[0] != 0):
            many = np.r_[0, many]
        for k in dict.fromkeys(many.tolist()):
            a, b = int(starts[k]), int(ends[k])
            open_end = k == len(starts) - 1 and not final
            if big is not None and node[a] != big:
                big, hub = None, None
            if big is None and open_end and b - a <= LEAF:
                held = t.slice(a, b - a)
                continue
            if big is None and b - a == 1:
                continue
            sig = _matrix(raw.slice(a, b - a))
            if big is None and b - a <= LEAF:
                i, j = np.triu_indices(b - a, 1)
                ok = (c[a:b][i] != c[a:b][j]) & _alike(n[a:b], sig, i, j)
                if ok.any():
                    yield _pairs(np.full(int(ok.sum()), node[a]), c[a:b][i[ok]], c[a:b][j[ok]])
                continue
            big = node[a]
            yield from deeper(node[a:b], c[a:b], n[a:b], raw.slice(a, b - a), sig)

    for batch in parts:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            yield from runs(pa.concat_tables([held, t]) if held is not None else t, False)
    if held is not None:
        yield from runs(held, True)


def candidates(classes: DataFrame, trees: int = TREES, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes(c, n, sig) that meet in a tree and look alike: a < b, and the block in which they met; and the
    classes (c) of nodes that stay large, of which not all pairs have met."""
    schema = "node long, c long, n long, sig binary"
    rows = classes.select("c", "n", "sig").mapInArrow(lambda parts: _roots(parts, trees), schema)
    found = None
    for level in range(2, levels + 1):
        last = level == levels
        dealt = rows.repartition("node").sortWithinPartitions("node", "c")
        out = durable(dealt.mapInArrow(lambda parts, last=last: _split(parts, last), FOUND_SCHEMA))
        pairs = out.filter("b is not null").select("a", "b", "node")
        found = pairs if found is None else found.unionByName(pairs)
        rows = out.filter("b is null").select("node", F.col("a").alias("c"), "n", "sig")
        if last or rows.isEmpty():
            break
    return found.groupBy("a", "b").agg(F.min("node").alias("block")), rows.select("c").distinct()


def _confirmed(parts: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, c, partners, hashes) sorted by block: the pairs of each block that reach the threshold."""

    def of(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = {c: np.frombuffer(x, dtype="<u8") for _, c, _, x in rows}
        out = []
        for c, partners in {c: p for _, c, p, _ in rows}.items():
            for d in partners:
                if d in sets:
                    common = len(np.intersect1d(sets[c], sets[d], assume_unique=True))
                    if 100 * common >= percent * (len(sets[c]) + len(sets[d]) - common):
                        out.append((c, d))
        return out

    held: list[tuple] = []
    links: list[tuple[int, int]] = []

    def batch():
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for b in parts:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                links += of(held)
                held = []
            held.append(row)
        if links:
            yield batch()
            links = []
    links += of(held)
    yield batch()


def _texts(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id and _text of the documents among reps(rep)."""
    reps = durable(reps.select("rep").distinct())
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return texts.join(small(reps), texts["_id"] == reps["rep"], "left_semi")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs(a, b, block) of classes(c, rep, n, sig) whose sets reach the threshold."""
    sides = pairs.select("block", F.col("a").alias("c"), F.col("b").alias("d")).unionByName(pairs.select("block", F.col("b").alias("c"), F.lit(None).cast("long").alias("d")))
    needed = durable(sides.groupBy("block", "c").agg(F.collect_list("d").alias("partners")))
    texts = _texts(docs, needed.select("c").distinct().join(classes.select("c", "rep"), "c"), id_col, text_col)

    def make():
        shingles = shingles_of(words)

        def one(text: str) -> tuple:
            x = shingles(text)
            return digest(x)[0], x.astype("<u8").tobytes()

        return one

    sets = per_text(texts, make, {"c": "long", "hashes": "binary"}, "_id", "_text").select("c", "hashes")
    rows = needed.join(sets, "c").select("block", "c", "partners", "hashes").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(lambda parts: _confirmed(parts, percent), "a long, b long").distinct()


def _counters(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the texts' sets fall on each counter."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingles_of(words)
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in parts:
            for text in b.column(0).to_pylist():
                np.add.at(total, (shingles(text or "") & _U(COUNTERS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    found = texts.select(F.col("_text").cast("string")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


MET = ["a", "b", "block"]


def _met(parts: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, across, slot, c, n, pos, comp) sorted by key: pairs of a key that are of two components and, by their
    sizes and the place of the shingle in their prefixes, can reach the threshold; across slots only if so marked."""

    def pairs(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, across, slot, c, n, pos, comp = x
        common = np.minimum(n[i] - pos[i], n[j] - pos[j])
        ok = (comp[i] != comp[j]) & (~across[i] | (slot[i] != slot[j])) & ((100 + percent) * common >= percent * (n[i] + n[j]))
        i, j = i[ok], j[ok]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in (np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), key[i])], MET)

    def runs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        x = [col.combine_chunks().to_numpy(zero_copy_only=False) for col in t.columns]
        starts = np.r_[0, np.flatnonzero(np.diff(x[0])) + 1]
        sizes = np.diff(np.r_[starts, len(x[0])])
        two = starts[sizes == 2]
        yield from pairs(x, two, two + 1)
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if (x[6][a : a + n] != x[6][a]).any():
                for k in range(a, a + n - 1, BLOCK):
                    i, j = np.triu_indices(min(BLOCK, a + n - k), 1, a + n - k)
                    yield from pairs(x, i + k, j + k)

    held: pa.Table | None = None
    for b in parts:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = t.column(0).combine_chunks().to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from runs(t.slice(0, cut))
            held = t.slice(cut)
    if held is not None:
        yield from runs(held)


def joined(docs: DataFrame, classes: DataFrame, words: int, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs (a, b, block) of classes(c, rep, comp) that are of two components and can reach the threshold.

    Sets are ordered by how common their shingles are, rarest first; a pair at the threshold shares a shingle of both
    prefixes. What many texts share comes last and is compared only where sets differ in less than their prefix.
    """
    texts = durable(_texts(docs, classes, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(_counters(texts, words))

    def make():
        shingles, counts = shingles_of(words), shared.value

        def one(text: str) -> tuple:
            x = shingles(text)
            often = counts[(x & _U(COUNTERS - 1)).astype(np.int64)]
            first = np.lexsort((x, often))[: len(x) + percent * len(x) // -100 + 1]
            return digest(x)[0], len(x), int((often[first] <= BLOCK).sum()), x[first].view(np.int64)

        return one

    sets = per_text(texts, make, {"c": "long", "n": "long", "light": "long", "tokens": "array<long>"}, "_id", "_text").dropDuplicates(["c"])
    sets = durable(sets.join(small(classes.select("c", "comp")), "c").select("c", "n", "comp", "light", "tokens"))
    rows = sets.select("c", "n", "comp", "light", F.posexplode("tokens").alias("pos", "token"))
    light = rows.filter("pos < light").select(F.col("token").alias("key"), F.lit(False).alias("across"), F.lit(0).cast("long").alias("slot"), "c", "n", F.col("pos").cast("long"), "comp")
    heavy = rows.filter("pos >= light")
    slots = F.ceil(F.count(F.lit(1)) / BLOCK).cast("long")
    spread = durable(heavy.groupBy("token").agg(slots.alias("slots"), F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b").select("token", "slots"))
    dealt = heavy.join(small(spread), "token").withColumn("slot", F.pmod(F.xxhash64("c"), F.col("slots")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    key = F.xxhash64("token", F.least("slot", "other"), F.greatest("slot", "other"))
    dealt = dealt.select(key.alias("key"), (F.col("slot") != F.col("other")).alias("across"), "slot", "c", "n", F.col("pos").cast("long"), "comp")
    met = light.unionByName(dealt).repartition("key").sortWithinPartitions("key").mapInArrow(lambda parts: _met(parts, percent), "a long, b long, block long")
    return met.groupBy("a", "b").agg(F.min("block").alias("block"))


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b) of classes(c, rep, n, sig) whose sets reach the threshold; of large nodes, enough for components."""
    pairs, crowded = candidates(classes)
    first = durable(confirmed(docs, classes, durable(pairs), words, percent, id_col, text_col))
    crowded = durable(crowded)
    if crowded.isEmpty():
        return first
    roots = components(first)
    among = crowded.join(classes.select("c", "rep"), "c").join(roots, "c", "left").select("c", "rep", F.coalesce("root", "c").alias("comp"))
    more = durable(joined(docs, durable(among), words, percent, id_col, text_col))
    return first.unionByName(confirmed(docs, classes, more, words, percent, id_col, text_col))


def components(edges: DataFrame) -> DataFrame:
    """c and root (the smallest member) for every end of edges(a, b), by alternating large and small stars."""
    edges = durable(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now, before = state(edges), None
    while now != before and now[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = durable(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small_star = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = durable(small_star)
        now, before = state(edges), now
    return edges.select(F.col("u").alias("c"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, class_id (and, if asked
    for, group_id, the component whether or not it has ids, and text_hash).

    Linked are documents whose sets of shingles have 100 * intersection >= percent * union; equal sets always are.
    A document without words (null and empty texts) is linked with nothing. Rows that repeat an id are documents of
    their own with that id; rows without an id are classed, and alone if none of their class has one. Pairs at the
    threshold meet with a probability over 0.99, closer ones more surely, and no link is reported that the full sets
    don't confirm. Other columns of docs are ignored.
    """
    base = durable(signatures(docs, words, id_col, text_col, with_hash))
    classes = durable(base.filter("n > 0").groupBy("c", "c2", "n", "sig").agg(F.min("doc_id").alias("rep")))
    named = classes.filter("rep is not null")
    roots = durable(components(links(docs, named, words, percent, id_col, text_col)))
    low = named.select("c", "rep").join(roots, "c").groupBy("root").agg(F.min("rep").alias("low"))
    linked = durable(roots.join(low, "root").select("c", "low", "root"))
    alone = base.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    ids = durable(classes.join(small(linked), "c", "left").select("c", F.coalesce("low", "rep").alias("component_id"), F.coalesce("root", "c").alias("group_id")))
    hashes = ["text_hash"] if with_hash else []
    rest = base.filter("n > 0").select("doc_id", "n", "c", *hashes).join(small(ids), "c").select("doc_id", "n", "component_id", F.col("c").alias("class_id"), "group_id", *hashes)
    out = rest.unionByName(alone.withColumn("group_id", F.lit(None).cast("long")), allowMissingColumns=True)
    more = ["group_id", *hashes] if with_hash else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id", *more)


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; every column as it was.

    A row goes by its id and its text, so of rows that share an id only those go that are near another text. Rows of one
    component whose ids are the smallest alike keep the one with the smallest hash of its text, and of rows that repeat
    both id and text one stays. Of a component without ids one row stays. Texts without words all stay.
    """
    marked = durable(near_duplicates(docs, words, percent, id_col, text_col, with_hash=True))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = marked.filter("group_id is not null").groupBy("group_id").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = marked.filter("group_id is not null").join(durable(stays), "group_id")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    rows = durable(rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), same.alias("_stays")))
    kept = without_rows(docs, rows.filter("not _stays").select("_id", "_hash").distinct(), id_col, text_col)
    again = durable(rows.filter("_stays").groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_id", "_hash"))
    return kept if again.isEmpty() else once(kept, again, id_col, text_col)
