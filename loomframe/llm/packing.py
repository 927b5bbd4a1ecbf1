"""Lexical retrieval packing: a sharded BM25 index names unused neighbours of each seed, which fill its window."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import durable, per_text

#: Tokens of a sequence; documents of a shard (expected), which bounds what one task holds of them.
WINDOW, SHARD = 1024, 2000
#: BM25, and the neighbours that are sorted at a time.
K1, B, SORTED = 1.2, 0.75, 16
#: Documents of a shard up to which ids that occur in over one of COMMON of them are scored by matrix products, so many seeds at a time.
DENSE, COMMON, SEEDS = 4096, 20, 256
#: Id that ends each document.
END = 0
#: Characters that are encoded at once, if there is a space to cut at.
LONG = 1 << 20

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
#: GPT-2's pattern, and the same without the look-ahead, which matters in runs of white space only and takes most of the time.
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = _GPT2.replace(r"|\s+(?!\S)", "")
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # \s of the tokenizer; Python's has \x1c to \x1f too
_TWO = re.compile(r"\s\s")
_RUN = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}]{{2}})|(?<=[{_WHITE}])(?=[{_WHITE}][^{_WHITE}])")
_WORD = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}][^{_WHITE}])")


def byte_bpe(path: str, pattern: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian unsigned 32-bit integers, for a byte-level BPE given as tiktoken ranks.

    Under GPT-2's pattern a run of white space is a pre-token without its last character, which goes with what follows,
    and no pre-token holds white space after another character. So texts are cut before runs and before their last
    character, and the pieces are encoded by the plain pattern. Other patterns take each text whole.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = pattern == _GPT2
    encode = tiktoken.Encoding("own", pat_str=_PLAIN if known else pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    as_bytes = lambda text: np.array(encode(text), dtype="<u4").tobytes()

    def chunks(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG and (cut := _WORD.search(text, at + LONG)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def ids_of(text: str) -> bytes:
        if not known or len(text) <= LONG and not _TWO.search(text):
            return as_bytes(text)
        return b"".join(as_bytes(x) for chunk in chunks(text) for x in _RUN.split(chunk))

    return ids_of


def tokenised(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, doc_tokens (with the closing id), crcs of its full windows, the ids left over, and the bag of
    the whole text: its distinct ids, each less the one before, then their counts."""

    def make():
        ids_of, end, step = byte_bpe(path, pattern), np.array([END], dtype="<u4").tobytes(), 4 * window

        def one(text: str) -> tuple:
            raw = ids_of(text)
            terms, counts = np.unique(np.frombuffer(raw, dtype="<u4"), return_counts=True)
            bag = np.concatenate([np.diff(terms, prepend=terms.dtype.type(0)), counts.astype("<u4")]).tobytes()
            ids = raw + end
            full = len(ids) // step
            return len(ids) // 4, [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(full)], ids[full * step :], bag

        return one

    return per_text(docs, make, {"doc_tokens": "long", "crcs": "array<long>", "tail": "binary", "bag": "binary"}, id_col, text_col)


def bag_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a bag, ascending, and their counts."""
    terms, counts = np.frombuffer(raw, dtype="<u4").reshape(2, -1)
    return np.cumsum(terms, dtype=np.int64), counts


def document_frequencies(tokens: DataFrame) -> dict[int, int]:
    """In how many documents each id occurs: a table no longer than the vocabulary, counted over all whole texts."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in parts:
            more = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(bag_of(x)[0] for x in b.column(0).to_pylist())]), minlength=len(total))
            more[: len(total)] += total
            total = more
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["term", "n"])

    found = tokens.select("bag").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}


class Shard:
    """What is still unused of each tail of one shard, and the BM25 postings of the whole texts."""

    def __init__(self, tails: list[bytes], bags: list[bytes], idf: np.ndarray, mean: float):
        self.left = np.array([len(t) // 4 for t in tails], dtype=np.int64)
        self.at = np.zeros(len(tails), dtype=np.int64)
        each = [bag_of(b) for b in bags]
        self.own = [terms for terms, _ in each]
        terms, tf = np.concatenate(self.own), np.concatenate([c for _, c in each]).astype(float)
        size = np.array([c.sum() for _, c in each], dtype=float)
        docs = np.repeat(np.arange(len(each)), [len(t) for t in self.own])
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[docs] / max(mean, 1.0)))
        n, many = len(tails), np.bincount(terms, minlength=len(idf))
        column = np.full(len(idf), -1)  # of the ids that many documents hold
        often = np.flatnonzero(many * COMMON > n) if n <= DENSE else np.zeros(0, dtype=np.int64)
        column[often] = np.arange(len(often))
        dense = column[terms] >= 0
        self.common = np.zeros((len(often), n), dtype=np.float32)
        self.common[column[terms[dense]], docs[dense]] = weight[dense]
        self.scored: dict[int, np.ndarray] = {}
        self.own = [own[column[own] < 0] for own in self.own]
        terms, docs, weight = terms[~dense], docs[~dense], weight[~dense]
        order = np.argsort(terms.astype(np.uint16) if len(idf) <= 1 << 16 else terms, kind="stable")
        self.docs, self.weight = docs[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(idf)))])
        self.unused = self.indexed = int(np.count_nonzero(self.left))
        self.order = np.lexsort((np.arange(n), -self.left))
        self.place = np.argsort(self.order)

    def _by_common(self, seed: int) -> np.ndarray:
        """Scores of all documents for the ids that many hold; those of the seeds that are next in size come along."""
        if seed not in self.scored:
            first = self.place[seed] // SEEDS * SEEDS
            seeds = self.order[first : first + SEEDS]
            seeds = seeds[(self.left[seeds] > 0) | (seeds == seed)]
            self.scored.update(zip(seeds.tolist(), (self.common[:, seeds] > 0).astype(np.float32).T @ self.common, strict=True))
        return self.scored.pop(seed)

    def neighbours(self, seed: int) -> Iterator[int]:
        """All unused documents that share an id with the seed, by BM25 score over all its ids, best first."""
        if 2 * self.unused < self.indexed:  # postings of used documents go
            keep = self.left[self.docs] > 0
            self.starts = np.concatenate([[0], np.cumsum(keep)])[self.starts]
            self.docs, self.weight, self.indexed = self.docs[keep], self.weight[keep], self.unused
        own, score = self.own[seed], np.zeros(len(self.left))
        if len(own):
            spans = [slice(a, z) for a, z in zip(self.starts[own].tolist(), self.starts[own + 1].tolist(), strict=True)]
            score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.left))
        if len(self.common):
            score = score + self._by_common(seed)
        score[self.left == 0] = 0.0
        score[seed] = 0.0
        rest = np.flatnonzero(score > 0)
        while len(rest):
            worse = -score[rest]
            now = worse <= np.partition(worse, SORTED - 1)[SORTED - 1] if len(rest) > SORTED else np.ones(len(rest), dtype=bool)
            yield from rest[now][np.argsort(worse[now], kind="stable")].tolist()
            rest = rest[~now]

    def pack(self, window: int) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start in its tail, length). Every one but the last is full."""
        order, turn, seed = self.order, 0, -1
        while True:
            while turn < len(order) and not self.left[order[turn]]:
                turn += 1
            if seed < 0 or not self.left[seed]:
                if turn == len(order):
                    return
                seed = int(order[turn])
            start, room, pieces = seed, window, []
            room -= self._take(seed, room, pieces)
            queue = self.neighbours(start) if room else iter(())
            cut = -1
            while room:
                if (n := next(queue, -1)) < 0:
                    while turn < len(order) and not self.left[order[turn]]:
                        turn += 1
                    if turn == len(order):
                        break
                    n = int(order[turn])
                room -= self._take(n, room, pieces)
                cut = n if self.left[n] else cut
            seed = cut  # what is left of a document that was cut opens the next window
            yield pieces

    def _take(self, doc: int, room: int, pieces: list) -> int:
        n = int(min(room, self.left[doc]))
        if n:
            pieces.append((doc, int(self.at[doc]), n))
            self.at[doc] += n
            self.left[doc] -= n
            self.unused -= not self.left[doc]
        return n


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's full windows are sequences of their own; what is left over is packed with its neighbours in its
    shard, best first by all ids of the whole texts, as long as any is unused, then with the longest others. They are cut
    where a window ends, so all sequences are full but the last of each shard. Shards are drawn
    by hash of the id and hold about `shard` documents each, whatever the input; the inverse document frequencies
    cover all documents. A null text counts as empty and is the closing id alone. Repeated rows are packed each; no
    rows give no pieces.
    """
    tokens = durable(tokenised(docs, path, pattern, id_col, text_col, window))
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("doc_tokens") - 1).alias("mean")).first()
    df = document_frequencies(tokens)
    idf = np.zeros(max(df, default=0) + 1)
    for term, n in df.items():
        idf[term] = np.log(1 + (size["n"] - n + 0.5) / (n + 0.5))
    mean, shards = float(size["mean"] or 0.0), max(1, -(-size["n"] // shard))
    shared = docs.sparkSession.sparkContext.broadcast((idf, mean))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in parts:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from pieces(held)
                    held = []
                held.append(row)
        if held:
            yield from pieces(held)

    def pieces(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        out, seq = [], held[0][0] << 32
        for _, doc, n, crcs, _, _ in held:
            for i, crc in enumerate(crcs):
                out.append((doc, i * window, window, crc, n, seq, 0))
                seq += 1
        index = Shard([r[4] for r in held], [r[5] for r in held], *shared.value)
        for sequence in index.pack(window):
            at = 0
            for k, start, n in sequence:
                _, doc, total, crcs, tail, _ = held[k]
                out.append((doc, len(crcs) * window + start, n, zlib.crc32(tail[4 * start : 4 * (start + n)]), total, seq, at))
                at += n
            seq += 1
        kinds = [id_kind, *[pa.int64()] * 6]
        for i in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 50_000], strict=True), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = tokens.schema["doc_id"].dataType
    id_kind = to_arrow_type(id_type)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    dealt = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "doc_id")
    return dealt.select("shard", "doc_id", "doc_tokens", "crcs", "tail", "bag").mapInArrow(rows, f"doc_id {id_type.simpleString()}, {PIECE}")
