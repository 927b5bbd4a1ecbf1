"""SentencePiece encoding by a relational lattice over the distinct words, and decoding.

Texts are parted at spaces and wherever no piece spans two neighbouring characters, which changes no result; the
distinct parts of all documents are counted. They are exploded into substrings no longer than the longest piece, an
equi-join with the piece table leaves the lattice's edges, edges are grouped by part, and a fold picks the path: for a
unigram model the Viterbi fold with higher-order functions, which gives the best sum of piece scores; for a BPE model a
fold over the edges by score, which joins neighbours, as no sum of scores gives that model's own segmentation. That one
runs in Arrow batches, because the lambdas of higher-order functions are interpreted and cost more than all else.
Documents then look their parts up: frequent ones in a broadcast table of fixed size, the others by a shuffled join,
after which each document's ids are put together.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import batches, discard, durable, release, setting, text_of

#: The mark that stands for a space, parts in the broadcast table (about), and distinct words that a task counts before it sends their parts.
SPACE, FREQUENT, REMEMBERED = "▁", 600_000, 600_000
#: Bytes of text whose words are told apart together, and distinct words that are parted together.
GATHERED, PARTED = 4 << 20, 100_000
#: Parts that a task folds, and places of a part that are exploded as one row: a longer part is cut into overlapping rows.
FOLDED, PLACES = 50_000, 64
#: Fixed value: how far below the worst piece a character without a piece scores.
PENALTY = 10.0


def _field(message: bytes, number: int, default):
    """The first field of a number in a protocol buffer message: bytes, or an integer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = message[at : at + n], at + n
        if key >> 3 == number:
            return value
    return default


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: (id, piece, score) of ordinary pieces, the ids of the 256 byte pieces (or none), the unknown id."""

    pieces: tuple[tuple[int, str, float], ...]
    bytes: tuple[int, ...]
    unknown: int
    merges: bool = False  # a BPE model

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        own = tuple((i, sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
        with open(path, "rb") as f:
            kind = _field(_field(f.read(), 2, b""), 3, 1)  # trainer_spec.model_type: 1 unigram, 2 BPE
        if kind not in (1, 2):
            raise ValueError(f"model type {kind} is neither unigram nor BPE")
        return cls(own, tuple(i for i in ids if sp.is_byte(i)), sp.unk_id(), kind == 2)

    @property
    def longest(self) -> int:
        return max((len(p) for _, p, _ in self.pieces), default=1)

    @property
    def worst(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0)

    def pairs(self) -> frozenset[str]:
        """Neighbouring characters that some piece spans."""
        return frozenset(p[i : i + 2] for _, p, _ in self.pieces for i in range(len(p) - 1))

    def check(self) -> None:
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in self.pieces):
            raise ValueError("a piece spans words: texts can't be parted at spaces")

    def table(self, spark: SparkSession) -> DataFrame:
        """id, piece, score and rank (0 for the best score)."""
        ranked = sorted(self.pieces, key=lambda x: (-x[2], x[0]))
        return spark.createDataFrame([(i, p, s, rank) for rank, (i, p, s) in enumerate(ranked)], "id int, piece string, score double, rank long")

    def late(self) -> frozenset[str]:
        """Pieces that their own characters spell only after a merge of a worse score than theirs.

        While both ends of a piece's place stand, the merges inside are those of its own characters. So all pieces but
        these either can be made at their turn, when all better merges are made, or never.
        """
        score = {p: s for _, p, s in self.pieces}
        found = set()
        for piece, own in score.items():
            left, worst = list(piece), own
            while len(left) > 1:
                best = max(((score.get(left[i] + left[i + 1], -math.inf), -i) for i in range(len(left) - 1)))
                if best[0] == -math.inf:
                    break
                i = -best[1]
                left[i : i + 2] = [left[i] + left[i + 1]]
                worst = min(worst, best[0])
            if len(left) == 1 and worst < own:
                found.add(piece)
        return frozenset(found)

    def byte_table(self, spark: SparkSession) -> DataFrame:
        """id and hex of the UTF-8 bytes of every piece."""
        rows = [(i, p.encode().hex()) for i, p, _ in self.pieces] + [(i, f"{n:02x}") for n, i in enumerate(self.bytes)]
        return spark.createDataFrame([*rows, (self.unknown, " ⁇ ".encode().hex())], "id int, hex string")


class Parts:
    """Texts as words (a word is a run of marks and what follows it) and words as parts."""

    def __init__(self, vocabulary: Pieces):
        vocabulary.check()
        self.pairs = vocabulary.pairs()
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.odd = re.compile(r"[\W\d_]")
        self.at_once = self._pattern()

    def _pattern(self) -> re.Pattern:
        """Finds the parts of a whole marked text in one pass: neighbours stay together if both are letters or a piece
        spans them."""
        before: dict[str, set[str]] = {}  # by character: those that it stays together with, where one is no letter
        for a, b in self.pairs:
            if self.odd.match(a) or self.odd.match(b):
                before.setdefault(b, set()).add(a)
        alike: dict[tuple, list[str]] = {}
        for b, those in before.items():
            if b != SPACE:
                alike.setdefault((bool(self.odd.match(b)), "".join(map(re.escape, sorted(those)))), []).append(re.escape(b))
        of = lambda chars: f"[{''.join(sorted(chars))}]" if chars else "(?!)"
        letter, none = r"[^\W\d_]", r"[\W\d_]"
        more = "|".join(f"{of(chars)}(?<=[{those}].){'' if odd else letter + '*'}" for (odd, those), chars in sorted(alike.items()))
        more = f"(?={of([c for chars in alike.values() for c in chars])})(?:{more})"
        marks = f"{SPACE}(?<={SPACE}{SPACE})|" if SPACE in before.get(SPACE, ()) else ""
        first = of([re.escape(b) for b, those in before.items() if SPACE in those and not self.odd.match(b)])
        return re.compile(f"(?:{SPACE}{first}{letter}*|{letter}+|{none})(?:{marks}{more})*", re.DOTALL)

    def of_text(self, text: str) -> list[str]:
        """The parts of all the text's words."""
        return self.at_once.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def of(self, word: str) -> list[str]:
        """The word's parts: cut beside characters that are no letters, where no piece spans the cut."""
        cuts = [0]
        for m in self.odd.finditer(word):
            i = m.start()
            if i > cuts[-1] and word[i - 1 : i + 1] not in self.pairs:
                cuts.append(i)
            if word[i : i + 2] not in self.pairs:
                cuts.append(i + 1)
        if cuts[-1] < len(word):
            cuts.append(len(word))
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def words(self, text: str) -> list[str]:
        """Joined, the words are the text with a mark before it and for each of its spaces; of nothing, nothing."""
        if self.plain(text):
            return [SPACE + w for w in text.split(" ")]
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def plain(self, text: str) -> bool:
        """Whether single spaces alone part the text's words."""
        return bool(text) and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " "

    def of_words(self, words: pa.Array, plain: bool) -> tuple[list[str], np.ndarray]:
        """The parts of words without their first mark, one word after the other, and how many each word has.

        No part of plain words crosses from a word into the next one's mark, so they are parted together.
        """
        if not plain:
            lists = [self.at_once.findall(SPACE + w) for w in words.to_pylist()]
            return list(itertools.chain.from_iterable(lists)), np.fromiter(map(len, lists), np.int64, len(lists))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), SPACE)[0].as_py()
        flat = self.at_once.findall(SPACE + text)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
        of_words = np.searchsorted(ends, np.cumsum(pc.utf8_length(words).to_numpy() + 1, dtype=np.int64)) + 1
        return flat, np.diff(of_words, prepend=0)

    def gathered(self, batches_: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, bool, np.ndarray, pa.Array]]:
        """Batches of some GATHERED bytes in column `at`, with whether their texts are plain, how many words each text has,
        and the words without their first mark. Rows of plain texts come apart from the others."""

        def told(b: pa.RecordBatch):
            text = b.column(at)
            odd = pc.equal(pc.binary_length(text), 0)
            for found in (pc.match_substring(text, "  "), pc.match_substring(text, SPACE), pc.starts_with(text, " "), pc.ends_with(text, " ")):
                odd = pc.or_(odd, found)
            others = b.filter(odd)
            if others.num_rows:
                b = b.filter(pc.invert(odd))
            if b.num_rows:
                words = pc.split_pattern(b.column(at), " ")
                yield b, True, words.value_lengths().to_numpy().astype(np.int64), words.flatten().cast(pa.string())
            if others.num_rows:
                lists = list(map(self.words, others.column(at).to_pylist()))
                yield others, False, np.fromiter(map(len, lists), np.int64, len(lists)), pa.array([w[1:] for x in lists for w in x], pa.string())

        held: list[pa.RecordBatch] = []
        for b in itertools.chain(batches_, [None]):  # None: the end
            held += [] if b is None else [b]
            if held and (b is None or sum(x.column(at).nbytes for x in held) >= GATHERED):
                every, held = pa.concat_batches(held), []
                yield from told(every)
                pa.default_memory_pool().release_unused()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("_text"))


def distinct_parts(docs: DataFrame, vocabulary: Pieces, text_col: str = "text") -> DataFrame:
    """The distinct parts of all texts with their counts: word, n. Tasks count before they shuffle."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def flushed(parts: Parts, words: pa.Table, plain: bool) -> pa.Table:
        found = []
        for at in range(0, len(words), PARTED):
            some = words.slice(at, PARTED).combine_chunks()
            flat, n = parts.of_words(pa.concat_arrays(some["word"].chunks), plain)
            found.append(summed([pa.table({"word": pa.array(flat, pa.string()), "n": np.repeat(some["n"].to_numpy(), n)})]))
        return summed(found)

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(vocabulary)
        held: dict[bool, list[pa.Table]] = {True: [], False: []}  # counted words of plain texts, and of others
        for _, plain, _, words in parts.gathered(batches_, 0):
            if len(words):
                held[plain].append(pa.table(words.value_counts().flatten(), ["word", "n"]))
            if sum(map(len, held[plain])) > 2 * REMEMBERED:
                held[plain] = [summed(held[plain])]
                if len(held[plain][0]) > REMEMBERED:
                    yield from flushed(parts, held[plain].pop(), plain).to_batches()
        last = [flushed(parts, summed(x), plain) for plain, x in held.items() if x]
        if last:
            yield from summed(last).to_batches()

    batches(docs.sparkSession)
    found = docs.select(text_of(docs, text_col).alias("_text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def dealt(distinct: DataFrame, tasks: int) -> DataFrame:
    """distinct(word, n) with 128 bits of hash: k, k2, word, n, dealt over so many tasks by k."""
    return distinct.select(F.xxhash64("word").alias("k"), "word", "n").repartition(tasks, "k").withColumn("k2", F.xxhash64("word", F.lit(1)))


def _substrings(distinct: DataFrame, vocabulary: Pieces, least: int) -> DataFrame:
    """k, k2 and n of distinct(k, k2, word, n) with a row a piece of `least` characters or more at start to end, a row a
    character if least is 1, and one row with the word itself.

    The join is with a table of fixed size, and explode keeps a word's rows where they are, so neither substrings nor edges
    are shuffled. Rows of substrings carry some PLACES characters, not the word, so that long words stay linear.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.length("word") - 1) / PLACES).cast("int"))
    cut = lambda i: F.struct((i * PLACES).alias("base"), F.lit(None).cast("string").alias("own"), F.substr(F.col("word"), i * PLACES + 1, F.lit(PLACES + vocabulary.longest - 1)).alias("text"))
    itself = F.array(F.struct(F.lit(0).alias("base"), F.col("word").alias("own"), F.lit("").alias("text")))
    rows = distinct.select("k", "k2", "n", F.explode(F.concat(itself, F.transform(blocks, cut))).alias("c")).select("k", "k2", "n", "c.*", F.length("c.text").alias("size"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.lit(PLACES), F.col("size")) - 1, F.lit(0)))).alias("at"))
    ends = F.when(F.col("own").isNotNull(), F.array(F.lit(0))).when(F.col("at") + least <= F.col("size"), F.sequence(F.col("at") + least, F.least(F.col("size"), F.col("at") + vocabulary.longest)))
    rows = rows.select("*", F.explode(ends).alias("to")).withColumn("piece", F.substring("text", F.col("at") + 1, F.col("to") - F.col("at")))
    found = rows.select("k", "k2", "n", "own", "piece", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("to")).alias("end"))
    found = found.join(F.broadcast(vocabulary.table(distinct.sparkSession)), "piece", "left")
    return found.filter("id is not null or own is not null" + (" or end - start = 1" if least == 1 else ""))


def lattice(distinct: DataFrame, vocabulary: Pieces) -> DataFrame:
    """word, n and edges (end, start, score, id) of distinct(k, k2, word, n); id is null for a character without a piece."""
    edge = F.struct("end", "start", F.coalesce("score", F.lit(vocabulary.worst - PENALTY)).alias("score"), "id")
    edges = F.sort_array(F.collect_list(F.when(F.col("own").isNull(), edge)))
    return _substrings(distinct, vocabulary, 1).groupBy("k", "k2").agg(F.max("own").alias("word"), F.max("n").alias("n"), edges.alias("edges")).drop("k", "k2")


def best_path(edges: Column) -> Column:
    """For each position, 0 first: the best score of a path to it, and the start and id of the path's last piece.

    Edges come by end, then start. Of equal scores the one whose last piece is longer wins.
    """
    node = lambda score, back, id_: F.struct(score.alias("score"), back.alias("back"), id_.alias("id"))
    origin = F.array(node(F.lit(0.0), F.lit(0), F.lit(None).cast("int")))

    def step(done: Column, e: Column) -> Column:
        score = F.get(done, e["start"])["score"] + e["score"]
        new = F.array(node(score, e["start"], e["id"]))
        last = F.size(done) == e["end"]
        better = score > F.get(done, e["end"])["score"]
        return F.when(last, F.concat(done, new)).when(better, F.concat(F.slice(done, 1, e["end"]), new)).otherwise(done)

    return F.aggregate(edges, origin, step)


#: Bits of an edge's length and start in a packed edge, above which its rank stands.
LENGTH_BITS, START_BITS = 8, 34


def merges(ranks: tuple[int, ...], late: frozenset[int]) -> Callable[[list[int], int], list[tuple[int, int]]]:
    """(packed edges of a part, its length) -> the pieces after all merges, as (place, id or -1 for a character).

    One pass over the edges by score, then place, makes every merge whose two neighbours are there at its turn. If an edge
    of the part is `late` (see Pieces.late), the pass starts again after each merge. ranks has the id of each rank.
    """
    starts, lengths = (1 << START_BITS) - 1, (1 << LENGTH_BITS) - 1

    def run(packed: list[int], length: int) -> list[tuple[int, int]]:
        packed.sort()
        each = [(x >> LENGTH_BITS + START_BITS, x >> LENGTH_BITS & starts, x & lengths) for x in packed]
        after = [*range(1, length + 1), -1]  # where the piece that starts here ends; 0 where none does
        own = [-1] * length
        again = bool(late) and any(rank in late for rank, _, _ in each)
        while True:
            made = False
            for rank, a, n in each:
                if (mid := after[a]) and after[mid] == a + n:
                    after[a], after[mid], own[a] = a + n, 0, ranks[rank]
                    made = True
                    if again:
                        break
            if not (again and made):
                break
        return [(i, own[i]) for i in range(length) if after[i]]

    return run


def _merged(distinct: DataFrame, vocabulary: Pieces) -> DataFrame:
    """word, n and ids of distinct(k, k2, word, n) by merges."""
    if vocabulary.longest >> LENGTH_BITS or len(vocabulary.pieces) >> 62 - LENGTH_BITS - START_BITS:
        raise ValueError("the vocabulary doesn't fit a packed edge")
    left = lambda c, by: F.call_function("shiftleft", F.col(c).cast("long"), F.lit(by))
    packed = F.when(F.col("own").isNull(), left("rank", LENGTH_BITS + START_BITS) + left("start", LENGTH_BITS) + F.col("end") - F.col("start"))
    grouped = _substrings(distinct, vocabulary, 2).groupBy("k", "k2").agg(F.max("own").alias("word"), F.max("n").alias("n"), F.collect_list(packed).alias("edges")).drop("k", "k2")
    ranked = sorted(vocabulary.pieces, key=lambda x: (-x[2], x[0]))
    late = vocabulary.late()
    late_ranks = frozenset(r for r, (_, p, _) in enumerate(ranked) if p in late)
    ids, single = tuple(i for i, _, _ in ranked), {p: i for i, p, _ in ranked if len(p) == 1}

    def spelled(c: str) -> list[int]:
        return [vocabulary.bytes[x] for x in c.encode("utf-8", "surrogatepass")] if vocabulary.bytes else [vocabulary.unknown]

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = merges(ids, late_ranks)
        for b in parts:
            lists, flat, at, sizes = b.column(2), b.column(2).flatten().to_pylist(), 0, [0]
            own: list[int] = []
            for word, n in zip(b.column(0).to_pylist(), lists.value_lengths().to_pylist(), strict=True):
                for i, x in run(flat[at : at + n], len(word)):
                    if x >= 0:
                        own.append(x)
                    elif (x := single.get(word[i])) is not None:
                        own.append(x)
                    else:
                        own += spelled(word[i])
                at += n
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(own, pa.int32()))], ["word", "n", "ids"])

    return grouped.mapInArrow(fold, "word string, n long, ids array<int>")


def _best_paths(distinct: DataFrame, vocabulary: Pieces) -> DataFrame:
    """word, n and path (s, e, id) of distinct(k, k2, word, n) by the best sum of scores."""
    done = lattice(distinct, vocabulary).select("word", "n", best_path(F.col("edges")).alias("grid"))
    start = F.struct(F.length("word").alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("p"))

    def back(state: Column, _: Column) -> Column:
        n = F.get(F.col("grid"), state["at"])
        piece = F.struct(n["back"].alias("s"), state["at"].alias("e"), n["id"].alias("id"))
        return F.when(state["at"] == 0, state).otherwise(F.struct(n["back"].alias("at"), F.concat(F.array(piece), state["p"]).alias("p")))

    return done.select("word", "n", F.aggregate(F.col("grid"), start, back)["p"].alias("path"))


def _by_viterbi(distinct: DataFrame, vocabulary: Pieces) -> DataFrame:
    """word, n and ids of distinct(k, k2, word, n) by the best sum of scores."""
    path = _best_paths(distinct, vocabulary)
    raw = lambda p: F.hex(F.encode(F.substr(F.col("word"), p["s"] + 1, p["e"] - p["s"]), "utf-8"))
    if vocabulary.bytes:
        low = vocabulary.bytes[0]
        spelled = lambda p: F.transform(F.sequence(F.lit(1), F.length(raw(p)), F.lit(2)), lambda i: F.conv(F.substr(raw(p), i, F.lit(2)), 16, 10).cast("int") + low)
    else:
        spelled = lambda p: F.array(F.lit(vocabulary.unknown))
    plain = F.transform("path", lambda p: p["id"])
    full = F.flatten(F.transform("path", lambda p: F.when(p["id"].isNull(), spelled(p)).otherwise(F.array(p["id"]))))
    return path.select("word", "n", F.when(F.exists(plain, lambda x: x.isNull()), full).otherwise(plain).alias("ids"))


def encode_words(distinct: DataFrame, vocabulary: Pieces) -> DataFrame:
    """word, n and ids of distinct(k, k2, word, n), which is dealt out by k; evaluated here and written."""
    spark = distinct.sparkSession
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * FOLDED)), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "20000"):
        return durable((_merged if vocabulary.merges else _by_viterbi)(distinct, vocabulary))  # no name: durable frees its shuffle


def decode(rows: DataFrame, vocabulary: Pieces, key: str = "word") -> DataFrame:
    """key and text of rows(key, ids): the pieces' bytes joined, marks as spaces. Keys are distinct; unknown ids read as ` ⁇ `."""
    each = rows.select(key, F.posexplode("ids").alias("_at", "id"))
    named = each.join(F.broadcast(vocabulary.byte_table(rows.sparkSession)), "id")
    joined = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "hex"))).alias("_p"))
    raw = F.unhex(F.array_join(F.transform("_p", lambda p: p["hex"]), ""))
    return joined.select(key, F.replace(F.decode(raw, "utf-8"), F.lit(SPACE), F.lit(" ")).alias("text"))


ROW = ["row", "doc_id", "codes", "holes", "rare", "seen"]


class Codes:
    """Ids as code points, frequent ones first, so that UTF-8 holds most in a byte; 0 stands for a hole."""

    def __init__(self, ids: list[int]):
        places = np.arange(1, len(ids) + 1)
        self.points = np.where(places < 0xD800, places, places + 0x800).astype(np.uint32)  # no surrogates
        self.ids = np.zeros(int(self.points.max(initial=0)) + 1, dtype=np.int32)
        self.ids[self.points] = ids
        self.of = np.zeros(max(ids, default=0) + 1, dtype=np.uint32)
        self.of[ids] = self.points


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes, dtype=np.int64)])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each size n."""
    return np.arange(int(sizes.sum())) - np.repeat(_offsets(sizes)[:-1], sizes)


def _bytes(array: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a large binary array that begins at its buffers' start."""
    if not len(array):
        return np.zeros(1, dtype=np.int64), memoryview(b"")
    data = array.buffers()[2]
    return np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + 1), memoryview(data if data else b"")


def _binary(offsets: np.ndarray, data) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _frequent(parts: pa.Array, ids: pa.ListArray, codes: Codes) -> bytes:
    """Parts, and the codes of their ids with a hole after the last one, to be broadcast: compressed, as each executor keeps
    a copy on disk, and read as Arrow arrays, as a dictionary of Python objects takes several times their memory."""
    points, sizes = codes.of[ids.flatten().to_numpy()].astype("<u4"), ids.value_lengths().to_numpy()
    own = _binary(4 * _offsets(np.append(sizes, 1)), np.append(points, np.uint32(0)))
    table, sink = pa.record_batch([pa.concat_arrays([parts, pa.nulls(1, pa.string())]), own], ["part", "codes"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _looked_up(table: Callable[[], bytes], vocabulary: Pieces):
    """Rows (row, doc_id, text) as ROW: the codes of the ids with holes, for each hole the place of its part among the row's
    rare parts, those parts, all compressed, and a hash of the text. Each distinct word is looked up once a batch."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        from zstandard import ZstdCompressor

        packed = ZstdCompressor(level=6, write_checksum=False).compress
        parts, (often, own_codes) = Parts(vocabulary), pa.ipc.open_stream(table()).read_next_batch().columns
        for b, plain, n_words, words in parts.gathered(batches_, 2):
            words = words.dictionary_encode()
            which, docs = words.indices.to_numpy(), np.arange(b.num_rows + 1)
            flat, n_parts = parts.of_words(words.dictionary, plain)
            places = pc.index_in(pa.array(flat, pa.string()), often)
            holes = places.is_null().to_numpy(zero_copy_only=False)
            at, data = _bytes(own_codes.take(places.fill_null(len(often) - 1)))
            at, data = _bytes(_binary(at[_offsets(n_parts)], data).take(words.indices))
            ends = at[_offsets(n_words)].tolist()

            rare = pa.array(list(itertools.compress(flat, holes.tolist())), pa.string()).dictionary_encode()
            n_rare = np.add.reduceat(np.append(holes, False), _offsets(n_parts)[:-1], dtype=np.int64) if len(n_parts) else n_parts
            names, first = rare.dictionary.to_pylist(), _offsets(n_rare)
            with_rare = np.flatnonzero(n_rare[which])
            count = n_rare[which[with_rare]]
            doc = np.repeat(np.searchsorted(_offsets(n_words), with_rare, side="right") - 1, count)
            far = rare.indices.to_numpy()[np.repeat(first[which[with_rare]], count) + _within(count)]
            distinct, seen_at, place = np.unique(doc * max(1, len(names)) + far, return_index=True, return_inverse=True)
            order = np.argsort(seen_at)  # rare parts as their texts first hold them
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            of_doc, of_hole = np.searchsorted(doc[seen_at[order]], docs), np.searchsorted(doc, docs).tolist()
            place = (rank[place] - of_doc[doc]).astype("<u4")
            listed, of_doc = (distinct[order] % max(1, len(names))).tolist(), of_doc.tolist()

            cols: list[list] = [[] for _ in range(4)]
            for i, text in enumerate(b.column(2).cast(pa.large_binary()).to_pylist()):
                far = [names[x] for x in listed[of_doc[i] : of_doc[i + 1]]]
                cols[0].append(packed(str(data[ends[i] : ends[i + 1]], "utf-32-le").encode()))
                cols[1].append(packed(place[of_hole[i] : of_hole[i + 1]].tobytes()) if far else b"")
                cols[2].append(packed(_listed(far)) if far else b"")
                cols[3].append(xxh3_128_digest(text))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.binary()) for c in cols]], ROW)

    return run


def _listed(names: list[str]) -> bytes:
    return np.array([len(names), *map(len, names)], dtype="<u4").tobytes() + "".join(names).encode()


def _names(raw: bytes) -> list[str]:
    n = int.from_bytes(raw[:4], "little")
    ends, text = np.cumsum(np.frombuffer(raw, dtype="<u4", offset=4, count=n)).tolist(), raw[4 + 4 * n :].decode()
    return [text[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def _rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ROW) as row, at, word: one for each rare part."""
    from zstandard import ZstdDecompressor

    opened = ZstdDecompressor().decompress
    for b in parts:
        lists = [_names(opened(x)) if x else [] for x in b.column(4).to_pylist()]
        n = np.array([len(x) for x in lists], dtype=np.int64)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(at.astype(np.int32)), pa.array([w for x in lists for w in x], pa.string())], ["row", "at", "word"])


def _as_codes(parts: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """Rows (word, ids) as word and codes."""
    for b in parts:
        points = codes.of[b.column(1).flatten().to_numpy()].astype("<u4").tobytes().decode("utf-32-le")
        ends = np.cumsum(b.column(1).value_lengths().to_numpy()).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([points[a:z] for a, z in zip([0, *ends], ends, strict=False)], pa.string())], ["word", "own"])


def _joined(parts: Iterator[pa.RecordBatch], pieces: dict[int, bytes], codes: Codes) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, codes, holes, rare, seen, fills) as doc_id, ids, n_pieces, decoded_sha256, round_trip."""
    from xxhash import xxh3_128_digest
    from zstandard import ZstdDecompressor

    opened, mark = ZstdDecompressor().decompress, SPACE.encode()
    spelled = pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.large_binary())
    lengths = lambda lists: lists.value_lengths().fill_null(0).to_numpy()
    for b in parts:
        raw = [opened(x).decode() for x in b.column(1).to_pylist()]
        held = [opened(x) if x else b"" for x in b.column(2).to_pylist()]
        flat = np.frombuffer("".join(raw).encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        fills = b.column(5).flatten()
        n = pc.utf8_length(fills).to_numpy().astype(np.int64)
        start, own = _offsets(n), np.frombuffer("".join(fills.to_pylist()).encode("utf-32-le"), dtype="<u4")
        at = np.flatnonzero(flat == 0)
        n_holes = np.array([len(x) for x in held], dtype=np.int64) // 4
        which = np.frombuffer(b"".join(held), dtype="<u4") + np.repeat(_offsets(lengths(b.column(5)))[:-1], n_holes)
        count = np.ones(len(flat), dtype=np.int64)
        count[at] = n[which]
        to = _offsets(count)
        ids = np.empty(int(to[-1]), dtype=np.int32)
        plain = flat != 0
        ids[to[:-1][plain]] = codes.ids[flat[plain]]
        inner = _within(n[which])
        ids[np.repeat(to[:-1][at], n[which]) + inner] = codes.ids[own[np.repeat(start[which], n[which]) + inner]]
        ends = to[_offsets(sizes)]
        cols: list[list] = [[] for _ in range(2)]
        every = spelled.take(pa.array(ids))
        bounds = np.frombuffer(every.buffers()[1], dtype=np.int64, count=len(ids) + 1)[ends].tolist()
        joined = every.buffers()[2]
        joined = memoryview(joined) if joined else b""
        for i, seen in enumerate(b.column(4).to_pylist()):
            told = bytes(joined[bounds[i] : bounds[i + 1]]).replace(mark, b" ")[1:]
            cols[0].append(hashlib.sha256(told).hexdigest())
            cols[1].append(xxh3_128_digest(told) == seen)
        out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([b.column(0), out, pa.array(np.diff(ends)), *map(pa.array, cols, (pa.string(), pa.bool_()))], ["doc_id", "ids", "n_pieces", "decoded_sha256", "round_trip"])


#: Parts of one count are told apart by hash into so many shares.
SHARES = 1 << 20


def _least(known: DataFrame, frequent: int) -> tuple[int, int]:
    """Some `frequent` parts are more frequent than the first number, or as frequent and of the first shares of that many.

    Found among the distinct counts, so that no part is sorted or shuffled for it.
    """
    counts = known.groupBy("n").count().toArrow()
    n, parts = (counts[c].to_numpy() for c in ("n", "count"))
    order = np.argsort(-n)
    upto = np.cumsum(parts[order])
    at = int(np.searchsorted(upto, frequent, side="right"))
    if at == len(n):
        return 0, 0
    return int(n[order[at]]), int((frequent - upto[at] + parts[order[at]]) * SHARES // parts[order[at]])


def encode(docs: DataFrame, vocabulary: Pieces, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row of docs: doc_id, ids (32-bit integers), n_pieces, decoded_sha256 (of the text that the ids decode to) and
    round_trip (that text is the row's own).

    Null and empty texts have no ids. Repeated rows are encoded each, ids of any type pass through, nulls included;
    other columns are ignored. A text that holds the mark for spaces decodes to spaces there. Parts are encoded once over
    all documents; only parts that are not among some `frequent` most frequent ones are shuffled, once a document that
    holds them, and then the documents' ids.
    """
    spark = docs.sparkSession
    parts = durable(distinct_parts(docs, vocabulary, text_col))
    tasks = max(1, -(-parts.count() // FOLDED))
    known = encode_words(dealt(parts, tasks), vocabulary)
    discard(parts)
    least, some = _least(known, frequent)
    chosen = known.filter((F.col("n") > least) | (F.col("n") == least) & (F.pmod(F.xxhash64("word", F.lit(2)), F.lit(SHARES)) < some))
    head = chosen.select("word", "ids", "n").toArrow().combine_chunks()
    often, ids, counts = head["word"], head["ids"], head["n"].to_numpy()
    often, ids = (pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], kind) for x, kind in ((often, pa.string()), (ids, pa.list_(pa.int32()))))
    del head
    pieces = {i: p.encode() for i, p, _ in vocabulary.pieces} | {i: bytes([n]) for n, i in enumerate(vocabulary.bytes)}
    pieces.setdefault(vocabulary.unknown, " ⁇ ".encode())
    used = np.zeros(max(pieces) + 1, dtype=np.int64)
    np.add.at(used, ids.flatten().to_numpy(), np.repeat(counts, ids.value_lengths().to_numpy()))
    codes = Codes(sorted(pieces, key=lambda i: (-used[i], i)))
    shared = spark.sparkContext.broadcast(_frequent(often, ids, codes))
    release(spark)
    given = _texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "_text")
    kind = given.schema["doc_id"].dataType.simpleString()
    rows = given.mapInArrow(_looked_up(lambda: shared.value, vocabulary), f"row long, doc_id {kind}, codes binary, holes binary, rare binary, seen binary")
    spread = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(spread, "row")
    far = rows.mapInArrow(_rare, "row long, at int, word string")  # takes all columns, so that both sides read one shuffle
    own = known.filter(F.col("n") <= least).select("word", "ids").mapInArrow(lambda parts: _as_codes(parts, codes), "word string, own string")
    far = far.join(own, "word")
    fills = far.repartition(spread, "row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "own"))).alias("_f")).select("row", F.transform("_f", lambda f: f["own"]).alias("fills"))
    out = rows.join(fills, "row", "left").select("doc_id", "codes", "holes", "rare", "seen", "fills")
    return out.mapInArrow(lambda parts: _joined(parts, pieces, codes), f"doc_id {kind}, ids array<int>, n_pieces long, decoded_sha256 string, round_trip boolean")
