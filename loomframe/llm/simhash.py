"""SimHash fingerprints by signed votes of term hashes, and permuted block tables. DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import text_of

#: Words of a term, 64-bit lanes of a fingerprint, documents of a block (expected), blocks at most.
WORDS, LANES, BLOCK, BLOCKS = 5, 2, 2000, 50_000
BITS = 64 * LANES


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, lower-cased and parted by white space."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def terms(hashes: Column, words: int = WORDS) -> Column:
    """Hashes of the word shingles, one for each place, so that a term weighs as often as it occurs.

    Fewer words than a shingle has make one term of them all. `hashes` is a column that is there, not an expression,
    which would be worked out again for each place.
    """
    last = F.greatest(F.size(hashes) - (words - 1), F.lit(1))
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, words)))
    return F.when(F.size(hashes) > 0, every).otherwise(F.array().cast("array<bigint>"))


def lanes() -> dict[str, Column]:
    """`_h0`, `_h1`, …: independent hashes of a term, from its hash `_h`."""
    return {f"_h{n}": F.col("_h") if not n else F.when(F.col("_h").isNotNull(), F.xxhash64("_h", F.lit(n))) for n in range(LANES)}


def votes() -> list[Column]:
    """Sums over rows of `_h0`, …: two counters of 32 bits each, for bits i and i + 32 of a hash."""
    return [F.sum(F.shiftrightunsigned(f"_h{n}", i).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"_v{n}_{i}") for n in range(LANES) for i in range(32)]


def from_votes(count: str = "_count") -> Column:
    """The fingerprint, an array of longs: a bit is set if more terms have it set than not. No terms: 0."""
    bit = lambda ones, i: F.when(F.coalesce(ones, F.lit(0)) * 2 > F.col(count), F.lit((1 << i) - (1 << 64) * (i == 63))).otherwise(F.lit(0))

    def lane(n: int) -> Column:
        parts = [bit(F.col(f"_v{n}_{i}").bitwiseAND(F.lit((1 << 32) - 1)), i) for i in range(32)]
        parts += [bit(F.shiftrightunsigned(f"_v{n}_{i}", 32), i + 32) for i in range(32)]
        while len(parts) > 1:
            parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2], strict=True)]
        return parts[0]

    return F.array(*map(lane, range(LANES)))


def distance(a: Column, b: Column) -> Column:
    """Bits that differ."""
    return sum((F.bit_count(F.get(a, F.lit(n)).bitwiseXOR(F.get(b, F.lit(n)))) for n in range(LANES)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits that agree."""
    return (F.lit(BITS) - distance(a, b)) / F.lit(float(BITS))


def as_hex(fingerprint: Column) -> Column:
    """The last lane first, 16 digits each."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.get(fingerprint, F.lit(n))), 16, "0") for n in reversed(range(LANES))]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns of `keep`) and the fingerprint of each row's text; null counts as empty.

    The votes are counted where the row is: terms are exploded and summed without a shuffle of text.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), *keep, text_of(docs, text_col).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("doc_id", *keep, "_row", F.explode(F.array(word_hashes(F.col("_text")))).alias("_x"))
    rows = rows.select("doc_id", *keep, "_row", F.explode_outer(terms(F.col("_x"))).alias("_h"))
    rows = rows.withColumns(lanes())
    out = rows.groupBy("doc_id", *keep, "_row").agg(F.count("_h").alias("_count"), *votes())
    return out.select("doc_id", *keep, from_votes().alias("fingerprint"))


def near(prints: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """All pairs (a, b, distance) of different fingerprints in prints(fingerprint) within the Hamming radius, a < b.

    `radius` flipped bits touch at most `radius` blocks, so near fingerprints agree in some blocks - radius of them:
    there is a table for each choice of those, keyed by their bits. Equal fingerprints are one row, so copies make
    no pairs. A pair is reported once, by the first table that holds it. Nulls are left out.
    """
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    part = lambda m, n: (x := m >> 64 * n & (1 << 64) - 1) - (1 << 64) * (x >> 63)
    under = lambda f, m: F.array(*[F.get(f, F.lit(n)).bitwiseAND(F.lit(part(m, n))) for n in range(LANES)])
    own = prints.filter("fingerprint is not null").select("fingerprint").distinct()
    keyed = own.select("fingerprint", F.posexplode(F.array(*[under(F.col("fingerprint"), m) for m in masks])).alias("_table", "_key"))
    a, b = keyed.withColumnRenamed("fingerprint", "a"), keyed.withColumnRenamed("fingerprint", "b")
    pairs = a.join(b, ["_table", "_key"]).filter(F.col("a") < F.col("b")).withColumn("distance", distance(F.col("a"), F.col("b")))
    first = F.array_position(F.array(*[under(F.col("a"), m) == under(F.col("b"), m) for m in masks]), True) - 1
    return pairs.filter((F.col("distance") <= radius) & (F.col("_table") == first)).select("a", "b", "distance")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in blocks of neighbouring ids: _block, _halo, _key, _tie, _id, _text.

    The ids alone are range-partitioned, which gives the bounds of blocks of about BLOCK rows; then each text goes
    to its block, in the only shuffle of texts. The largest id of a block goes to the block above as well (_halo),
    and that of the last block to the first one's end, so that each block holds every row's next one.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("_key"), docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text"))
    n = max(1, min(BLOCKS, -(-rows.count() // BLOCK)))
    parts = rows.select("_key").repartitionByRange(n, "_key").withColumn("_p", F.spark_partition_id())
    bounds = sorted((r["lo"], r["hi"]) for r in parts.groupBy("_p").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect())
    n = max(1, len(bounds))
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs)) or "0"), ",").cast("array<bigint>")
    lows, highs = listed([b[0] for b in bounds]), listed([b[1] for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length(), -1, -1)])
    block = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s < n) & (F.get(lows, F.least(at + s, F.lit(n - 1))) <= F.col("_key")), at + s).otherwise(at))
    rows = rows.withColumn("_block", block).withColumn("_tie", F.xxhash64("_text"))
    above = F.struct(F.pmod(F.col("_block") + 1, F.lit(n)).alias("b"), F.lit(True).alias("h"))
    here = F.struct(F.col("_block").alias("b"), F.lit(False).alias("h"))
    to = F.when(F.get(highs, F.col("_block")) == F.col("_key"), F.array(here, above)).otherwise(F.array(here))
    return rows.withColumn("_to", F.explode(to)).select(F.col("_to.b").alias("_block"), F.col("_to.h").alias("_halo"), "_key", "_tie", "_id", "_text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the start of the next document, in descending order of the id
    (after the last: the first). Null texts count as empty; null ids come last; rows that repeat an id follow one
    another by a hash of their text. Other columns are ignored.
    """
    down = Window.partitionBy("_block").orderBy("_halo", F.desc("_key"), "_tie")
    rows = in_order(docs, id_col, text_col).withColumn("_next", F.lead("_text").over(down))
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("_edited", edited)
    keys = ["_block", "_halo", "_key", "_tie", "_id", "_row", "_chars", "_sha"]
    rows = rows.withColumns({"_row": F.monotonically_increasing_id(), "_chars": F.length("_text").cast("long"), "_sha": F.sha2("_edited", 256)})
    each = F.array(*[F.struct(F.lit(e).alias("e"), word_hashes(F.col(c)).alias("h")) for e, c in ((False, "_text"), (True, "_edited"))])
    flat = rows.select(*keys, F.explode(each).alias("_x")).select(*keys, F.col("_x.e").alias("_e"), F.col("_x.h").alias("_w"))
    flat = flat.select(*keys, "_e", F.explode_outer(terms(F.col("_w"))).alias("_h"))
    flat = flat.withColumns(lanes())
    both = flat.groupBy(*keys, "_e").agg(F.count("_h").alias("_count"), *votes()).select(*keys, "_e", from_votes().alias("_f"))
    pick = lambda e: F.array(*[F.max(F.when(F.col("_e") == F.lit(e), F.get("_f", F.lit(n)))) for n in range(LANES)])
    own = both.groupBy(*keys).agg(pick(False).alias("_own"), pick(True).alias("_new"))
    own = own.withColumn("_after", F.lead("_own").over(down)).filter(~F.col("_halo"))
    return own.select(
        F.col("_id").alias("doc_id"),
        F.col("_chars").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        as_hex(F.col("_own")).alias("fingerprint"),
        as_hex(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )
