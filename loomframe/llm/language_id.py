"""Language of a text: known words by per-language log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import batches, per_text, text_of

#: Bounds of the model: labelled rows fitted on for each language (expected; chosen by hash of the id), languages,
#: words and n-grams kept (those that make up most of their language), length of the longest n-gram.
SAMPLE, LANGUAGES, WORDS, GRAMS, LONGEST = 3000, 256, 120_000, 120_000, 5
UNKNOWN = "und"
#: Characters of a slice. A run of letters longer than that, with its two edges, isn't a word: it is told by its slices,
#: which overlap so that each n-gram of the run is in one; every slice weighs as a word.
SLICE = 66

_WORD = regex.compile(r"\p{L}+")


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that the model never learns from; false for a null id, which it doesn't learn from either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.filter(docs[lang_col].isNotNull() & (F.crc32(docs[id_col].cast("string").cast("binary")) % 5 != 0))
    return rows.select(rows[id_col].cast("string").alias("_id"), rows[lang_col].cast("string").alias("_lang"), text_of(rows, text_col).alias("_text"))


def slices(word: str) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + SLICE] for i in range(0, max(1, len(marked) - LONGEST + 1), SLICE - LONGEST + 1)]


def grams(part: str, n: int) -> list[str]:
    return [part[i : i + n] for i in range(len(part) - n + 1)]


def _logs(counts: list[int], totals: list[int], kinds: int) -> tuple[float, ...]:
    return tuple(math.log((c + 0.5) / (t + 0.5 * kinds)) for c, t in zip(counts, totals, strict=True))


class Model:
    """Log frequencies by language of the words and n-grams kept; scores texts."""

    def __init__(self, languages: list[str], prior: list[int], words: dict[str, list[int]], pieces: dict[str, list[int]], word_total: list[int], piece_total: dict[int, list[int]]):
        self.languages, self.prior = languages, prior
        self.words = {w: _logs(c, word_total, len(words)) for w, c in words.items()}
        self.pieces = {g: _logs(c, piece_total[len(g)], len(pieces)) for g, c in pieces.items()}

    def scorer(self):
        """text -> (language, score, words and slices that are known or have a known n-gram). The score is the winner's posterior on the mean evidence of a word, counted for
        as many words as are known, 20 at most, so that long texts don't all score 1."""
        known, parts = self.words, self.pieces
        names, kinds = self.languages, len(self.languages)
        total = sum(self.prior) or 1
        cache: dict[str, list[tuple[float, ...]]] = {}

        def unseen(part: str) -> tuple[float, ...] | None:
            for n in range(min(LONGEST, len(part)), 0, -1):
                if found := [parts[g] for g in grams(part, n) if g in parts]:
                    return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
            return None

        def logs(word: str) -> list[tuple[float, ...]]:
            """The word's own logs or those of its slices that have a known n-gram."""
            if (x := cache.get(word)) is None:
                own = known.get(word)
                x = [own] if own else [y for p in slices(word) if (y := unseen(p)) is not None]
                if len(word) < SLICE:
                    if len(cache) > 200_000:
                        cache.clear()
                    cache[word] = x
            return x

        def score(text: str) -> tuple[str, float, int]:
            counts = Counter(_WORD.findall(text.lower()))
            if not counts or not names:
                return UNKNOWN, 0.0, 0
            sums, seen = [0.0] * kinds, 0
            for word, n in counts.items():
                for x in logs(word):
                    seen += n
                    for i in range(kinds):
                        sums[i] += n * x[i]
            if not seen:
                best = max(range(kinds), key=lambda i: (self.prior[i], -i))
                return names[best], self.prior[best] / total, 0
            keep = min(seen, 20) / seen
            top = max(range(kinds), key=lambda i: (sums[i], self.prior[i], -i))
            return names[top], 1 / sum(math.exp(max(-700.0, keep * (s - sums[top]))) for s in sums), seen

        return score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of at most LANGUAGES languages from the labelled rows whose crc32(id) mod 5 is not 0.

    Counts of labels cover all rows; words are counted on about `sample` rows of each language, chosen by hash of
    the id. What reaches the driver has a fixed size: LANGUAGES labels, WORDS words and GRAMS n-grams, by language.
    Without labelled rows the model knows no language.
    """
    rows = learnable(docs, id_col, text_col, lang_col)
    labels = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(LANGUAGES).collect()
    languages = sorted(r["_lang"] for r in labels)
    size = {r["_lang"]: r["n"] for r in labels}
    at = {x: i for i, x in enumerate(languages)}
    if not languages:
        return Model([], [], {}, {}, [], {})
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / size[lang]))])
    chosen = rows.filter(F.col("_lang").isin(languages)).filter(F.pmod(F.xxhash64("_id"), F.lit(10**15)) < share[F.col("_lang")] * 10**15)
    each = chosen.select("_lang", F.explode(F.split(F.lower("_text"), r"[^\p{L}]+")).alias("_word")).filter("_word != ''")
    words = each.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_n")).cache()
    try:
        totals = {r["_lang"]: r["t"] for r in words.groupBy("_lang").agg(F.sum("_n").alias("t")).collect()}
        weight = F.create_map(*[F.lit(x) for lang in languages for x in (lang, 1.0 / max(1, totals.get(lang, 0)))])
        # as an Arrow table, as collect() would merge every task's n rows on the driver
        top = lambda df, key, n: df.orderBy(F.desc("_w"), key, "_lang").limit(n).select(key, "_lang", "_n").toArrow()
        marked, part = F.concat(F.lit(" "), "_word", F.lit(" ")), F.col("_part")
        whole = F.length(marked) <= SLICE
        kept = top(words.filter(whole).withColumn("_w", F.col("_n") * weight[F.col("_lang")]), "_word", WORDS)
        starts = F.sequence(F.lit(0), F.greatest(F.length(marked) - LONGEST, F.lit(0)), F.lit(SLICE - LONGEST + 1))
        sliced = F.when(whole, F.array(marked)).otherwise(F.transform(starts, lambda i: F.substr(marked, i + 1, F.lit(SLICE))))
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(part) - (n - 1)), lambda i: F.substr(part, i, F.lit(n)))
        lists = F.flatten(F.array(*[F.when(F.length(part) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in range(1, LONGEST + 1)]))
        pieces = words.select("_lang", "_n", F.explode(sliced).alias("_part")).select("_lang", "_n", F.explode(lists).alias("_gram")).filter("_gram != ' '").groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n"))
        heavy = top(pieces.withColumn("_w", F.col("_n") * weight[F.col("_lang")]), "_gram", GRAMS)
    finally:
        words.unpersist()

    def table(found: pa.Table) -> dict[str, list[int]]:
        out: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
        for key, lang, n in zip(*(c.to_pylist() for c in found.columns), strict=True):
            out[key][at[lang]] = n
        return dict(out)

    by_piece = table(heavy)
    of = {n: [0] * len(languages) for n in range(1, LONGEST + 1)}
    for gram, counts in by_piece.items():
        of[len(gram)] = [a + b for a, b in zip(of[len(gram)], counts, strict=True)]
    return Model(languages, [size[x] for x in languages], table(kept), by_piece, [totals.get(x, 0) for x in languages], of)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1), n_known (words and slices that told it), from the text alone.

    A text that is null or has no letters is `und` with score 0. A text of which no word or n-gram is known gets the
    most frequent language with its share of the labels as score. Of equal scores the more frequent language wins.
    Repeated rows are judged each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return per_text(docs, lambda: shared.value.scorer(), {"lang_pred": "string", "score": "double", "n_known": "long"}, id_col, text_col)


def with_language(docs: DataFrame, model: Model, to: str, text_col: str = "text") -> DataFrame:
    """docs with a column `to`: a struct of lang_pred, score and n_known; other columns stay as they are."""
    batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_known long")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = shared.value.scorer()
        for texts in parts:
            yield pd.DataFrame([score(t or "") for t in texts], columns=["lang_pred", "score", "n_known"])

    return docs.withColumn(to, judged(docs[text_col].cast("string")))
