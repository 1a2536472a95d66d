"""N-gram language models: counting, vocabulary, scores, next words.

The model is one table of n-grams keyed by their words joined with a space; a
context is its prefix.  Scores back off by dropping the LAST words of a window
(the longest known prefix counts), which is not the textbook's way round.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgram.functions.analysis import sentences, windows, words
from sparkgram.operators.ranking import dense_ids, top_k
from sparkgram.plans import gram_blocks
from sparkgram.sources.config import LanguageModelConfig
from sparkgram.sources.scratch import cut

BACKOFF = 0.4
#: Score of what was never seen.
UNKNOWN_SCORE = -100.0
UNKNOWN_WORD = "<UNK>"
#: Bits of the sieve that keeps grams nobody asks for out of the counting (16 MB), and longs on a page of it.
SIEVE_BITS, SIEVE_PAGE = 1 << 27, 1024
FORMAT_VERSION = 1


def split_sentences(texts: DataFrame, text_col: str, config: LanguageModelConfig, *keys: str) -> DataFrame:
    """``(keys..., pos, words)`` of the sentences that have words."""
    pieces = texts.select(*keys, F.posexplode(sentences(F.col(text_col), config.separators)).alias("pos", "sentence"))
    return pieces.select(*keys, "pos", words(F.col("sentence"), config.alphabet).alias("words")).where(F.size("words") > 0)


def _wrapped(tokens: Column, config: LanguageModelConfig) -> Column:
    return F.concat(F.array(F.lit(config.start)), tokens, F.array(F.lit(config.end)))


def gram_rows(sents: DataFrame, config: LanguageModelConfig, least: int = 1, most: int | None = None, contexts: bool = False) -> DataFrame:
    """``(n, gram)`` of every ``least``- to ``most``-gram of the wrapped sentences, as
    often as it occurs.  ``contexts`` adds ``context``, the gram
    without its last word."""
    most = most or config.order
    wrapped = sents.select(_wrapped(F.col("words"), config).alias("w"))
    # the tokens beside the same tokens shifted: one row for each position, without lambdas or copies of the sentence
    shifted = [F.slice("w", F.lit(k), F.greatest(F.size("w") - (k - 1), F.lit(0))).alias(f"w{k}") for k in range(1, most + 1)]
    rows = wrapped.select(*shifted).select(F.explode(F.arrays_zip(*[f"w{k}" for k in range(1, most + 1)])).alias("z"))

    def joined(n: int) -> Column:
        parts = [F.col(f"z.w{k}") for k in range(1, n + 1)]
        return parts[0] if n == 1 else F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:])

    def gram(n: int) -> Column:
        before = [joined(n - 1).alias("context")] if contexts else []
        return F.struct(F.lit(n).alias("n"), joined(n).alias("gram"), *before)

    grams = rows.select(F.explode(F.array(*[gram(n) for n in range(least, most + 1)])).alias("g")).where("g.gram IS NOT NULL")
    return grams.select("g.*")


def count_ngrams(sents: DataFrame, config: LanguageModelConfig) -> DataFrame:
    """``(n, gram, cnt)`` of all 1- to order-grams of the wrapped sentences."""
    return gram_rows(sents, config).groupBy("n", "gram").agg(F.count("*").alias("cnt"))


def _bit(n: Column, gram: Column) -> Column:
    return F.xxhash64(n.cast("int"), gram).bitwiseAND(F.lit(SIEVE_BITS - 1))


def sieved(rows: DataFrame, n: str, gram: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose (n, gram) is not among ``wanted`` (n, gram).

    Every wanted row stays.  The sieve is a bitmap of hashes, of the same size
    whatever is wanted, so that unwanted grams are dropped where they are read.
    """
    longs = wanted.select(_bit(F.col("n"), F.col("gram")).alias("b")).groupBy(F.expr("b DIV 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("long"))
    places = rows.sparkSession.range(SIEVE_BITS // 64).withColumnRenamed("id", "place")
    dense = places.join(longs, places["place"] == longs["at"], "left").select("place", F.coalesce("long", F.lit(0).cast("long")).alias("long"))
    pages = dense.groupBy(F.expr(f"place DIV {SIEVE_PAGE}").alias("page")).agg(F.sort_array(F.collect_list(F.struct("place", "long")))["long"].alias("longs"))
    sieve = pages.agg(F.sort_array(F.collect_list(F.struct("page", "longs")))["longs"].alias("_sieve"))
    b = _bit(F.col(n), F.col(gram))
    long = F.get(F.get(F.col("_sieve"), F.shiftright(b, (64 * SIEVE_PAGE).bit_length() - 1).cast("int")), F.shiftright(b, 6).bitwiseAND(F.lit(SIEVE_PAGE - 1)).cast("int"))
    return rows.crossJoin(F.broadcast(sieve)).where(F.getbit(long, b.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("_sieve")


def count_paths(paths: DataFrame) -> DataFrame:
    """Weighted paths (words, weight) to ``(path, cnt)``; those that sum to 0 are left out."""
    return paths.groupBy(F.array_join("words", " ").alias("path")).agg(F.sum("weight").alias("cnt")).where("cnt > 0")


def vocabulary(ngrams: DataFrame) -> DataFrame:
    """``(word_id, word, cnt)``: ids from 0 by count down, then word (bytes)."""
    unigrams = ngrams.where("n = 1").groupBy(F.col("gram").alias("word")).agg(F.sum("cnt").alias("cnt"))
    return dense_ids(unigrams, [F.desc("cnt"), F.asc("word")], "word_id").select("word_id", "word", "cnt")


def word_ids(tokens: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """``tokens`` with ``word_id``; unknown words have null."""
    v = vocab.select(F.col("word").alias("_word"), "word_id")
    return tokens.join(v, tokens[word_col] == v["_word"], "left").drop("_word")


def words_of_ids(ids: DataFrame, vocab: DataFrame, id_col: str = "word_id") -> DataFrame:
    """``ids`` with ``word``; unknown ids have UNKNOWN_WORD."""
    v = vocab.select(F.col("word_id").alias("_id"), "word")
    return ids.join(v, ids[id_col] == v["_id"], "left").withColumn("word", F.coalesce("word", F.lit(UNKNOWN_WORD))).drop("_id")


def corpus_total(ngrams: DataFrame) -> DataFrame:
    return ngrams.where("n = 1").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


@dataclass
class LanguageModel:
    config: LanguageModelConfig
    ngrams: DataFrame
    _in_storage: bool = False
    #: what the n-grams are counted from, while they are not in storage
    _sents: DataFrame | None = None
    #: the same as (texts, column), where they can be counted in blocks
    _texts: tuple[DataFrame, str] | None = None

    @classmethod
    def train(cls, texts: DataFrame, text_col: str, config: LanguageModelConfig) -> LanguageModel:
        sents = split_sentences(texts, text_col, config)
        return cls(config, count_ngrams(sents, config), _sents=sents, _texts=(texts, text_col) if gram_blocks.supported(config) else None)

    def save(self, path: str) -> None:
        self.ngrams.write.mode("overwrite").partitionBy("n").parquet(f"{path}/ngrams")
        meta = json.dumps({"format_version": FORMAT_VERSION} | asdict(self.config))
        self.ngrams.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        if meta.pop("format_version") != FORMAT_VERSION:
            raise ValueError(f"{path}: unknown model version")
        config = LanguageModelConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta.items()})
        return cls(config, spark.read.parquet(f"{path}/ngrams"), True)

    def vocabulary(self) -> DataFrame:
        if self._sents is None:
            return vocabulary(self.ngrams)
        return vocabulary(gram_rows(self._sents, self.config, most=1).groupBy("n", "gram").agg(F.count("*").alias("cnt")))

    def _counts(self, wanted: DataFrame) -> DataFrame:
        """``(n, gram, cnt)`` of at least the ``wanted`` (n, gram) that occur.  Where the
        model is not in storage, hardly more than these are counted."""
        if self._sents is None:
            return self.ngrams.select("n", "gram", "cnt")
        return sieved(gram_rows(self._sents, self.config), "n", "gram", wanted).groupBy("n", "gram").agg(F.count("*").alias("cnt"))

    def _grown(self, contexts: DataFrame) -> DataFrame:
        """``(word, _key, _m, cnt)`` of at least the n-grams that are one word longer than the ``contexts`` (n, gram)."""
        last = F.substring_index("gram", " ", -1).alias("word")
        if self._sents is None:
            key = F.expr("substring(gram, 1, char_length(gram) - char_length(substring_index(gram, ' ', -1)) - 1)")
            return self.ngrams.where("n > 1").select(last, key.alias("_key"), (F.col("n") - 1).alias("_m"), "cnt")
        rows = gram_rows(self._sents, self.config, least=2, contexts=True).withColumn("_m", F.col("n") - 1)
        counted = sieved(rows, "_m", "context", contexts).groupBy("_m", "context", "gram").agg(F.count("*").alias("cnt"))
        return counted.select(last, F.col("context").alias("_key"), "_m", "cnt")

    def stored(self) -> LanguageModel:
        """The model with its n-grams counted once and kept in storage, for plans that read them many times."""
        return self if self._in_storage else LanguageModel(self.config, cut(self.ngrams, "ngrams"), True)

    def totals(self) -> DataFrame:
        """``(n, n_grams, total, most)`` by order: distinct n-grams, the sum and the largest of their counts."""
        if self._texts is None:
            return self.ngrams.groupBy("n").agg(F.count("*").alias("n_grams"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))
        return gram_blocks.totals(*self._texts, self.config)

    def _window_scores(self, wins: DataFrame) -> DataFrame:
        """``wins`` (win_id, win array) -> (win_id, score) by prefix back-off from
        the order, or from its length if a window is shorter."""
        order = self.config.order
        longest = F.least(F.size("win"), F.lit(order))
        prefixes = F.transform(F.sequence(F.lit(1), longest), lambda k: F.struct(k.cast("int").alias("k"), F.array_join(F.slice("win", F.lit(1), k), " ").alias("gram")))
        asked = wins.select("win_id", longest.alias("m"), F.explode_outer(F.when(longest > 0, prefixes)).alias("p")).select("win_id", "m", "p.k", "p.gram")
        counts = self.ngrams.select(F.col("gram").alias("_gram"), F.col("n").alias("_n"), "cnt")
        joined = asked.join(counts, (asked.gram == counts["_gram"]) & (asked.k == counts["_n"]), "left")
        wide = joined.groupBy("win_id").agg(F.max("m").alias("m"), *[F.coalesce(F.max(F.when(F.col("k") == k, F.col("cnt"))), F.lit(0)).alias(f"c{k}") for k in range(1, order + 1)])
        wide = wide.crossJoin(F.broadcast(corpus_total(self.ngrams).withColumnRenamed("total", "c0")))  # one row
        discounts = F.array(*[F.lit(BACKOFF**k) for k in range(order)])
        score = F.lit(UNKNOWN_SCORE)
        for i in range(1, order + 1):
            c, above = F.col(f"c{i}").cast("double"), F.col(f"c{i - 1}").cast("double")
            score = F.when((c > 0) & (above > 0), F.log(F.get(discounts, F.col("m") - i) * c / above)).otherwise(score)
        return wide.select("win_id", score.alias("score"))

    def score_ngrams(self, grams: DataFrame) -> DataFrame:
        """Scores of single windows, (id, words) -> (id, score).

        A window shorter than the order is scored by its own prefixes; one
        without words scores UNKNOWN_SCORE.
        """
        if self._texts is not None:
            return gram_blocks.scores(*self._texts, self.config, grams, "id", wrap=False, backoff=BACKOFF, unknown=UNKNOWN_SCORE)
        return self._window_scores(grams.select(F.col("id").alias("win_id"), F.col("words").alias("win"))).withColumnRenamed("win_id", "id")

    def score_sentences(self, sents: DataFrame, id_col: str = "id") -> DataFrame:
        """(id, words) -> (id, score): the sum over the full windows of the wrapped
        sentence; 0.0 if it is shorter than the order.  A distinct window is scored once."""
        if self._texts is not None:
            scored = gram_blocks.scores(*self._texts, self.config, sents, id_col, wrap=True, backoff=BACKOFF, unknown=UNKNOWN_SCORE)
            return scored.groupBy(id_col).agg(F.sum("score").alias("score"))
        wins = sents.select(id_col, F.explode_outer(windows(_wrapped(F.col("words"), self.config), self.config.order)).alias("win"))
        keyed = wins.withColumn("win_id", F.array_join("win", " "))
        scores = self._window_scores(keyed.where("win IS NOT NULL").select("win_id", "win").distinct())
        return keyed.join(scores, "win_id", "left").groupBy(id_col).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))

    def context(self, tokens: list[str], fix_context: bool = False) -> list[str]:
        """``contexts`` of one sequence."""
        n, m = self.config.order, len(tokens)
        if m + 1 < n:
            return [self.config.start, *tokens]
        if m > n or (m == n and fix_context):
            return tokens[m - n + 1 :]
        if m == n:
            return tokens[: n - 1]
        return tokens

    def contexts(self, tokens: Column, fix_context: bool = False) -> Column:
        """The words that stand before a next word, of a column of sequences.

        A sequence exactly as long as the order gives its FIRST words;
        ``fix_context`` gives the last, as longer ones do.
        """
        n, m = self.config.order, F.size(tokens)
        last = F.slice(tokens, F.greatest(m - n + 2, F.lit(1)), F.lit(n - 1))
        at_order = last if fix_context else F.slice(tokens, F.lit(1), F.lit(n - 1))
        return F.when(m + 1 < n, F.concat(F.array(F.lit(self.config.start)), tokens)).when(m > n, last).when(m == n, at_order).otherwise(tokens)

    def next_scores_of(self, contexts: DataFrame) -> DataFrame:
        """``(query_id, word, score)`` of the words seen after the contexts of
        (query_id, context); none if a prefix of a context is unknown."""
        keyed = contexts.where(F.size("context") > 0).select("query_id", F.size("context").alias("m"), F.array_join("context", " ").alias("key"), "context")
        prefixes = F.transform(F.sequence(F.lit(1), F.size("context")), lambda k: F.struct(k.cast("int").alias("k"), F.array_join(F.slice("context", F.lit(1), k), " ").alias("gram")))
        asked = keyed.select("query_id", "m", "key", F.explode(prefixes).alias("p")).select("query_id", "m", "key", "p.k", "p.gram")
        counts = self._counts(asked.select(F.col("k").alias("n"), "gram")).select(F.col("gram").alias("_gram"), F.col("n").alias("_n"), "cnt")
        # the contexts are the small side, whatever the sizes of the files say
        found = asked.hint("shuffle_hash").join(counts, (asked.gram == counts["_gram"]) & (asked.k == counts["_n"]))
        bases = found.groupBy("query_id", "m", "key").agg(F.count("*").alias("known"), F.max(F.when(F.col("k") == F.col("m"), F.col("cnt"))).alias("base")).where("known = m")
        grown = self._grown(keyed.select(F.col("m").alias("n"), F.col("key").alias("gram")))
        follow = bases.hint("shuffle_hash").join(grown, (bases.key == grown["_key"]) & (bases.m == grown["_m"]))
        return follow.select("query_id", "word", F.log(F.col("cnt").cast("double") / F.col("base").cast("double")).alias("score"))

    def next_scores(self, context: list[str]) -> DataFrame:
        """``(word, cnt, score)`` of the words seen after a context; empty if a prefix
        of the context is unknown or there is no context."""
        if not context:
            raise ValueError("a context needs a word")
        m = len(context)
        key = " ".join(context)
        prefixes = [" ".join(context[:i]) for i in range(1, m + 1)]
        base = self.ngrams.where(F.col("gram").isin(prefixes)).agg(F.count_distinct("gram").alias("known"), F.max(F.when(F.col("gram") == key, F.col("cnt"))).alias("base"))
        follow = self.children(context)
        return follow.crossJoin(F.broadcast(base)).where(F.col("known") == m).select("word", "cnt", F.log(F.col("cnt").cast("double") / F.col("base").cast("double")).alias("score"))

    def children(self, context: list[str]) -> DataFrame:
        """``(word, cnt)`` of the n-grams one word longer than a context."""
        key = " ".join([*context, ""])
        return self.ngrams.where((F.col("n") == len(context) + 1) & F.col("gram").startswith(key)).select(F.substring(F.col("gram"), len(key) + 1, 1 << 30).alias("word"), "cnt")

    def next_words(self, context: list[str], k: int) -> DataFrame:
        return top_k(self.next_scores(context), k, [F.desc("score"), F.asc("word")])
