"""Context-aware spelling: completions and fuzzy matches, ranked by what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgram.functions.analysis import words
from sparkgram.functions.metric import Cosine
from sparkgram.operators.index import SearchIndex
from sparkgram.operators.search import containing, fuzzy_top_k
from sparkgram.plans.language_model import UNKNOWN_SCORE, LanguageModel
from sparkgram.sources.config import IndexDescription
from sparkgram.sources.scratch import cut

# fixed values: the vocabulary index
VOCABULARY_INDEX = IndexDescription(name="words", n=3, alphabet=("english", "russian", "numbers", "$^'"), pad="$", wrap=("^", "$"))

#: Characters of the words asked for up to which they go to every task.
BROADCAST_CHARS = 1 << 17


class SpellChecker:
    """Counts, vocabulary and their ranks are stored once; predictions read them.

    Without ``store`` the counts are not: predictions count what follows the
    contexts of their queries, which suits a single table of queries.
    """

    def __init__(self, model: LanguageModel, description: IndexDescription = VOCABULARY_INDEX, store: bool = True):
        self.model = model.stored() if store else model
        self.vocab = cut(self.model.vocabulary(), "vocabulary")
        self.index = SearchIndex.of_distinct(self.vocab.select(F.col("word_id").alias("doc_id"), F.col("word").alias("value")), description)

    def predict(self, query: str, k: int, similarity: float, strict_k: bool = False, fix_context: bool = False) -> DataFrame:
        """``(pos, word, score)`` for one query."""
        asked = self.vocab.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
        return self.predict_all(asked, k, similarity, strict_k, fix_context).select("pos", "word", "score")

    def predict_all(self, queries: DataFrame, k: int, similarity: float, strict_k: bool = False, fix_context: bool = False, uncut: bool = False) -> DataFrame:
        """``(query_id, pos, word, score)`` of up to k + 1 words for the last word of
        each of (query_id, query).  What the plan reads many times, the next-word scores
        and the completions, is stored first.

        Completions come first; if they are fewer than ``k``, fuzzy matches
        follow.  With a known context all are ordered by their next-word score.
        One more than k is returned where there are more; ``strict_k`` cuts it, and
        ``uncut`` returns both lists whole, which are up to 2k - 1 words.
        """
        if k <= 0:
            raise ValueError("k must be positive")
        metric = Cosine(similarity)
        tokens = queries.select("query_id", words(F.col("query"), self.model.config.alphabet).alias("t")).where(F.size("t") > 0)
        before = F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))
        asked = tokens.select("query_id", F.get("t", F.size("t") - 1).alias("query"))
        # the first word of a query has no context, and so no scores
        contexts = tokens.where(F.size("t") > 1).select("query_id", self.model.contexts(before, fix_context).alias("context"))
        scores = cut(self.model.next_scores_of(contexts).withColumnsRenamed({"word": "value", "score": "_score"}), "scores")
        # the index must not be what is broadcast: its files are small, its postings are not
        n_chars = asked.agg(F.coalesce(F.sum(F.length("query")), F.lit(0))).first()[0]
        hint = "broadcast" if n_chars <= BROADCAST_CHARS else "shuffle_hash"

        def scored(rows: DataFrame) -> DataFrame:
            return rows.join(scores.hint("merge"), ["query_id", "value"], "left").withColumn("lm", F.coalesce("_score", F.lit(UNKNOWN_SCORE))).drop("_score")

        best_first = Window.partitionBy("query_id").orderBy(F.desc("lm"), F.asc("doc_id"))
        completions = scored(containing(self.index, asked, hint).hint("shuffle_hash").join(self.index.docs, "value_id").select("query_id", "doc_id", "value"))
        first = cut(completions.withColumn("pos", F.row_number().over(best_first)).where(F.col("pos") <= k), "completions")
        full = first.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("query_id")
        fuzzy = fuzzy_top_k(self.index, asked.join(full, "query_id", "left_anti"), metric, k, hint=hint)
        more = scored(fuzzy.select("query_id", "doc_id", "value", F.col("rank").alias("pos"))).join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        found = first.withColumn("list", F.lit(0)).unionByName(more.withColumn("list", F.lit(1)))
        known = scores.select("query_id").distinct().withColumn("_known", F.lit(True))
        found = found.join(known, "query_id", "left")
        by_score = F.when(F.col("_known"), F.col("lm"))  # null, and so alike, without a context
        order = Window.partitionBy("query_id").orderBy(by_score.desc(), F.asc("list"), F.asc("pos"))
        ranked = found.withColumn("_at", F.row_number().over(order) - 1)
        if not uncut:
            ranked = ranked.where(F.col("_at") < (k if strict_k else k + 1))
        return ranked.select("query_id", F.col("_at").alias("pos"), F.col("value").alias("word"), F.col("lm").alias("score"))
