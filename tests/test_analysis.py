import pytest
from pyspark.sql import functions as F

from sparkgram.functions import alphabet, analysis, stopwords
from sparkgram.functions.stemming import english_stem, russian_stem, stem_filter, stem_tokens

ALL = ("english", "russian", "numbers")


@pytest.mark.parametrize(
    ("text", "n", "grams"),
    [
        ("tet", 2, ["te", "et"]),
        ("te", 2, ["te"]),
        ("testing", 3, ["tes", "est", "sti", "tin", "ing"]),
        ("жигули", 2, ["жи", "иг", "гу", "ул", "ли"]),
        ("", 2, []),
        ("lalala", 2, ["la", "al"]),
        ("ж", 2, ["ж"]),
        ("жя", 3, ["жя"]),
        ("ж", 3, []),
    ],
)
def test_ngrams(spark, text, n, grams):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(analysis.ngrams(F.col("t"), n).alias("g")).first().g == grams


def test_n_has_bounds():
    with pytest.raises(ValueError):
        analysis.ngrams(F.lit("x"), 9)


def test_full_pipeline_pads_and_may_repeat(spark):
    rows = analysis.with_grams(spark.createDataFrame([("b - c",)], "t string"), "t", 3, ("english", "$"), "$", "$", "$")
    assert rows.first().grams == ["$b$", "b$$", "$$$", "$$c", "$c$"]


@pytest.mark.parametrize(
    ("text", "words"),
    [("i wanna rock", ["i", "wanna", "rock"]), ("!!! test $-)", ["test"]), ("    ", []), ("hello, привет, 33", ["hello", "привет", "33"])],
)
def test_words(spark, text, words):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(analysis.words(F.col("t"), ALL).alias("w")).first().w == words


def test_sentences(spark):
    from sparkgram.plans.language_model import split_sentences
    from sparkgram.sources.config import LanguageModelConfig

    config = LanguageModelConfig("t", 3, ALL, (".", "?", "!"))
    text = "i wanna rock. hello my friend. what? dab. чтоооо. ты - не я"
    got = split_sentences(spark.createDataFrame([(text,)], "text string"), "text", config).orderBy("pos").collect()
    assert len(got) == 6
    assert got[-1].words == ["ты", "не", "я"]


def test_alphabets(spark):
    rows = spark.createDataFrame([(c,) for c in "аеёяj7-]^"], "c string")
    got = {r.c: (r.ru, r.own) for r in rows.select("c", alphabet.has(F.col("c"), ("russian",)).alias("ru"), alphabet.has(F.col("c"), ("]^-",)).alias("own")).collect()}
    assert [got[c][0] for c in "аеёяj7"] == [True, True, True, True, False, False]
    assert [got[c][1] for c in "-]^a7" if c in got] == [True, True, True, False]
    assert alphabet.size(("russian", "english", "numbers", "$^")) == 32 + 26 + 10 + 2


@pytest.mark.parametrize(
    ("language", "sentence", "stems"),
    [
        ("russian", "вместе с тем о силе электромагнитной энергии имели представление еще", "вмест сил электромагнитн энерг имел представлен"),
        ("russian", "total 2310 рублей итого", "total 2310 рубл ит"),
        ("english", "What does борщ mean", "What борщ mean"),
        ("english", "Hello hello mister Credo What's up", "Hello hello mister Credo What"),
    ],
)
def test_stem_filters(language, sentence, stems):
    assert stem_filter(sentence.split(), language) == stems.split()


def test_stemmers_follow_the_published_samples():
    english = "consign consign consigned consign consolation consol knightly knight knives knive happily happili generously generous hopping hop hoping hope national nation relational relat cries cri ties tie gas gas kiwis kiwi by by cry cri say say news news succeed succeed"
    russian = "важная важн важнейшие важн валился вал павловна павловн пробуждение пробужден противоположность противоположн вагона вагон по по"
    for pairs, stem in ((english, english_stem), (russian, russian_stem)):
        pairs = pairs.split()
        assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    assert (len(stopwords.ENGLISH), len(stopwords.RUSSIAN)) == (174, 159)


def test_stem_tokens_keeps_order_and_repeats(spark):
    rows = spark.createDataFrame([(1, ["running", "the", "dogs", "running"])], "id long, tokens array<string>")
    got = stem_tokens(rows, "id", "tokens", "english").orderBy("pos").collect()
    assert [r.stem for r in got] == ["run", "dog", "run"]


def test_russian_words_are_stemmed(spark, tmp_path):
    import __spark_entry__ as e

    docs = [(1, "Книги, книга и КНИГУ: books 33"), (2, "ёлка x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.stem: r.cnt for r in e.queries()["stem_ru_documents"](spark, str(tmp_path)).collect()}
    assert got["книг"] == 3
    assert {"и", "books", "33", "x"} <= set(got)
    assert sum(got.values()) == 8
