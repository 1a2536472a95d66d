"""Command line: ``python -m sparkgram.cli <command>``."""

from __future__ import annotations

import argparse

from sparkgram import http_api
from sparkgram.operators.index import SearchIndex
from sparkgram.plans.language_model import LanguageModel
from sparkgram.plans.spell import SpellChecker
from sparkgram.service import Service
from sparkgram.sources import dictionary, ngram_files
from sparkgram.sources.config import read_index_descriptions, read_language_model_config
from sparkgram.sources.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkgram")
    p.add_argument("--cores", type=int, default=8)
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="build the DISC indexes of a config file")
    index.add_argument("config")
    for name in ("search", "complete"):
        s = sub.add_parser(name, help=f"{name} from an index of a config file")
        s.add_argument("config")
        s.add_argument("dict")
        s.add_argument("query")
        s.add_argument("--top-k", type=int, default=5)
        if name == "search":
            s.add_argument("--metric", default="Cosine")
            s.add_argument("--similarity", type=float, default=0.5)
    count = sub.add_parser("ngram-count", help="count n-grams into <k>-gm files")
    count.add_argument("config")
    build = sub.add_parser("build-lm", help="build a model from <k>-gm files")
    build.add_argument("config")
    score = sub.add_parser("score", help="score sentences with a model")
    score.add_argument("config")
    score.add_argument("sentences", nargs="+")
    spell = sub.add_parser("spell", help="predict the last word of a query")
    spell.add_argument("config")
    spell.add_argument("query")
    spell.add_argument("--top-k", type=int, default=5)
    spell.add_argument("--similarity", type=float, default=0.5)
    serve = sub.add_parser("serve", help="serve the indexes of a config file over HTTP")
    serve.add_argument("config")
    serve.add_argument("--lm-config")
    serve.add_argument("--port", type=int, default=8080)
    return p


def _service(spark, config: str) -> Service:
    service = Service(spark)
    for d in read_index_descriptions(config):
        service.add_index(d)
    return service


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session(args.cores)
    if args.command == "index":
        for d in read_index_descriptions(args.config):
            if d.driver == "DISC":
                SearchIndex.build(dictionary.from_lines(spark, d.source), d).save(d.output)
    elif args.command == "search":
        for r in _service(spark, args.config).search(args.dict, args.query, args.metric, args.similarity, args.top_k).collect():
            print(f"{r.score:.6f}\t{r.value}")
    elif args.command == "complete":
        for r in _service(spark, args.config).autocomplete(args.dict, args.query, args.top_k).collect():
            print(r.value)
    elif args.command == "serve":
        service = _service(spark, args.config)
        speller = SpellChecker(_model(spark, args.lm_config)) if args.lm_config else None

        def reindex() -> None:
            for d in read_index_descriptions(args.config):
                service.add_index(d)

        http_api.server(service, speller, reindex, port=args.port).serve_forever()
    else:
        config = read_language_model_config(args.config)
        if args.command == "ngram-count":
            # any separator ends a sentence, so records may end there: a corpus file is many tasks' work
            record_end = "\n" if "\n" in config.separators else config.separators[0]
            text = spark.read.text(config.source, lineSep=record_end).withColumnRenamed("value", "text")
            ngram_files.write(LanguageModel.train(text, "text", config).ngrams, config.output, config.order)
        elif args.command == "build-lm":
            LanguageModel(config, ngram_files.read(spark, config.output, config.order)).save(f"{config.output}/{config.name}.lm")
        elif args.command == "score":
            from pyspark.sql import functions as F

            from sparkgram.functions.analysis import words

            rows = spark.createDataFrame(list(enumerate(args.sentences)), "id long, text string").select("id", words(F.col("text"), config.alphabet).alias("words"))
            scores = {r.id: r.score for r in _model(spark, args.config).score_sentences(rows).collect()}
            for i, text in enumerate(args.sentences):
                print(f"{scores[i]:.6f}\t{text}")
        else:
            for r in SpellChecker(_model(spark, args.config)).predict(args.query, args.top_k, args.similarity).orderBy("pos").collect():
                print(f"{r.score:.6f}\t{r.word}")
    return 0


def _model(spark, path: str) -> LanguageModel:
    config = read_language_model_config(path)
    return LanguageModel.load(spark, f"{config.output}/{config.name}.lm")


if __name__ == "__main__":
    raise SystemExit(main())
