import json

import pytest

from sparkgram import cli


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    (root / "cars.txt").write_text("Nissan March\nNissan Juke\nToyota Mark II\n", encoding="utf-8")
    one = {"name": "cars", "nGramSize": 3, "alphabet": ["english", "$"], "source": "cars.txt", "pad": "$", "wrap": ["$", "$"]}
    (root / "index.json").write_text(json.dumps([{**one, "driver": "DISC", "output": "cars-index"}]))
    (root / "text.txt").write_text("I am Sam\nSam I am\nI do not like green eggs and ham\n", encoding="utf-8")
    model = {"name": "sam", "nGramOrder": 3, "alphabet": ["english"], "separators": [".", "\n"], "source": "text.txt", "output": "model", "startSymbol": "<S>", "endSymbol": "</S>"}
    (root / "lm.json").write_text(json.dumps(model))
    return root


def run(capsys, *args):
    assert cli.main([str(a) for a in args]) == 0
    return capsys.readouterr().out.splitlines()


def test_indexes(capsys, files):
    assert run(capsys, "index", files / "index.json") == []
    assert [line.split("\t")[1] for line in run(capsys, "search", files / "index.json", "cars", "nissan juke", "--metric", "Exact")] == ["Nissan Juke"]
    assert run(capsys, "complete", files / "index.json", "cars", "niss", "--top-k", 1) == ["Nissan March"]


def test_language_model(capsys, files):
    run(capsys, "ngram-count", files / "lm.json")
    run(capsys, "build-lm", files / "lm.json")
    got = [line.split("\t") for line in run(capsys, "score", files / "lm.json", "Sam I am", "no one word")]
    assert [(round(float(s), 4), t) for s, t in got] == [(-0.6931, "Sam I am"), (-203.7297, "no one word")]
    assert [line.split("\t")[1] for line in run(capsys, "spell", files / "lm.json", "i am sa")] == ["sam"]
