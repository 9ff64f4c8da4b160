"""The pipeline against a plain version of all its stages."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from test_ops_corpus import cleaned_lines, linked
from test_ops_text import WORD, figures

import corpus_pipeline
from rillway.llm import queries


ENDINGS = tuple(".!?…:;\"'”’»)]")
PHRASES = """cookie policy|accept cookies|accept all cookies|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|lorem ipsum|click here|subscribe to our|skip to content
cookie-richtlinie|cookies akzeptieren|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|javascript aktivieren|hier klicken|newsletter abonnieren|zum inhalt springen
politique de cookies|accepter les cookies|politique de confidentialité|conditions d'utilisation|tous droits réservés|activer javascript|cliquez ici|abonnez-vous à notre|aller au contenu
política de cookies|aceptar cookies|aceptar todas las cookies|política de privacidad|términos de uso|todos los derechos reservados|habilitar javascript|haga clic aquí|suscríbete a nuestro|saltar al contenido""".replace("\n", "|").split("|")


def passes(line):
    s = line.strip(" \t\n\x0b\x0c\r")
    low = line.lower()
    symbols = len(re.findall("[#*$%&|<>]", line))
    bad = s[-1:] not in ENDINGS or line.count("|") >= 3 or (symbols and 10 * symbols >= sum(map(len, WORD.findall(line)))) or any(p in low for p in PHRASES)
    return not s or not bad


def plain_words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def leaks(item, text):
    """Whether some stretch of twenty words (the whole item if shorter), at some shift, has three equal words in four."""
    need = min(20, len(item))
    if not item or sum((Counter(item) & Counter(text)).values()) < 0.75 * need:
        return False
    for shift in range(-len(item), len(text)):
        a, b = max(0, -shift), min(len(item), len(text) - shift)
        run = [0]
        for i in range(a, b):
            run.append(run[-1] + (1 if item[i] == text[i + shift] else -3))
        if b - a >= need and any(run[e] >= min(run[: e - need + 1]) for e in range(need, b - a + 1)):
            return True
    return False


def plain_quality(text):
    *_, failed = figures(text)
    lines = text.split("\n")
    lost = sum(len(w) for x in lines if not passes(x) for w in WORD.findall(x))
    total = sum(map(len, WORD.findall(text)))
    return None if failed or lost > 0.3 * total + 1e-9 else "\n".join(x for x in lines if passes(x))


@pytest.fixture(scope="module")
def result(spark):
    return {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}


def test_pipeline(spark, result):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {d: t for d, x in docs.items() if (t := plain_quality(x or "")) is not None}
    assert 100 < len(docs) < 200
    hashes = {r.doc_id: r.h for r in spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    docs = {d: t for (_, d), n, gone, t in cleaned_lines([(d, t, hashes[d]) for d, t in docs.items()], 3) if not gone or gone < n}
    docs = {d: docs[d] for (_, d), n, (_, c), _ in linked(list(docs.items()), 5, 80) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [plain_words(t or "") for _, t in items]
    docs = {d: t for d, t in docs.items() if not any(leaks(x, w) for w in [plain_words(t)] for x in items)}
    assert result.keys() == docs.keys()
    lib = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    for d, t in docs.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(result[d].ids, "<u4").tolist() == ids and result[d].decodes and result[d].n_chars == len(t)


def test_stages_keep_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for given in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, given, str(tmp_path)).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() == given.count()
