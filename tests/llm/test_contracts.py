"""Cases at the edges of what the operators promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillway.llm import chat, jaccard, language, line_dedup, token_store
from rillway.llm.queries import tokenizer


def test_added_tokens_are_found_before_lower_casing():
    path = tokenizer("word_bpe_49k.json")
    ours = token_store.WordTokenizer(path)
    odd = ["x <|ENDOFTEXT|> y", "<|endoftext|>", "a<|endoftext|>B <|EndOfText|>", "<|STARTOFTEXT|><|startoftext|>", "plain Words, too.", "", "<|endofText|> " * 50]
    rng = random.Random(4)
    odd += ["".join(rng.choices(["<|endoftext|>", "<|ENDOFTEXT|>", " ", "A", "b.", "<|", "|>", "é", "İ"], k=12)) for _ in range(3000)]
    got = ours.encode_batch(odd, 2)
    want = [e.ids + [2] for e in ours.tok.encode_batch(odd, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_words_kept_are_bounded():
    """A task's words don't add up over many documents: beyond the bound those met less often go, and come again with the same ids."""
    import public_tokenizers

    ours = token_store.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    first = ours.encode_batch(["w0x w1x again"], 2)
    most = 0
    for k in range(14):
        ours.encode_batch([" ".join(f"w{i}x" for i in range(40_000 * k, 40_000 * (k + 1)))], 2)
        most = max(most, len(ours.slots))
    assert most <= 450_000
    assert ours.encode_batch(["w0x w1x again"], 2) == first


@pytest.mark.parametrize("values", [[], [0], [7] * 300, list(range(0, 100_000, 7)), sorted(random.Random(1).choices(range(10**9), k=2000)), [0] * 5 + [10**12]])
def test_select_many(values):
    f = token_store.EliasFano.build(np.array(values, np.int64))
    places = np.arange(len(values))
    assert f.select_many(places).tolist() == values == [f.select(i) for i in places.tolist()]
    assert f.select_many(places[::-3]).tolist() == values[::-3]
    with pytest.raises(IndexError):
        f.select_many(np.array([len(values)]))


def test_signs_are_no_letters(spark):
    rows = [(0, "the cat and the dog", "en"), (1, "der Hund und die Katze", "de")] * 30
    model = language.fit(spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(rows)], "doc_id long, text string, lang string"))
    given = ["½ ²", "Ⅳ Ⅷ", "① ②", "12 _ 34", "ª", "漢", "½ the"]
    got = language.predict(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), model)
    assert [r.lang_pred == "und" for r in got.orderBy("doc_id").collect()] == [True, True, True, True, False, False, False]


def test_predictions_from_the_table(spark):
    """Each prediction against a plain computation: the mean row of the table over all subwords, then the softmax."""
    rows = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chien et la souris", "fr")] * 20
    model = language.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string"))
    texts = ["the dog", "la souris und der cat", "x", "die " * 500, "Ünï"]
    for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        buckets = language.subwords(texts[r.doc_id]).tolist()
        z = sum(model["table"][b] for b in buckets) / len(buckets) @ np.ones(1) if model["table"].ndim == 1 else sum(np.asarray(model["table"][b], float) for b in buckets) / len(buckets)
        z = z + model["bias"]
        p = np.exp(z - z.max())
        p /= p.sum()
        assert model["names"][int(p.argmax())] == r.lang_pred and abs(float(p.max()) - r.score) < 1e-3


def test_percent_has_a_lower_bound(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(64)))), (2, " ".join(map(str, range(154))))], "doc_id long, text string")
    for percent in (49, 0, 101):
        with pytest.raises(ValueError):
            jaccard.link_documents(d, 1, percent)
    half = spark.createDataFrame([(1, " ".join(map(str, range(64)))), (2, " ".join(map(str, range(128))))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.link_documents(half, 1, 50).collect()} == {1}


def test_too_many_lines_are_refused(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINE_BITS", 3)
    text = lambda n: "\n".join(f"line {i}" for i in range(n))
    d = spark.createDataFrame([(1, text(8)), (2, text(8))], "doc_id long, text string")
    assert sorted(r.n_removed for r in line_dedup.remove_repeated_lines(d).collect()) == [0, 8]
    with pytest.raises(Exception, match="worded lines"):
        line_dedup.remove_repeated_lines(d.withColumn("text", F.lit(text(9)))).collect()


def test_texts_are_located_after_a_rewrite():
    counted = lambda m: f"{len(m)} turns" + "".join(f"[{r}]{t}" for r, t in m)
    messages = [("user" if k % 2 else "assistant", f"text {k}") for k in range(12)]
    text, _, bodies, rewrites = chat.locate(counted, messages)
    assert rewrites and [text[a:b] for a, b in bodies] == [t for _, t in messages]
