"""Operators that judge each text by itself, held against plain Python."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, SF
from pyspark.sql import functions as F

from rillway.llm import bpe, chat, decontaminate, language, quality, queries, secrets, token_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return df.collect()


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# quality rules


def figures(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), failed


@pytest.mark.parametrize("which", ["odd", "data"])
def test_quality_figures(spark, odd, which):
    given = odd if which == "odd" else docs_of(spark)
    texts = sorted(figures(r.text) for r in given.collect())
    got = sorted(tuple(r[c] for c in (*quality.FIGURES, "base_failed")) for r in quality.line_verdicts(given).collect())
    assert got == texts


def test_quality_lines(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    menu, junk = "Home | About | News | Contact us now.", "ab*** cd%%% ef$$$ gh&&&."
    rows = [(1, f"{good}\n{menu}\n{junk}\nsee our cookie policy.\nno end"), (2, menu + "\n" + good[:40]), (3, good), (4, "\n".join([good] + ["a line without its end " + "x" * 200] * 5))]
    got = {r.doc_id: r for r in quality.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].clean_text == good and got[1].n_failed_lines == 4 and got[1].kept
    assert got[3].clean_text == good and got[3].kept
    assert not got[2].kept and not got[4].kept and got[4].lost > 0.3


def test_quality_stage_keeps_columns(odd, none):
    assert quality.quality_stage(odd).columns == odd.columns
    assert quality.quality_stage(none).count() == 0


# secrets

KINDS = [("assign", re.compile(secrets.ASSIGN, re.ASCII)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]


def base(text):
    out = []
    for rank, (kind, p) in enumerate(KINDS):
        for m in p.finditer(text or ""):
            size = len(m[1]) if kind == "assign" else m.end() - m.start()
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_secret_base(spark, odd):
    more = [(100, "token=secret=abcdefgh12 token: api_key=12345678 passwdpasswd:x=12345678"), (101, " PassWord=abcdefghijk secret: 'abcdefgh'"), (102, "AKIAAKIA AKIA0000AKIA0000000 " + "f" * 31 + " " + "0" * 40)]
    given = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).unionByName(docs_of(spark).select("doc_id", "text"))
    found = secrets.scan(given, None).select(secrets.joined(F.col("secrets")).alias("s"))
    assert sorted(r.s for r in found.collect()) == sorted(base(r.text) for r in given.collect())


def test_secret_models(spark):
    rng = np.random.default_rng(1)
    odd_ones = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 24)) for _ in range(300)]
    plain = ["user_account_settings_table_2", "connection_manager_instance_1", "maximum_number_of_retries_3"]
    rows = [(i, f"token = {s} then {plain[i % 3]} follows the configuration_of_the_service") for i, s in enumerate(odd_ones)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = secrets.fit(docs)
    test = spark.createDataFrame([(1, f"see x9k2q7vz81hd03mw5tpe here and {plain[0]} there"), (2, None), (3, plain[1])], "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.scan(test, ratios).select("doc_id", secrets.joined(F.col("secrets")).alias("s")).collect()}
    assert got == {1: "markov:4:24", 2: "", 3: ""}
    assert secrets.fit(docs.where("false")) is None


def test_secret_models_few_matches(spark):
    """One secret far from any sample of documents, a text that makes up a third of the rows, and random letters."""
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    names = ["configuration_of_the_service", "internationalisation", "maximum_number_of_retries", "connection_manager_instance", "straightforwardness"]
    rows = [(i, f"the {names[i % 5]} of document {i if i % 3 else 0}") for i in range(12000)]
    rows += [(20000, "token = " + letters(2000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = secrets.fit(docs)
    assert ratios is not None
    test = spark.createDataFrame([(1, f"see {letters(40)} here"), (2, f"the {names[0]} and {names[1]}")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.scan(test, ratios).select("doc_id", secrets.joined(F.col("secrets")).alias("s")).collect()}
    assert got == {1: "markov:4:44", 2: ""}
    with pytest.warns(RuntimeWarning, match="no base match"):
        assert secrets.fit(docs.where("doc_id < 20000")) is None


def test_secret_verdicts_against_plain_python(spark, odd):
    """Every markov span, held against candidates and means computed in plain Python from the fitted ratios."""
    rng = np.random.default_rng(6)
    free = ["".join(rng.choice(list(secrets.ALPHABET[: 36 + k % 26]), 16 + k)) for k in range(40)]
    more = [(1000 + k, f"é see {x} or token={x[::-1]} beside the_ordinary_name_of_{k}") for k, x in enumerate(free)]
    given = odd.select("doc_id", "text").unionByName(docs_of(spark).select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = secrets.find_once(given)
    ratios = secrets.fit_found(found)
    assert ratios == secrets.fit(given)
    code = {c: k + 1 for k, c in enumerate(secrets.ALPHABET)}

    def mean(word):
        return sum(float(f"{ratios[code.get(a, 0) * secrets.SIZE + code.get(b, 0)]:.5f}") for a, b in itertools.pairwise(word)) / (len(word) - 1)

    def tried(text):
        taken = [tuple(map(int, x.split(":")[1:])) for x in base(text).split(",") if x]
        return [m for m in re.finditer(secrets.CANDIDATE, text or "") if not any(a < m.end() and m.start() < b for a, b in taken)]

    texts = given.collect()
    half = float(np.median([mean(m[0]) for r in texts for m in tried(r.text)])) + 1e-6  # so small a sample gives low ratios: half of the candidates pass
    got = secrets.judge(found, ratios, half).selectExpr("doc_id", "transform(filter(secrets, s -> s.kind = 'markov'), s -> array(s.start, s.end)) AS s").collect()
    order = lambda x: (str(x[0]), x[1])
    want = sorted(((r.doc_id, [(m.start(), m.end()) for m in tried(r.text) if mean(m[0]) >= half]) for r in texts), key=order)
    assert sorted(((r.doc_id, [tuple(x) for x in r.s]) for r in got), key=order) == want
    assert any(spans for _, spans in want)


# byte-level BPE


def test_bpe_is_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    given = odd.select("doc_id", "text").unionByName(docs_of(spark).select("doc_id", "text"))
    got = bpe.encode_documents(given, path, decode=True).collect()
    want = []
    for r in given.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or 0, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id or 0, bytes(r["ids"]), r.decoded) for r in got) == sorted(want)
    assert bpe.encode_documents(none, path).count() == 0


def test_bpe_memory_is_bounded():
    """However many words come by, few pieces are kept, those met again stay, and texts are taken in small slices."""
    enc, asked = bpe.Encoder(queries.tokenizer("byte_bpe_50k.json")), Counter()
    walk = enc.bpe.encode_words

    def counted(words):
        asked.update(words)
        return walk(words)

    enc.bpe.encode_words = counted
    for k in range(12):
        enc.encode_batch([" ".join(["often", *(f"{i:x}q" for i in range(k * 20_000, (k + 1) * 20_000)), "often"])])
        assert sum(len(v) for v in vars(enc).values() if isinstance(v, dict)) <= bpe.KNOWN + len(enc.marks)
    assert asked[b" often"] == 1
    texts = pa.record_batch([pa.array(["x" * 10_000] * 500)], ["text"])
    assert max(b.column(0).nbytes for b in bpe.in_slices(iter([texts]))) < 1_100_000


def test_bpe_random_words():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.encoder(path)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \n\t\x0b\x1c\xa0 'stlve.,é漢0_<|"), rng.integers(0, 60))) for _ in range(3000)] + ["a" * 700, " " * 300 + "x", "<|endoftext|> x<|endoftext|>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


# token files


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in [(0, 1), (1, 0), (1, 10**12), (1000, 10), (5000, 10**9), (300, 300)]:
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        e, _ = token_store.EliasFano.read(token_store.EliasFano.build(v).to_bytes(), 0)
        assert e.all().tolist() == v.tolist() and [e.select(i) for i in range(n)] == v.tolist()
    big = token_store.EliasFano.build(np.arange(0, 10**7, 100, dtype=np.uint64))
    assert len(big.to_bytes()) < 1.6 * 10**5


def test_token_store(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    more = [(50, "O'Neil's ÀÉ ÅÅ İstanbul ΣΑΣ x\x1cy \x85z é '́ <|startoftext|>,a.b.,! ٣4 ª"), (51, None)]
    given = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).unionByName(docs_of(spark).selectExpr("doc_id + 1000 AS doc_id", "text"))
    got = token_store.store_and_read(given, path, 2).orderBy("start").collect()
    rows = sorted(given.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.store_and_read(none, path, 2).count() == 0
    f = token_store.TokenFile(token_store.pack_file([None, 3, 3], [np.array(x, "<u4").tobytes() for x in ([1, 2], [70000], [])]))
    assert f.doc_ids() == [None, 3, 3] and [f.document(i).tolist() for i in range(3)] == [[1, 2], [70000], []]


# language


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("crc32(cast(doc_id AS string)) % 5 <> 0"))
    held = docs.where("crc32(cast(doc_id AS string)) % 5 = 0 AND n_chars > 30")
    right = language.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang = lang_pred AS int)) AS a").first().a
    assert right > 0.97
    got = language.predict(odd, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    assert language.predict(none, language.fit(none)).count() == 0
    assert {r.lang_pred for r in language.predict(spark.createDataFrame([(1, "zzzq xxqk 漢字")], "doc_id long, text string"), model | {"floor": 1.1}, reject=True).collect()} == {"und"}


def test_language_against_plain_python(spark, odd):
    """Predictions computed letter by letter from the model's table, subwords cut and hashed in plain Python."""
    model = language.fit(docs_of(spark))

    def plain(text):
        if not any(c.isalpha() for c in text or "") or not model["names"]:
            return "und", 0.0
        raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode())
        counts = Counter()
        for word in raw.split():
            padded = b" " + word + b" "
            for n in range(1, language.LONGEST + 1):
                for i in range(len(padded) - n + 1):
                    piece = padded[i : i + n]
                    if b" " in piece[1:-1] or (n == 1 and piece == b" "):
                        continue
                    h = piece[0] + 1 if n == 1 else piece[0]
                    for k, c in enumerate(piece[1:], 2):
                        h = (h * 0x01000193 + c + k) % 2**32
                    counts[(h * 0x9E3779B1 % 2**32) >> 19] += 1
        total = max(1, sum(counts.values()))
        z = [sum(n * float(model["table"][b, k]) for b, n in counts.items()) / total + float(model["bias"][k]) for k in range(len(model["names"]))]
        e = [math.exp(x - max(z)) for x in z]
        best = max(range(len(z)), key=lambda k: (e[k], -k))
        return model["names"][best], e[best] / sum(e)

    given = odd.select("doc_id", "text").unionByName(docs_of(spark).select("doc_id", "text").where("doc_id < 60"))
    got = sorted(((r.doc_id is None, r.doc_id, r.lang_pred, r.score) for r in language.predict(given, model).collect()), key=str)
    want = sorted(((r.doc_id is None, r.doc_id, *plain(r.text)) for r in given.collect()), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-4)


def test_language_learns_rare_languages(spark):
    """More than 200 languages, and a text with very many copies beside them."""
    rows = [(f"l{i:03}", f"{chr(0x4E00 + 2 * i) * 3} {chr(0x4E01 + 2 * i) * 2}") for i in range(210)] + [("l000", "one text again and again")] * 9000
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"), max_rows=400)
    assert sorted(model["names"]) == [f"l{i:03}" for i in range(210)]


# chat


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\\b<|"), (1, 1, "assistant", "a\\b<|"), (1, 2, None, None), (None, 0, "assistant", "<"), (2, None, "us\ner\\n", "x"), (2, 1, "assistant", None), (3, 0, "assistant", "<|im_end|><|im_start|>assistant ok")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(given).collect()}
    assert chat.parse_turns(got[1].formatted) == [("user", "hi <|im_end|>"), ("assistant", "a\\b<|"), ("assistant", "a\\b<|"), ("", "")]
    assert chat.parse_turns(got[2].formatted) == [("us\ner\\n", "x"), ("assistant", "")]
    for r in got.values():
        said = [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert said == [t for role, t in chat.parse_turns(r.formatted) if role == "assistant"]
        assert "".join(r.formatted[s.start : s.end] for s in r.turn_spans) == r.formatted and not r.rewrites_history
    last_only = lambda m: "".join(f"[{t}]" if k == len(m) - 1 else "[..]" for k, (_, t) in enumerate(m))
    assert chat.locate(last_only, [("user", "a"), ("assistant", "b")])[3]
    assert chat.format_conversations(given.where("false")).count() == 0


def test_chat_rows_without_a_conversation(spark):
    given = spark.createDataFrame([(None, k, "assistant", f"t{k}") for k in range(5)] + [(4, k, "user", "x" * 50) for k in range(300)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(given).collect()
    assert sorted(len(chat.parse_turns(r.formatted)) for r in got) == [1] * 5 + [300]


def test_language_ties_and_repeats(spark):
    rows = [(1, "ab cd"), (1, "ab cd"), (2, "ab cd " * 50000)]
    model = {"names": ["aa", "bb"], "table": np.zeros((language.BUCKETS, 2), np.float32), "bias": np.zeros(2, np.float32), "floor": 0.6}
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang", "1 AS score"), model).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in got} == {("aa", 0.5, False)} and len(got) == 3


def test_secrets_of_one_text_with_very_many(spark, none):
    """Positions over many stretches, and candidates beside, inside and far from base spans."""
    parts = [f"é token = Abcdefgh{k:06d} zzzz{'q' * (k % 20)} AKIA{k:016d} {k:040x}" for k in range(700)]
    d = spark.createDataFrame([(1, " ".join(parts)), (2, None), (3, "x" * 200000)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.scan(d, None).select("doc_id", secrets.joined(F.col("secrets")).alias("s")).collect()}
    assert got == {1: base(" ".join(parts)), 2: "", 3: ""}
    every = secrets.scan(d, [1.0] * secrets.SIZE**2).select("doc_id", secrets.joined(F.col("secrets")).alias("s")).collect()
    text = " ".join(parts)
    taken = [(m.start(), m.end()) for _, p in KINDS for m in p.finditer(text) if f":{m.start()}:{m.end()}" in got[1]]
    inside = np.zeros(len(text) + 1, bool)
    for a, b in taken:
        inside[a:b] = True
    want = [f"markov:{m.start()}:{m.end()}" for m in re.finditer(secrets.CANDIDATE, text) if not inside[m.start() : m.end()].any()]
    assert [x for x in {r.doc_id: r.s for r in every}[1].split(",") if x.startswith("markov")] == want and want
    assert secrets.scan(none, None).count() == 0


def test_secret_models_on_held_out_strings(spark):
    """Precision and recall on strings that the models have not seen: random ones of several alphabets against identifiers."""
    rng = np.random.default_rng(8)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", secrets.ALPHABET[:62]]
    stems = "account user setting table manager connection instance retry maximum number service config value index document language model training value system network update record customer order payment region nation supplier part event stream window join filter batch".split()
    name = lambda: "_".join(rng.choice(stems, 3))
    rows = [(k, f"secret: {draw(alphabets[k % 3], 28)} and {name()} then {name()}") for k in range(600)]
    ratios = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    hidden, plain = [draw(alphabets[k % 3], 28) for k in range(300)], [name() for _ in range(300)]
    test = [(k, f"see {x} here") for k, x in enumerate(hidden + plain)]
    got = {r.doc_id for r in secrets.scan(spark.createDataFrame(test, "doc_id long, text string"), ratios).where("exists(secrets, s -> s.kind = 'markov')").collect()}
    found, wrong = len([k for k in got if k < 300]), len([k for k in got if k >= 300])
    assert found / 300 >= 0.95 and found / (found + wrong) >= 0.95


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, SF).collect()}
    conv = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: r.turn):
        conv.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got.keys() == conv.keys()
    for k, turns in conv.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))


# decontamination


def test_leaks(spark, odd, none):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    item = [word() for _ in range(40)]
    changed = list(item)
    for i in range(5, 40, 7):
        changed[i] = word()
    noise = [word() for _ in range(200)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    rows = [(1, " ".join(noise[:50] + item + noise[50:])), (2, " ".join(noise + changed).upper().replace(" ", ", ")), (3, " ".join(noise)), (4, " ".join(item[:12] + noise)), (5, " ".join(item[10:35]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got.keys() == {1, 2, 5}
    assert (got[1].start_word, got[1].n_words, got[1].n_equal) == (50, 40, 40) and got[2].n_equal == 35
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.where("doc_id = 4 OR doc_id IS NULL").count() == 2


def test_leaks_block_by_block(spark, odd, monkeypatch):
    """A benchmark of several blocks finds and drops what one block does; ties, repeated rows and short items included."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    bench = spark.createDataFrame([(k, words(k)) for k in range(12)] + [(20, "two words"), (21, words(3)), (22, None), (23, "?!")], "item_id long, text string")
    rows = [(k, f"start {words(k)} end {words(k)}") for k in range(0, 12, 3)] + [(0, f"start {words(0)} end {words(0)}"), (50, "just two words"), (51, "nothing"), (52, "pad " * 200000 + words(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, r.start_word) for r in decontaminate.find_leaks(docs, bench).collect())
    whole, left = found(), sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect())
    assert (0, 0, 1) in whole and whole.count((0, 0, 1)) == 2 and (3, 21, 1) in whole and (50, 20, 1) in whole and (52, 7, 200000) in whole and left == [51]
    monkeypatch.setattr(decontaminate, "BLOCK", 90)
    assert found() == whole and sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == left


def test_leaks_leave_other_rows_as_they_are(spark, odd, none, monkeypatch):
    """One block or several: null and empty texts, columns of clashing names and the types stay; equal texts go together, rows that only share a doc_id don't."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    bench = spark.createDataFrame([(k, words(k)) for k in range(4)] + [(9, "The")], "item_id long, text string")
    rows = [(1, words(1), "a"), (1, "The rest", "b"), (1, words(1), "c"), (2, None, "d"), (2, "", "e"), (3, "no leak", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("item_id", F.lit(7)).withColumn("odd name.x", F.lit(1))
    left = lambda **k: sorted(r.digest or "" for r in decontaminate.decontaminate(docs, bench, **k).collect())
    for block in (decontaminate.BLOCK, 31):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert left() == ["", "d", "e"] and left(min_item_words=2) == ["", "b", "d", "e"]
        out = decontaminate.decontaminate(docs, bench)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, min_item_words=2).collect()} == {(1, 1)}
        assert decontaminate.decontaminate(odd, bench).columns == odd.columns and decontaminate.decontaminate(none, bench).count() == 0


def test_leaks_against_all_shifts(spark):
    """Every pair with a passing overlap at some shift that holds a run of eight equal words is found."""
    docs = [(r.doc_id, decontaminate.plain_words(r.text or "")) for r in docs_of(spark).collect()]
    items = [(r.item_id, decontaminate.plain_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, SF).collect()}
    for d, w in docs:
        grams = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for i, x in items:
            longest = max((e - s for s in range(len(x)) for e in [next((e for e in range(s, len(x)) if e + 8 > len(x) or tuple(x[e : e + 8]) not in grams), s) + 7]), default=0)
            if longest >= min(20, len(x)):
                assert (d, i) in got


def test_seeds_hit_in_every_passing_overlap():
    """All placements of the substitutions that a stretch may have, by length."""
    for n in range(1, 21):
        mask, least = decontaminate.unbeaten(decontaminate.MASKS, n, 20, 0.75)
        looks = sum(1 << i for i, x in enumerate(mask) if x == "1")
        hits = []
        for places in itertools.combinations(range(n), n // 4):
            equal = (1 << n) - 1 - sum(1 << i for i in places)
            hits.append(sum(equal >> i & looks == looks for i in range(n - len(mask) + 1)))
        assert min(hits) >= least >= 1


def test_leaks_against_all_shifts_with_substitutions():
    """Items of all lengths, with the allowed substitutions and one more, against every shift and every stretch."""

    def passes(item, text):
        need = min(20, len(item))
        for shift in range(-len(item), len(text)):
            a, b = max(0, -shift), min(len(item), len(text) - shift)
            run = np.concatenate([[0], np.cumsum([4 * (item[i] == text[i + shift]) - 3 for i in range(a, b)])])
            if any(run[e] >= run[s] for s in range(len(run)) for e in range(s + need, len(run))):
                return True
        return False

    rng = np.random.default_rng(7)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    items = {n: words(n) for n in [*range(1, 31), 37, 44, 60]}
    block = decontaminate.Block([(n, " ".join(w)) for n, w in items.items()], decontaminate.MASKS)
    texts = []
    for n, item in items.items():
        for more in (0, 0, 0, 1):
            for size in {min(n, 20), min(n, 28), n}:
                start = int(rng.integers(0, n - size + 1))
                part = item[start : start + size]
                for i in rng.permutation(size)[: size // 4 + more]:
                    part[i] = "other"
                texts.append(words(9) + part + words(9))
    part = list(items[30][:20])
    for i in (0, 1, 3, 11, 13):
        part[i] = "other"
    texts.append(part)
    found = 0
    with np.errstate(over="ignore"):
        for text in texts:
            got = {x[0] for x in block.search(" ".join(text), 20, 0.75)}
            assert got == {n for n, item in items.items() if set(item) & set(text) and passes(item, text)}
            found += len(got)
    assert found > 150
