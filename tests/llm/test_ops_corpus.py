"""Operators that compare texts with each other, held against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from conftest import ODD, SF

import numpy as np
from rillway.llm import jaccard, line_dedup, phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def data(spark, odd):
    """Small real documents with the odd rows."""
    return spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text").unionByName(odd.select("doc_id", "text"))


def order(d):
    return d is not None, d or 0


def cleaned_words(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((order(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 12])
def test_phrases(data, window):
    rows = [(r.doc_id, r.text) for r in data.collect()]
    got = sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in phrases.remove_repeats(data, window).collect())
    want = cleaned_words(rows, window)
    assert got == want
    assert sum(w[2] for w in want) > 1000


def test_phrases_in_many_shards(data, odd, monkeypatch):
    """Shards that share files, and a text longer than a shard."""
    monkeypatch.setattr(phrases, "SHARD_CHARS", 30_000)
    monkeypatch.setattr(phrases, "BUCKETS", 3)
    rows = [(r.doc_id, r.text) for r in data.collect()]
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in phrases.remove_repeats(data).collect()) == cleaned_words(rows, 35)
    clash = odd.selectExpr("*", "1 AS uid", "2 AS shard", "3 AS h")
    assert phrases.remove_repeats(clash).count() == odd.count()


def test_phrases_come_from_the_automaton(spark, monkeypatch):
    """Without its hits nothing is found."""
    d = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(60))) for k in range(2)], "doc_id long, text string")
    assert [r.n_removed for r in phrases.remove_repeats(d).collect()] == [60, 60]
    t = phrases.Words("a b c " * 20)
    empty = phrases.ahocorasick.Automaton()
    empty.add_word("nothing", 1)
    empty.make_automaton()
    assert list(t.stretches(empty, 35)) == []


def test_phrases_edges(spark, none):
    base = [f"w{i}" for i in range(200)]
    texts = [base[:100], base[30:90], base[90:160] + base[20:57], base[:34], base[150:185], ["x"] * 80, base[150:184] + ["é"], base[60:95]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in phrases.remove_repeats(d).collect()) == cleaned_words(rows, 35)
    assert phrases.remove_repeats(none).count() == 0


def cleaned_lines(rows, m, min_words=50):
    docs = sorted(set(rows), key=lambda r: (order(r[0]), r[2]))
    seen, gone = set(), {}
    for d, t, h in docs:
        at = [i for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        lines = (t or "").split("\n")
        mine = set()
        for k in range(len(at)):
            for n in range(1, m + 1):
                key = tuple(lines[i] for i in at[k : k + n])
                if len(key) == n and (n == m or sum(len(WORD.findall(x)) for x in key) >= min_words):
                    if key in seen:
                        mine |= {at[k + j] for j in range(n)}
                    seen.add(key)
        gone[d, t] = len(at), mine
    return sorted((order(d), *(lambda n, g: (n, len(g), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in g)))(*gone[d, t])) for d, t, _ in rows)


MORE_LINES = [(900, "a\nb\nc\nd"), (901, "x\na\n\nb\nc\ny"), (902, "a\nb\nc\nd"), (903, "q\nq\nq\nq\nq\nq"), (904, "b\nc\nd\na\nb"), (905, "long line " * 30 + "\nz"), (906, "y\n" + "long line " * 30), (907, "one\n" + "few words " * 24 + "\ntwo three"), (908, "few words " * 24 + "\ntwo three\nfour")]


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines(spark, data, m):
    d = data.unionByName(spark.createDataFrame(MORE_LINES, "doc_id long, text string"))
    rows = [(r.doc_id, r.text, r.h) for r in d.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()]
    got = sorted((order(r.doc_id), r.n_lines, r.n_removed, r.clean_text) for r in line_dedup.remove_repeated_lines(d, m).collect())
    assert got == cleaned_lines(rows, m)


def test_runs_against_a_suffix_array(spark):
    """Starts and lengths of maximal runs from a plain suffix array with its common prefixes."""
    rng = np.random.default_rng(6)
    docs = [[f"line {x}" for x in rng.integers(0, 9, int(rng.integers(1, 40)))] for _ in range(30)]
    docs += [docs[3] + docs[5][:20], docs[7] * 3, ["same"] * 50]
    text = [(d, i, x) for d, lines in enumerate(docs) for i, x in enumerate([*lines, None])]  # None ends a document and equals nothing

    def same(a, b):
        n = 0
        while text[a + n][2] is not None and text[a + n][2] == text[b + n][2]:
            n += 1
        return n

    array = sorted((p for p in range(len(text)) if text[p][2]), key=lambda p: [x or f"~{d}" for d, _, x in text[p : p + 200]])
    prefix = [0, *(same(a, b) for a, b in zip(array, array[1:]))]
    for m in (2, 3, 4):
        first, at = {}, 0
        while at < len(array):
            end = at + 1
            while end < len(array) and prefix[end] >= m:
                end += 1
            first |= dict.fromkeys(array[at:end], min(array[at:end]))
            at = end
        want = {(text[p][:2], text[f][:2], same(p, f)) for p, f in first.items() if p != f and not (p - 1 in first and first[p - 1] == f - 1 and p - 1 != f - 1 and text[p - 1][2])}
        d = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
        got = [((r.doc_id, r.i), (r.of_doc_id, r.of_i), r.length) for r in line_dedup.repeated_runs(d, m, 10**6).collect()]
        assert len(got) == len(set(got)) and set(got) == want and max(n for *_, n in want) > 30


def test_lines_of_one_long_text(spark):
    d = spark.createDataFrame([(1, "\n".join(["again"] * 20000 + ["", "end"])), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(d).collect()}
    assert (got[1].n_lines, got[1].n_removed, got[1].clean_text, got[2].clean_text) == (20001, 19999, "again\n\nend", "")


def test_lines_stage(spark, odd, none):
    assert line_dedup.line_dedup_stage(odd).columns == odd.columns and line_dedup.line_dedup_stage(none).count() == 0
    d = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nb\nc\nd"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup_stage(d).collect()) == [(1, "a\nb\nc"), (3, "d"), (4, "")]
    clash = odd.selectExpr("*", "1 AS n_removed", "2 AS p", "3 AS _gone", "4 AS text_hash")
    assert line_dedup.line_dedup_stage(clash).columns == clash.columns


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def test_phrases_stay_rows(spark, monkeypatch):
    """What is known for a shard comes to it as rows: lists of several shards would lie on a task's heap at once."""
    rng, sent, old = np.random.default_rng(6), [], phrases._zip
    monkeypatch.setattr(phrases, "SHARD_CHARS", 3000)

    def zip_(table, rows, f, schema):
        sent.append([t for _, t in rows.dtypes])
        return old(table, rows, f, schema)

    monkeypatch.setattr(phrases, "_zip", zip_)
    same = [f"s{i}" for i in range(70)]
    rows = [(k, " ".join([f"x{k}y{i}" for i in range(20)] + same[: int(rng.integers(0, 70))] + [f"z{k}{i}" for i in range(15)])) for k in range(40)] + [(99, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in phrases.remove_repeats(d).collect()) == cleaned_words(rows, 35)
    assert len(sent) == 4 and not any("array" in t for kinds in sent for t in kinds)


def linked(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    kinds = sorted(set(sets) - {frozenset()}, key=len)
    root = {s: s for s in kinds}
    links = Counter()

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for j, b in enumerate(kinds):
        for a in kinds[:j]:
            if len(a) * 100 < percent * len(b):
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for (d, _), s in zip(rows, sets):
        if s:
            least.setdefault(find(s), []).append(order(d))
    big = lambda xs: min((x for x in xs if x[0]), default=(False, 0))
    return sorted((order(d), len(s), big(least[find(s)]) if s else order(d), links[s]) for (d, _), s in zip(rows, sets))


def ours(d, n, percent):
    return sorted((order(r.doc_id), r.n_shingles, order(r.component_id), r.n_links) for r in jaccard.link_documents(d, n, percent).collect())


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard(spark, data, none, n, percent):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(3, 200)))]
        for k in range(12):
            w = list(base)
            for i in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 12))):
                w[i] = f"z{k}{i}"
            rows.append((1000 + g * 20 + k, " ".join(w)))
    d = data.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = linked([(r.doc_id, r.text) for r in d.collect()], n, percent)
    assert ours(d, n, percent) == want
    assert sum(w[3] for w in want) > 50
    assert jaccard.link_documents(none).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """The same with blocks and groups of a few sets, so that clusters and frequent n-grams are cut."""
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 450)
    monkeypatch.setattr(jaccard, "GROUP", 9)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(150):
        w = [f"w{i}" for i in range(60 + k % 20)]
        for i in rng.integers(0, len(w), 3):
            w[i] = f"z{k}{i}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(d, 2, 80) == linked(rows, 2, 80)


def test_jaccard_chain(spark, monkeypatch):
    """Each text links only to its neighbours in one long chain, and texts of other words share rare n-grams with all."""
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 700)
    monkeypatch.setattr(jaccard, "GROUP", 16)
    rows = [(k, " ".join(f"w{i}" for i in range(6 * k, 6 * k + 80))) for k in range(90)]
    rows += [(200 + k, " ".join([f"w{i}" for i in range(6 * k, 6 * k + 5)] + [f"x{k}y{i}" for i in range(75)])) for k in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked(rows, 4, 85)
    assert ours(d, 4, 85) == want and len({c for _, _, (_, c), _ in want}) == 91


def test_jaccard_common_line(spark, monkeypatch):
    """A line that unlike texts share brings few of them together, and no link is lost; in short texts all n-grams may be common."""
    monkeypatch.setattr(jaccard, "GROUP", 16)
    most, old = [], jaccard.Work.cut

    def cut(self, df, name):
        out = old(self, df, name)
        if name == "sizes":
            most.append(out.selectExpr("max(m)").first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard.Work, "cut", cut)
    bound = np.uint64(int(jaccard.SAMPLE * 2**64))
    with np.errstate(over="ignore"):
        line = next(t for i in range(100) if jaccard.ngrams(t := f"under c{i} by", 3)[0] < bound)
    rows = []
    for k in range(150):
        w = [line] + [f"x{k}y{i}" for i in range(40 + k % 30)]
        rows += [(2 * k, " ".join(w)), *([(2 * k + 1, " ".join(w[:-2] + [f"z{k}"]))] if k % 10 == 0 else [])]
    rows += [(1000 + k, " ".join([line, *f"x{k % 3}".split(), "end"])) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(d, 3, 80) == linked(rows, 3, 80)
    assert max(most) <= 2 * jaccard.GROUP
    g, common = np.arange(10, dtype=np.uint64), np.array([0, 1, 5, 6, 7], np.uint64)
    assert [x.tolist() for x in jaccard._without_common(g, common, np.uint64(4), 4)] == [[2, 3], [4, 8]]
    assert [x.tolist() for x in jaccard._without_common(g, common, np.uint64(4), 7)] == [[2, 3], [4, 8, 9, 0, 1]]


def test_trie_passes_over_subtrees():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(1, 30))).astype(np.uint64)) for _ in range(120)] + [np.arange(30, dtype=np.uint64), np.arange(31, dtype=np.uint64)] * 2
    probes = [np.unique(rng.integers(0, 40, int(rng.integers(1, 30))).astype(np.uint64)) for _ in range(60)] + sets[:20]
    for percent in (50, 80, 100):
        trie = jaccard.Trie(sets)
        got = {(trie.order[k], int(p)) for k, found in trie.match(probes, percent) for p in found}
        both = lambda a, b: len(np.intersect1d(a, b))
        assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(probes) if 100 * both(a, b) >= percent * (len(a) + len(b) - both(a, b))}
    far = [np.arange(1000, 1030, dtype=np.uint64)]
    assert not list(jaccard.Trie(sets).match(far, 80))


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 700, 9000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 8 :], rng.integers(0, 2**63, size // 20).astype(np.uint64)]))
        for _, words in jaccard._by_size([jaccard.bitmap(a), jaccard.bitmap(b)]):
            if len(words) == 2:
                assert np.bitwise_count(words[0] ^ words[1]).sum() <= len(np.setxor1d(a, b))


def test_near_duplicate_stage(spark, odd, none):
    out = jaccard.near_duplicate_stage(odd)
    assert out.columns == odd.columns and jaccard.near_duplicate_stage(none).count() == 0
    assert {r.doc_id for r in out.collect()} == {None, -9, 1, 2, 3, 4, 6, 7, 8}
    clash = odd.selectExpr("*", "1 AS _id", "2 AS _key", "3 AS _hash", "4 AS cid")
    assert jaccard.near_duplicate_stage(clash).columns == clash.columns and jaccard.near_duplicate_stage(clash).count() == out.count()
