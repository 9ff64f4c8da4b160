"""Spelling variants, near vectors and vector codes against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillway.llm import codes, near_vectors, spelling


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=40))
def test_composition_gives_each_near_pair_once(words):
    got = list(spelling.OneEdit(sorted(words)).pairs())
    want = {(a, b) for a in words for b in words if a < b and is_near(a, b)}
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


@settings(max_examples=50, deadline=None)
@given(st.sets(st.text("ab", max_size=6), min_size=1, max_size=30))
def test_acceptor_is_minimal(words):
    root, states, seen = spelling.acceptor(sorted(words)), [], set()

    def language(node):
        out = set()
        for c, n in node.items():
            out |= {""} if c == "" else {c + w for w in language(n)}
        if id(node) not in seen:
            seen.add(id(node))
            states.append(frozenset(out))
        return out

    assert language(root) == words
    assert len(states) == len(set(states))


def brute_variants(rows, min_letters=7, min_count=2, ratio=10):
    count = Counter()
    for doc, text in rows:
        run = ""
        for ch in (text or "") + "\0":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "\x80" else ch
            elif run:
                h = zlib.crc32(f"{doc}:{run}".encode())
                count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 and doc is not None else run] += 1
                run = ""
    n = {w: k for w, k in count.items() if len(w) >= min_letters and k >= min_count}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


@pytest.mark.parametrize("group", [3, 20_000])
def test_variants(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)  # at 3, prefixes are divided down to whole words
    rng = random.Random(5)
    base = ["abcdefgh", "abcdefgi", "abcdefghi", "Übersetzung", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aabaaaaa", "xbcdefgh", "bcdefgh", "abcdxefgh", "aébcdefg", "quietly×word", "zzzzzzzÿ", "abcdefghijklmnopqrstuvwxyz" * 3, "abcdefghijklmnopqrstuvwxyz" * 3 + "A", "bababab", "abababa", "ababababa", "short"]
    weight = [900, 80, 7, 300, 600, 40, 3, 3, 60, 30, 9, 8, 20, 20, 50, 4, 9, 90, 6, 50]
    words = rng.choices(base, weight, k=6000)
    rows = [(i, " ".join(words[i * 200 : i * 200 + 200])) for i in range(28)] + [(77, None), (78, ""), (None, "abcdefgh abcdefgh"), (3, " ".join(words[5600:])), (79, "a" * 100_000 + " " + "a" * 100_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    got = spelling.group_variants(d)
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == brute_variants(rows)
    assert got.where("root <> word AND form <> root").count() > 0  # chains are followed
    assert spelling.group_variants(d.where("false")).collect() == []


def brute_links(rows, least=0.95):
    def unit(v):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if not ok:
            return None
        v = np.array(v, float) / max(abs(x) for x in v)
        return v / np.sqrt((v * v).sum())

    u = [unit(v) for _, v in rows]
    links = [[j for j in range(len(rows)) if j != i and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        reached, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), c, rows[i][0] == c))
    return sorted(out, key=str)


def vectors(seed, n, width, groups):
    """Spread vectors, and groups of noisy copies whose cosines lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for _ in range(groups):
        at = rng.choice(n, 30, replace=False)
        x[at] = rng.normal(size=width) + rng.normal(size=(30, width)) * rng.choice([0.05, 0.15, 0.25], (30, 1))
    return x


@pytest.mark.parametrize("block", [40, 4096])
@pytest.mark.parametrize("least", [0.95, 0.6])
def test_links(spark, monkeypatch, block, least):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    x = vectors(3, 700, 12, 6).tolist()
    rows = [(i * 3 % 1400 - 5, v) for i, v in enumerate(x)]
    rows += [(9000 + i, x[7]) for i in range(90)] + [(9200, [3e200 * v for v in x[7]]), (9201, [1e-200 * v for v in x[7]]), (4, x[8]), (4, x[9]), (None, x[10]), (None, None)]
    rows += [(9300, [0.0] * 12), (9301, [None] * 12), (9302, [float("nan")] * 12), (9303, [float("inf")] + [0.0] * 11), (9304, []), (9305, [*x[7], 0.0]), (9306, [*x[7], 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS id", "1 AS cell", "'n' AS n").repartition(5)
    got = near_vectors.link_vectors(d, least)
    key = lambda r: (r.vec_id, r.n_links, r.component_id, r.vec_id == r.component_id)
    assert sorted(map(key, got.collect()), key=str) == brute_links(rows, least)
    assert got.where("kept <> (vec_id <=> component_id)").count() == 0


def test_links_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors.link_vectors(d).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors.link_vectors(d.where("false")).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, near_vectors.link_vectors(one).collect())) == [(1, 0, 1, True)]


def test_no_pair_is_lost_at_a_border():
    """Vectors on the planes between cells: every pair within the angle has one side visit the other's cell."""
    rng = np.random.default_rng(1)
    for least in (0.95, 0.5):
        c = rng.normal(size=(9, 4))
        cells = near_vectors.Cells(c / np.linalg.norm(c, axis=1)[:, None], least)
        x = rng.normal(size=(1500, 4))
        x /= np.linalg.norm(x, axis=1)[:, None]
        home, angle = cells.home(x)
        for k in range(9):
            cells.widest[k] = angle[home == k].max(initial=-10)
        met = set(zip(*(v.tolist() for v in cells.visits(x, home))))
        for i, j in zip(*np.nonzero(x @ x.T >= least)):
            a, b = (i, j) if home[i] > home[j] else (j, i)
            assert home[a] == home[b] or (int(a), int(home[b])) in met


def brute_codes(rows, parts=8, entries=16, rounds=6):
    import math

    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        given = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, given) if g[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    final = assign()
    error = [sum(d for d, _ in g) for g in final]
    by = Counter()
    for (_, _, label), e in zip(kept, error):
        by[label] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, label, "".join(f"{k:02x}" for _, k in g), e, by[label], sha) for (i, _, label), g, e in zip(kept, final, error)), key=str)


@pytest.mark.parametrize("scale", [1.0, 0.0005, 60_000.0])
def test_codes(spark, scale):
    """Small scales make ties and unused entries, large ones leave 64-bit squares."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 16)) * scale).tolist()
    rows = [(i * 7 % 300 - 20, v, i % 4 if i % 5 else None) for i, v in enumerate(x)]
    rows += [(-50, None, 1), (-51, [None] * 16, 1), (-52, [float("nan")] * 16, 1), (-53, [float("-inf")] * 16, 1), (None, x[0], 2), (5, x[1], 2), (-60, x[3], 3), (-61, x[3], 3), (-62, [-v for v in x[3]], 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "2 AS error").repartition(4)
    got = codes.compress(d).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 2), min_size=1, max_size=16), st.lists(st.tuples(*[st.integers(-4, 4)] * 2), min_size=1, max_size=30))
def test_orchard_takes_the_lowest_of_the_nearest(entries, points):
    e, x = np.array(entries), np.array(points)
    index, distance = codes.Orchard(e).nearest(x)
    all_ = ((x[:, None] - e[None]) ** 2).sum(2)
    assert index.tolist() == all_.argmin(1).tolist() and distance.tolist() == all_.min(1).tolist()


def test_codes_of_few_or_odd_vectors(spark):
    d = spark.createDataFrame([(2, [1.0] * 8, None), (1, [0.5] * 8, None)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in codes.compress(d).collect()) == [(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0)]
    assert codes.compress(d.where("false")).collect() == []
    assert codes.compress(d.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), "label")).collect() == []
    for odd in ([1.0] * 16, [1.0] * 7):
        with pytest.raises(Exception, match="can't"):
            codes.compress(d.unionByName(spark.createDataFrame([(0, odd, 1)], d.schema))).collect()
