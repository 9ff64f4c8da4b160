"""Secret scans as Spark SQL expressions: fixed patterns, and Markov models of characters for what they miss."""

from __future__ import annotations

import warnings
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import Work, cut

#: The patterns of the three base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
#: Strings that the models judge, and the characters they know.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
#: Whole runs of those characters that are long enough for a sample of ordinary words. Looking back keeps a short run from being tried at each of its letters.
LONG = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1

CHUNK = 128
SPAN = "struct<start:bigint,end:bigint,kind:string,value:string>"
_OPEN, _SHUT = "", ""  # put around each match; the same characters of a text are set aside first


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _free(text: Column) -> Column:
    """The text with the two marking characters set aside, code point for code point."""
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_SHUT))
    return F.when(marked, F.translate(text, _OPEN + _SHUT, "\x01\x01")).otherwise(text)


def spans(text: str, pattern: str, kind: str, sign: str) -> Column:
    """All leftmost matches of pattern in the string column text, as an array of SPAN in code points.

    text must be free of the marking characters. sign is SQL for a cheap condition that every text with a match meets.
    """
    marked = f"regexp_replace({text}, {_quoted('(' + pattern + ')')}, '{_OPEN}$1{_SHUT}')"
    none = f"cast(array() AS array<{SPAN}>)"
    # appending to an array copies it: matches are taken in stretches of CHUNK, so that a text of very many costs little more for each
    return F.expr(f"""
      CASE WHEN NOT ({sign}) THEN {none} ELSE
      aggregate(array(split({marked}, '{_OPEN}')), {none}, (a0, p) ->
        CASE WHEN size(p) = 1 THEN a0 ELSE
          aggregate(array(transform(sequence(0, (size(p) - 2) div {CHUNK}), c -> slice(p, cast(c * {CHUNK} + 2 AS int), {CHUNK}))), {none}, (a1, chunks) ->
            aggregate(array(aggregate(chunks, named_struct('at', cast(length(p[0]) AS bigint), 'starts', cast(array() AS array<bigint>)),
              (s, q) -> named_struct('at', s.at + aggregate(q, 0L, (n, x) -> n + length(x) - 1), 'starts', concat(s.starts, array(s.at))), s -> s.starts)), {none}, (a2, starts) ->
              flatten(zip_with(chunks, starts, (q, start) ->
                aggregate(q, named_struct('at', start, 'found', {none}),
                  (s, x) -> named_struct(
                    'at', s.at + length(x) - 1,
                    'found', concat(s.found, array(named_struct('start', s.at, 'end', s.at + length(substring_index(x, '{_SHUT}', 1)),
                                                                'kind', '{kind}', 'value', substring_index(x, '{_SHUT}', 1))))),
                  s -> s.found))))) END) END""")


def _covered(found: Column) -> Column:
    """A byte for each code point up to the last span's end, 1 inside spans; found is sorted and without overlaps."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), lambda s: s["end"]))
    piece = lambda s, e: F.concat(F.repeat(F.lit("0"), (s["start"] - e).cast("int")), F.repeat(F.lit("1"), (s["end"] - s["start"]).cast("int")))
    return F.when(F.size(found) == 0, F.lit("")).otherwise(F.array_join(F.zip_with(found, before, piece), "")).cast("binary")


def _outside(found: Column, drawn: Column, none: Column) -> Column:
    """The spans that hold no place inside the drawn ones; the aggregates give drawn and found names, so each is made once."""
    free = lambda s, m: ~F.contains(F.substring(m, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit(b"1"))
    return F.aggregate(F.array(found), none, lambda a, c: F.aggregate(F.array(drawn), a, lambda b, m: F.filter(c, lambda s: free(s, m))))


def base_spans(text: str, runs: str) -> dict[str, Column]:
    """The base kinds; runs is the column of the text's LONG runs. Assignments are matched as a whole, so a value that is too short still uses its characters up."""
    words = " OR ".join(f"contains(lower({text}), '{w}')" for w in ("passw", "secret", "token", "api"))
    assign = F.filter(spans(text, ASSIGN, "assign", words), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8)
    # for these two, a run of characters is always taken whole: asking for the length in the pattern is the same
    access = spans(text, "AKIA[A-Z0-9]{12,}", "access", f"contains({text}, 'AKIA')")
    hexes = spans(text, "[0-9a-f]{32,}", "hex", f"exists({runs}, w -> length(w) >= 32)")
    return {"assign": assign, "access": access, "hex": hexes}


def _codes(word: Column) -> Column:
    """Numbers of a string's characters in the alphabet, 0 for others."""
    return F.transform(F.split(word, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def find(docs: DataFrame) -> DataFrame:
    """All that the models are fitted on and judge, from one look at each whole text: doc_id, base, tried, random, ordinary.

    base holds the spans of the base kinds, tried those of CANDIDATE that overlap no base span; random the values of base
    matches, ordinary the words of 12 and more characters that hold no such value and lie in none. Null text counts as empty.
    """
    d = docs.select("doc_id", _free(F.coalesce("text", F.lit(""))).alias("_t"))
    # the runs and each kind are columns used several times, so that the planner doesn't draw them again for each use
    d = d.select("doc_id", "_t", F.expr(f"regexp_extract_all(_t, {_quoted(LONG)}, 0)").alias("_long"))
    d = d.select("doc_id", "_t", "_long", *[c.alias(f"_{k}") for k, c in base_spans("_t", "_long").items()])
    values = F.concat(
        F.transform("_assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 1)),
        F.transform(F.concat("_access", "_hex"), lambda s: s["value"]),
    )
    d = d.withColumn("random", values)
    tried, none = spans("_t", CANDIDATE, "markov", "exists(_long, w -> length(w) >= 16)"), F.expr(f"cast(array() AS array<{SPAN}>)")
    for kind in PATTERNS:  # each kind's spans are drawn once for a text, then looked at where a candidate lies
        tried = _outside(tried, _covered(F.col(f"_{kind}")), none)
    words = F.filter("_long", lambda w: ~F.exists("random", lambda v: F.contains(v, w) | F.contains(w, v)))
    return d.select("doc_id", F.concat(*[F.col(f"_{k}") for k in PATTERNS]).alias("base"), tried.alias("tried"), "random", words.alias("ordinary"))


def find_once(docs: DataFrame) -> DataFrame:
    """find, written: fitting and judging then read spans and long words, and no text is looked at twice."""
    return cut(find(docs), "secret-finds")


def fit(docs: DataFrame, max_words: int = 20000) -> list[float] | None:
    """fit_found on the documents themselves."""
    return fit_found(find(docs), max_words)


def fit_found(found: DataFrame, max_words: int = 20000) -> list[float] | None:
    """Log-likelihood ratios of character pairs, random strings against ordinary identifiers, from the table of find.

    Labelled samples come from all documents: values of base matches are random strings, words of 12 and more characters
    that hold no base match are ordinary; what is a value anywhere is no ordinary word. Of each class's distinct strings
    about max_words, chosen by their hash, train a first-order Markov model with added counts; a string's weight is the
    number of binary digits of its occurrences, so that copies hardly count. None if either class has no sample, with a
    warning: the models then add nothing.
    """
    strings = found.select(
        F.explode(
            F.concat(
                F.transform("random", lambda w: F.struct(F.lit(True).alias("random"), w.alias("w"))),
                F.transform("ordinary", lambda w: F.struct(F.lit(False).alias("random"), w.alias("w"))),
            )
        ).alias("s")
    )
    work = Work(found.sparkSession)
    strings = work.cut(strings.groupBy("s.w").agg(F.max("s.random").alias("random"), F.count("*").alias("n")), "secret-words")
    sizes = {r.random: r["count"] for r in strings.groupBy("random").count().collect()}
    missing = [name for name, kind in (("base match", True), ("ordinary word", False)) if not sizes.get(kind)]
    if missing:
        work.drop("secret-words")
        warnings.warn(f"no {' and no '.join(missing)} in any document: the character models can't be trained and add no spans", RuntimeWarning, stacklevel=2)
        return None
    share = F.when(F.col("random"), min(1.0, max_words / sizes[True])).otherwise(min(1.0, max_words / sizes[False]))
    chosen = strings.where(F.pmod(F.xxhash64("w"), F.lit(1 << 30)) < share * (1 << 30))
    words = chosen.select("random", F.length(F.bin("n")).alias("weight"), _codes(F.col("w")).alias("c"))
    pairs = words.select("random", "weight", F.explode(F.expr("zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> a * %d + b)" % SIZE)).alias("pair"))
    counts = pairs.groupBy("random", "pair").agg(F.sum("weight").alias("count")).collect()  # at most 2 * SIZE * SIZE rows
    work.drop("secret-words")
    tables = {}
    for kind, add in ((True, 0.5), (False, 0.05)):
        n = [[add] * SIZE for _ in range(SIZE)]
        for r in counts:
            if r.random == kind:
                n[r.pair // SIZE][r.pair % SIZE] += r["count"]
        tables[kind] = [[x / sum(row) for x in row] for row in n]
    return [log(p / q) for a, b in zip(tables[True], tables[False]) for p, q in zip(a, b)]


def scan(docs: DataFrame, ratios: list[float] | None, threshold: float = 0.7) -> DataFrame:
    """judge on the documents themselves."""
    return judge(find(docs), ratios, threshold)


def judge(found: DataFrame, ratios: list[float] | None, threshold: float = 0.7) -> DataFrame:
    """doc_id and the array `secrets` of spans (start, end, kind, value), by start, then kind as listed, from the table of find.

    Kinds: the base kinds, and `markov` for strings of CANDIDATE that overlap no base span and whose mean log-likelihood
    ratio for each pair of characters reaches the threshold. Null text counts as empty. Spans that start together are
    ordered by kind; repeated rows get equal spans; texts are read whole, and the cost of a text with m matches grows as
    m; an empty table gives an empty result; other columns are not looked at.
    """
    extra = F.expr(f"cast(array() AS array<{SPAN}>)")
    if ratios:
        table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
        # a mean over pairs; the table is a constant of SIZE * SIZE numbers
        mean = lambda w: F.aggregate(
            F.array(_codes(w)),
            F.lit(0.0),
            lambda acc, c: acc + F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table, a * SIZE + b)), F.lit(0.0), lambda s, x: s + x) / (F.size(c) - 1),
        )
        extra = F.filter("tried", lambda s: mean(s["value"]) >= threshold)
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.transform(F.concat("base", extra), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return found.select("doc_id", F.sort_array(keyed).alias("secrets"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
