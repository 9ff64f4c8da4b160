"""Repeated line runs from a suffix array over line ids, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import Work

KEY = ["doc_id", "text_hash"]
LINE_BITS = 26  # a place is a document's number and a line's number in so many bits
SIEVE = 1 << 24  # bits
FEW_BITS = 14  # running sums go over up to 2 ** FEW_BITS ranks at a time, then over those sums


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents are known by doc_id and a hash of their text: rows equal in both count as one document."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def _worded(text: Column) -> Column:
    """Places of the \\n-split lines of a text that hold a word (a character other than space and \\t-\\r)."""
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
        lambda s: s["line"].rlike("[^ \\t-\\r]"),
    )


def _document() -> Column:
    return F.shiftright("p", LINE_BITS)


def line_places(work: Work, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents in the order of doc_id (null first) and text hash, numbered (doc_id, text_hash, number), and their worded lines.

    A line has its place p in that order, 128 bits for its text (h1, h2) and its number of words.
    """
    n_words = lambda line: F.length(F.regexp_replace(F.regexp_replace(line, "[^ \\t-\\r]+", "x"), "[ \\t-\\r]", ""))
    lines = F.transform(_worded(F.col("text")), lambda s: F.struct(F.xxhash64(s["line"]).alias("h1"), F.xxhash64(F.lit(1), s["line"]).alias("h2"), n_words(s["line"]).alias("words")))
    given = work.cut(_keyed(docs).select(*KEY, lines.alias("lines")).where("size(lines) > 0").groupBy(*KEY).agg(F.first("lines").alias("lines")), "documents")
    # written in order, so that numbers within a file and files before it give each document's number
    given = work.cut(given.orderBy(*KEY).select(*KEY, "lines", F.monotonically_increasing_id().alias("row")), "sorted")
    work.drop("documents")
    part = F.shiftright("row", 33)
    parts = given.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each file
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    number = F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = work.cut(given.join(F.broadcast(parts), part == F.col("part")).select(*KEY, "lines", number.alias("number")), "numbered")
    work.drop("sorted")
    exploded = numbered.select("number", F.posexplode("lines").alias("i", "line"))
    place = F.when(F.col("i") < 1 << LINE_BITS, F.shiftleft("number", LINE_BITS) + F.col("i")).otherwise(F.raise_error(F.lit(f"a text has more than {1 << LINE_BITS} worded lines")))
    return numbered.select(*KEY, "number"), exploded.select(place.alias("p"), "line.*")


def _intervals(classes: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Adds lo, where each class's interval of the suffix array starts: inside the interval at `lo_before`, behind its smaller siblings.

    chunk cuts the order into stretches, so that an interval with very many classes isn't summed up in one task.
    """
    c = classes.withColumn("chunk", chunk)
    sums = c.groupBy("lo_before", "chunk").agg(F.sum("n").alias("in_chunk"))
    sums = sums.withColumn("before", F.sum("in_chunk").over(Window.partitionBy("lo_before").orderBy("chunk")) - F.col("in_chunk")).drop("in_chunk")
    inside = F.sum("n").over(Window.partitionBy("lo_before", "chunk").orderBy(*order)) - F.col("n")
    return c.withColumn("inside", inside).join(sums, ["lo_before", "chunk"]).withColumn("lo", F.col("lo_before") + F.col("before") + F.col("inside")).drop("before", "inside", "chunk")


def suffix_levels(work: Work, lines: DataFrame) -> list[DataFrame]:
    """Prefix doubling: for k = 0, 1, ... the suffixes (p, lo) that share their first 2^k lines with another one.

    lo is where the interval of the suffixes with those lines starts in the suffix array of all suffixes whose first line
    occurs twice; suffixes are ordered by the hash of their first line, the rank of what follows, and those followed by
    nothing repeated come last. A suffix alone in its interval is settled and leaves. The last level is the one that no
    two suffixes share twice the length of: about log2 of the longest repeated run. Lines of which a third of the corpus
    consists are joined from written sums, so Spark can split them.
    """
    names = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("lo_before", F.lit(0).cast("bigint"))
    names = work.cut(_intervals(names, ["h1", "h2"], F.shiftright("h1", 52)).select("h1", "h2", "lo"), "names")
    levels = [work.cut(lines.join(names, ["h1", "h2"]).select("p", "lo", "words"), "level-0")]
    while not levels[-1].isEmpty():
        step = 1 << len(levels) - 1
        paired = work.cut(_followed(levels[-1], step), "paired")
        classes = paired.groupBy("lo_before", "then").agg(F.count("*").alias("n"))
        classes = _intervals(classes, ["then"], F.shiftright("then", FEW_BITS)).where("n > 1").select("lo_before", "then", "lo")
        levels.append(work.cut(paired.join(work.cut(classes, "names"), ["lo_before", "then"]).select("p", "lo"), f"level-{len(levels)}"))
    work.drop("names", "paired")
    return levels[:-1] or levels


def _followed(level: DataFrame, step: int) -> DataFrame:
    """The suffixes of a level (p, lo_before) with the interval of the suffix step lines on (then), where there is one."""
    ahead = F.first("lo").over(Window.partitionBy(_document()).orderBy("p").rangeBetween(step, step))
    return level.select("p", F.col("lo").alias("lo_before"), ahead.alias("then")).where("then IS NOT NULL")


def _later(work: Work, levels: list[DataFrame], length: int) -> DataFrame:
    """Suffixes (p) that share their first lines, length of them, with earlier ones, and the first of those (of)."""
    k = length.bit_length() - 1
    if k >= len(levels):
        return levels[0].select("p", F.col("p").alias("of")).limit(0)
    # two overlapping stretches of 2^k lines say the same as the interval for this length
    named = _followed(levels[k], length - (1 << k)) if length > 1 << k else levels[k].select("p", F.col("lo").alias("lo_before"), F.col("lo").alias("then"))
    first = named.groupBy("lo_before", "then").agg(F.min("p").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(work.cut(first, f"first-{length}"), ["lo_before", "then"]).where("p > of").select("p", "of")


def _runs(work: Work, levels: list[DataFrame], min_lines: int, min_words: int) -> DataFrame:
    """Maximal repeated runs: where a later copy starts (p), the first copy (of), and how many lines they share (length)."""
    before = Window.partitionBy(_document()).orderBy("p")
    starts = _later(work, levels, min_lines)
    # a copy that goes on from the line before it, in both places, starts there
    starts = starts.withColumn("goes_on", (F.lag("p").over(before) == F.col("p") - 1) & (F.lag("of").over(before) == F.col("of") - 1))
    starts = starts.where("NOT coalesce(goes_on, false)").select("p", "of")
    for length in range(1, min_lines):  # shorter runs need words
        words = F.sum("words").over(before.rangeBetween(0, length - 1))
        wordy = levels[0].select("p", words.alias("w")).where(F.col("w") >= min_words).select("p")
        starts = starts.unionByName(_later(work, levels, length).join(wordy, "p"))
    runs = work.cut(starts.distinct().withColumn("length", F.lit(0).cast("bigint")), "runs")
    for k in reversed(range(len(levels))):
        here = levels[k].select(F.col("p").alias("at"), F.col("lo").alias("a"))
        there = levels[k].select(F.col("p").alias("of_at"), F.col("lo").alias("b"))
        runs = runs.withColumn("at", F.col("p") + F.col("length")).withColumn("of_at", F.col("of") + F.col("length"))
        runs = runs.join(here, "at", "left").join(there, "of_at", "left")
        runs = runs.select("p", "of", (F.col("length") + F.when(F.col("a") == F.col("b"), 1 << k).otherwise(0)).alias("length"))
        if k % 4 == 0:
            runs = work.cut(runs, "runs")
    return runs


def repeated_runs(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """Maximal runs of worded lines that have an earlier copy: doc_id, text_hash, i (place among the worded lines), length, of_doc_id, of_i.

    A run has min_lines lines or more, or min_words words or more in fewer lines. of_doc_id and of_i say where its first
    min_lines lines (all, if fewer) stand first in the order of doc_id (null first), text hash and line; length is how
    many lines the two places share. Copies that go on from the line before in both places are not listed again.
    """
    work = Work(docs.sparkSession)
    names, lines = line_places(work, docs)
    runs = _runs(work, suffix_levels(work, lines), min_lines, min_words)
    place = lambda p, i: [F.shiftright(p, LINE_BITS).alias("number"), F.col(p).bitwiseAND(F.lit((1 << LINE_BITS) - 1)).alias(i)]
    found = runs.select(*place("p", "i"), "length", "of").join(names, "number").drop("number")
    found = found.select(*KEY, "i", "length", *place("of", "of_i")).join(names.select("number", F.col("doc_id").alias("of_doc_id")), "number").drop("number")
    return work.finish(found, "repeated-runs")


def remove_repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """docs with clean_text, n_lines (lines with a word) and n_removed.

    A line goes if it lies in a run of consecutive worded lines that occurs earlier, in the order of doc_id (null first),
    text hash and line, and that has min_lines lines or more, or min_words words or more; copies inside one document
    count. Lines without a word are not part of runs and stay. Null text counts as empty and gives clean_text "". Rows
    equal in doc_id and text are one document and get the same result. Lines are compared by 128-bit hashes. Texts are
    taken whole, up to 2^26 worded lines each (more are refused); an empty table gives an empty result. Other columns pass through, of any name;
    columns named like the three new ones give way.
    """
    marks = repeated_runs(docs, min_lines, min_words)
    # overlapping runs of a document become one
    upto = F.max(F.col("i") + F.col("length")).over(Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("new", (F.col("i") > F.coalesce(upto, F.lit(-1))).cast("int"))
    marks = marks.withColumn("island", F.sum("new").over(Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    marks = marks.groupBy(*KEY, "island").agg(F.min("i").alias("a"), F.max(F.col("i") + F.col("length")).alias("b"))
    gone = F.flatten(F.transform(F.collect_list(F.struct("a", "b")), lambda r: F.sequence(r["a"], r["b"] - 1)))
    marks = marks.groupBy(*KEY).agg(gone.alias("_gone")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_gone")
    d = _keyed(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns]).alias("_row")))
    marks = Work(docs.sparkSession).cut(marks, "marks")
    # a bitmap of fixed size tells most documents without marks: only the others' texts are shuffled for the exact join
    bit = F.pmod(F.xxhash64("_id", "_hash"), F.lit(SIEVE)) + 1
    sieve = marks.groupBy(F.bitmap_bucket_number(bit).alias("_n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))  # SIEVE / 32768 rows of 4 KB at most
    mine = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SIEVE)) + 1
    d = d.withColumn("_n", F.bitmap_bucket_number(mine)).withColumn("_pos", F.bitmap_bit_position(mine)).join(F.broadcast(sieve), "_n", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_pos", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    d = d.withColumn("_byte", byte).withColumn("_maybe", F.coalesce(F.expr("shiftright(_byte, cast(_pos % 8 AS int)) % 2 = 1"), F.lit(False)))
    d = d.select("doc_id", "text", "text_hash", "_row", "_maybe")
    looked = d.where("_maybe").join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    j = looked.select("text", "_row", "_gone").unionByName(d.where("NOT _maybe").select("text", "_row", F.lit(None).cast("array<bigint>").alias("_gone")))
    j = j.withColumn("_lines", F.split("text", "\n")).withColumn("_worded", _worded(F.col("text")))
    at = F.transform("_gone", lambda i: F.get("_worded", i.cast("int"))["at"])
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), at)
    clean = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return j.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("clean_text", "n_lines", "n_removed")],
        F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(clean).alias("clean_text"),
        F.size("_worded").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def line_dedup_stage(docs: DataFrame, **how) -> DataFrame:
    """docs without repeated lines (see remove_repeated_lines); documents that lost every line go, n_chars is counted again.

    Documents without a worded line stay, their text empty where it was null. Columns stay as they are, whatever their names.
    """
    out = remove_repeated_lines(docs, **how).where("n_removed = 0 OR n_removed < n_lines")
    text = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.length("clean_text").cast("bigint")
    return out.select(*[text.get(c, F.col(c)).alias(c) for c in docs.columns])
