"""Quality rules, line first, as Spark SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators of words as a Java regex class, the counted symbols, closing marks of a line.
SPACE = "[ \\t-\\r]"
SYMBOL = "[#*$%&|<>]"
ENDINGS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]")
#: Phrases of page furniture in the corpus's four languages, lower case.
BOILERPLATE = (
    "cookie policy", "accept cookies", "accept all cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "enable javascript", "lorem ipsum", "click here", "subscribe to our", "skip to content",
    "cookie-richtlinie", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten",
    "javascript aktivieren", "hier klicken", "newsletter abonnieren", "zum inhalt springen",
    "politique de cookies", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation",
    "tous droits réservés", "activer javascript", "cliquez ici", "abonnez-vous à notre", "aller au contenu",
    "política de cookies", "aceptar cookies", "aceptar todas las cookies", "política de privacidad", "términos de uso",
    "todos los derechos reservados", "habilitar javascript", "haga clic aquí", "suscríbete a nuestro", "saltar al contenido",
)


def _without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern + "+", "")


def words(text: Column) -> Column:
    """Array of the runs of characters other than space and \\t-\\r; empty for a text without one."""
    rare = text.rlike("[\t\\x0b\\f\r]")
    flat = F.btrim(F.when(rare, F.regexp_replace(text, SPACE, " ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" "))))
    cut = F.split(flat, " ")
    return F.when(F.contains(flat, F.lit("  ")) | (flat == ""), F.array_remove(cut, "")).otherwise(cut)


#: Up to so many different repeated windows of a text are looked up one by one, more by a second sort.
FEW = 64


def repeated_words(w: str) -> Column:
    """Words of array column w that stand in a three-word window found at least twice in w.

    Windows are strings of three words; sorted, equal ones are neighbours. Most texts have none or few. Where they
    have many, windows are sorted with their place behind them: n log n for each text either way, exact, and nothing
    leaves the row.
    """
    covered = "aggregate(transform({d}, (v, j) -> cast(least(3, coalesce(get({d}, j + 1) - v, 3)) AS bigint)), 0L, (n, v) -> n + v)"
    few = "aggregate(array(array_compact(transform(t, (x, i) -> CASE WHEN array_contains(twice, x) THEN i END))), 0L, (a3, d) -> " + covered.format(d="d") + ")"
    many = f"""
      aggregate(array(sort_array(transform(t, (x, i) -> concat(x, ' ', cast(1000000000 + i AS string))))), 0L, (a3, s) ->
        aggregate(array(transform(s, x -> substring(x, 1, length(x) - 10))), 0L, (a4, p) ->
          aggregate(array(zip_with(p, slice(p, 2, size(p) - 1), (x, y) -> x <=> y)), 0L, (a5, e) ->
            aggregate(array(sort_array(array_compact(transform(s, (x, j) -> CASE WHEN get(e, j) OR get(e, j - 1) THEN cast(right(x, 9) AS int) END)))), 0L, (a6, d) ->
              {covered.format(d="d")}))))"""
    return F.expr(f"""
      CASE WHEN size({w}) < 4 THEN 0L ELSE
        aggregate(array(transform(slice({w}, 3, size({w}) - 2), (c, i) -> concat(get({w}, i), ' ', get({w}, i + 1), ' ', c))), 0L, (a1, t) ->
          aggregate(array(sort_array(t)), 0L, (a2, s) ->
            aggregate(array(array_distinct(array_compact(zip_with(s, slice(s, 2, size(s) - 1), (x, y) -> CASE WHEN x = y THEN x END)))), 0L, (a2b, twice) ->
              CASE WHEN size(twice) = 0 THEN 0L WHEN size(twice) <= {FEW} THEN {few} ELSE {many} END)))
      END""")


def line_verdicts(docs: DataFrame, max_lost: float = 0.3, keep_columns: list[str] | None = None) -> DataFrame:
    """Judge each line, drop the failing ones, then judge the document by what is left.

    A line with a word fails if it is a navigation line (three or more bars), a symbol line (symbols are a tenth
    or more of its characters), boilerplate, or lacks a closing punctuation mark. Lines without a word stay.
    The document is rejected if the failing lines held more than max_lost of its characters (spaces not counted).

    Columns of the result: doc_id, keep_columns, the base figures (see base_figures), clean_text, n_failed_lines,
    lost (share of characters), base_failed, kept. Null text counts as empty: no words, base_failed, clean_text "".
    Repeated rows are judged one by one. No shuffle: the work stays in each input partition.
    """
    keep = keep_columns or []
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_t"))
    d = base_figures(d, "_t")
    low = F.lower("_t")
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.contains(low, F.lit(phrase))
    # the look at the whole text stays outside the lambdas: inside, it would be repeated for each line
    d = d.withColumn("_bad", F.when(furniture, F.filter("_lines", lambda x: _fails(x, furnished=True))).otherwise(F.filter("_lines", lambda x: _fails(x))))
    d = d.withColumn("_good", F.when(F.size("_bad") == 0, F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~_fails(x, furnished=True))))
    lost = F.length(_without(F.array_join("_bad", ""), SPACE)) / F.col("word_chars")
    d = d.select(
        "doc_id",
        *keep,
        *FIGURES,
        F.array_join("_good", "\n").alias("clean_text"),
        F.size("_bad").cast("bigint").alias("n_failed_lines"),
        F.when((F.col("word_chars") == 0) | (F.size("_bad") == 0), F.lit(0.0)).otherwise(lost).alias("lost"),
        "base_failed",
        F.monotonically_increasing_id().alias("_row"),
    )
    # the row number is always positive; a filter on kept that were pushed below it would copy all the expressions
    # above into itself, lambdas included, and evaluate whole texts once for each of their words
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost) & (F.col("_row") >= 0)).drop("_row")


def _fails(line: Column, *, furnished: bool = False) -> Column:
    solid = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    symbols = F.length(line) - F.length(_without(line, SYMBOL))
    furniture = F.lit(False)
    for phrase in BOILERPLATE if furnished else ():
        furniture = furniture | F.contains(F.lower(line), F.lit(phrase))
    return (F.length(solid) > 0) & (
        ~F.right(solid, F.lit(1)).isin(*ENDINGS)
        | (F.contains(line, F.lit("|")) & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 3))
        | (line.rlike(SYMBOL) & (10 * symbols >= F.length(_without(line, SPACE))))
        | furniture
    )


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_figures(d: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the array _lines."""
    t = F.col(text)
    d = d.withColumn("_w", words(t))
    d = d.withColumn("_lines", F.split(t, "\n"))
    worded = F.filter("_lines", lambda x: x.rlike("[^ \\t-\\r]"))
    d = d.withColumn("_worded", worded)
    d = d.select(
        *[c for c in d.columns if c not in ("_w", "_worded")],
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.when(t.rlike(SYMBOL), F.length(t) - F.length(_without(t, SYMBOL))).otherwise(0).cast("bigint").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("bigint").alias("n_dup_lines"),
        repeated_words("_w").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def quality_stage(docs: DataFrame, **how) -> DataFrame:
    """The documents that pass, with their failing lines removed and n_chars counted again.

    Null and empty texts have no words and go; equal rows share their fate; texts are judged whole; an empty table stays
    empty; columns of any name pass through.
    """
    cols = docs.columns
    rest = [c for c in cols if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    out = line_verdicts(packed, keep_columns=["_rest"], **how).where("kept")
    text = {"doc_id": F.col("doc_id"), "text": F.col("clean_text")}
    if "n_chars" in cols:
        text["n_chars"] = F.length("clean_text").cast("bigint")
    return out.select(*[text.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in cols])
