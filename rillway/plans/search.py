"""Queries: document search as filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.adapters import table
from rillway.operators import search
from rillway.registry import query

TOK = "regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOK}, 'licensed') OR list_contains({TOK}, 'ningin')")
def doc_match(spark, d):
    return table(spark, d, "documents").where(search.match("text", ["licensed", "ningin"])).select("doc_id")


@query(f"SELECT page_id FROM pages WHERE list_contains({TOK.replace('text', 'html')}, 'table') OR list_contains({TOK.replace('text', 'url')}, 'example') OR list_contains({TOK.replace('text', 'url')}, 'table')")
def page_multi_match(spark, d):
    """Pages with a word in either column."""
    found = search.multi_match(["html", "url"], ["table"]) | search.multi_match(["url"], ["example"])
    return table(spark, d, "pages").where(found).select("page_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the and')")
def doc_phrase(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("the and"))).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3' AND n_chars BETWEEN 500 AND 3000")
def doc_terms(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isin("de", "fr") & (F.col("source") == "src3") & F.col("n_chars").between(500, 3000)).select("doc_id", "lang")


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({TOK}) AS w FROM documents) WHERE length(w) BETWEEN 5 AND 9 AND levenshtein(w, 'thereof') <= 2")
def doc_fuzzy(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(search.tokens("text")).alias("w"))
    return t.where(search.fuzzy("w", "thereof", 2)).select("doc_id").distinct()


@query("SELECT doc_id, CAST(1 + (CASE WHEN source = 'src1' THEN 1 ELSE 0 END) + (CASE WHEN contains(text, 'was') THEN 1 ELSE 0 END) AS INTEGER) AS score FROM documents WHERE lang = 'en' AND NOT n_chars < 300")
def doc_bool(spark, d):
    keep, score = search.boolean([F.col("lang") == "en"], [F.col("n_chars") < 300], [F.col("source") == "src1", F.contains("text", F.lit("was"))])
    return table(spark, d, "documents").where(keep).select("doc_id", score.alias("score"))


@query("SELECT doc_id, sha256(replace(text, 'the', '<em>the</em>')) AS marked FROM documents WHERE contains(text, 'the')")
def doc_highlight(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", F.sha2(search.highlight("text", "the"), 256).alias("marked"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'archived' ELSE source END AS source FROM documents WHERE n_chars >= 100")
def doc_apply(spark, d):
    """Delete by query, then update by query."""
    t = table(spark, d, "documents").where("NOT n_chars < 100")
    return t.select("doc_id", F.when(F.col("lang") == "de", "archived").otherwise(F.col("source")).alias("source"))


@query("SELECT n_chars FROM documents WHERE source = 'src7' AND (lang = 'en' OR n_chars > 2000)")
def doc_lookup(spark, d):
    return table(spark, d, "documents").where("source = 'src7' AND (lang = 'en' OR n_chars > 2000)").select("n_chars")
