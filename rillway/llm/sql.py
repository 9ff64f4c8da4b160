"""The corpus queries as DuckDB SQL, for tables of test size."""

from rillway.llm.quality import BOILERPLATE, ENDINGS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = "string_split(coalesce(text, ''), chr(10))"
_HAS_WORD = r"regexp_matches(line, '[^\x20\x09-\x0D]')"
_SOLID = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"

PHRASES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS run FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
 r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY run) > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM r),
 x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
 k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) FILTER (gone.pos IS NULL) AS kept, count(gone.pos) AS n FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.pos = gone.pos GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
 z AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS set_id FROM g GROUP BY 1),
 c AS (SELECT min(doc_id) AS c, set_id, any_value(n) AS n FROM z GROUP BY set_id),
 h AS (SELECT c, s FROM g JOIN c ON g.doc_id = c.c),
 p AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM h a JOIN h b ON a.s = b.s AND a.c <> b.c GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN c x ON x.c = a JOIN c y ON y.c = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 t AS (SELECT c AS a, c AS b FROM c UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
 m AS (SELECT a, min(b) AS component_id FROM t GROUP BY 1),
 k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN z ON d.doc_id = z.doc_id LEFT JOIN c ON z.set_id = c.set_id LEFT JOIN m ON m.a = c.c LEFT JOIN k ON k.a = c.c"""

LINE_RUNS = f"""
WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS pos FROM documents),
 w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l WHERE {_HAS_WORD}),
 g AS (SELECT doc_id, i, n, array_to_string((list(line) OVER d)[:n], chr(10)) AS run, list_sum((list(words) OVER d)[:n]) AS words, len((list(line) OVER d)[:n]) = n AS whole FROM w, range(1, 4) t(n) WINDOW d AS (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 s AS (SELECT doc_id, i, n FROM g WHERE whole AND (n = 3 OR words >= 50) QUALIFY row_number() OVER (PARTITION BY n, run ORDER BY doc_id, i) > 1),
 gone AS (SELECT DISTINCT w.doc_id, w.pos FROM w JOIN (SELECT doc_id, unnest(range(i, i + n)) AS i FROM s) x ON x.doc_id = w.doc_id AND x.i = w.i)
SELECT l.doc_id, count(w.pos) AS n_lines, count(gone.pos) AS n_removed, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '')) AS clean_sha256
FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.pos = l.pos LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY 1"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FAILS = f"""{_HAS_WORD} AND (regexp_extract(line, '(.)[\\x20\\x09-\\x0D]*$', 1) NOT IN ({", ".join(map(_quote, ENDINGS))})
 OR length(line) - length(replace(line, '|', '')) >= 3
 OR (regexp_matches(line, '[#*$%&|<>]') AND 10 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]+', '', 'g'))) >= length({_SOLID.format("line")}))
 OR {" OR ".join(f"contains(lower(line), {_quote(p)})" for p in BOILERPLATE)})"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 3], ' ') AS run FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
 r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
 a AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM r) GROUP BY 1),
 l AS (SELECT doc_id, unnest({_LINES}) AS line FROM d),
 f AS (SELECT doc_id, count(*) FILTER ({_HAS_WORD}) - count(DISTINCT line) FILTER ({_HAS_WORD}) AS n_dup_lines, count(*) FILTER ({_FAILS}) AS n_failed_lines,
   coalesce(sum(length({_SOLID.format("line")})) FILTER ({_FAILS}), 0) AS lost FROM l GROUP BY 1),
 x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length({_SOLID.format("text")}) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
   f.n_dup_lines, coalesce(a.n_repeat_words, 0) AS n_repeat_words, n_failed_lines, lost FROM d JOIN f ON f.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND CASE WHEN n_failed_lines = 0 THEN true ELSE CAST(lost AS DOUBLE) / word_chars <= 0.3 END AS kept FROM x"""

SPELLING = r"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 -- CRC-32 by its table of 256, from UTF-8 bytes of letters below U+0800
 z AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS z FROM range(256) r(i)),
 y AS (SELECT DISTINCT doc_id, run, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END)) AS bytes FROM r WHERE length(run) >= 7),
 h AS MATERIALIZED (SELECT doc_id, run, xor(list_reduce(bytes, lambda c, b: xor(z[(xor(c, CAST(b AS BIGINT)) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM y, z),
 x AS (SELECT r.run, h.h FROM r JOIN h ON h.doc_id = r.doc_id AND h.run = r.run),
 l AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM x),
 v AS MATERIALIZED (SELECT word, count(*) AS n FROM l WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
 c AS MATERIALIZED (SELECT word, n, unnest(range(length(word))) AS i FROM v),
 g AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS cut FROM c),
 m AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '?' || substr(word, i + 2) AS mask FROM c),
 p AS (SELECT a.word, b.word AS near, b.n FROM m a JOIN m b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT v.word, g.word, g.n FROM v JOIN g ON v.word = g.cut UNION ALL SELECT g.word, v.word, v.n FROM v JOIN g ON v.word = g.cut),
 b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS best, max(n) AS best_n FROM p GROUP BY 1),
 f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
 t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
 e AS (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON e.word = f.word"""

VECTORS = """
WITH RECURSIVE d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 g AS (SELECT vec_id, e FROM d WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 t AS (SELECT vec_id AS a, vec_id AS b FROM d UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
 c AS (SELECT a, min(b) AS component_id FROM t GROUP BY 1),
 k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT d.vec_id, coalesce(k.n, 0) AS n_links, component_id, d.vec_id = component_id AS kept FROM d JOIN c ON c.a = d.vec_id LEFT JOIN k ON k.a = d.vec_id"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    assigned = lambda book: f"""(SELECT x.vec_id, x.part, min(struct_pack(d := list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.entry)) AS a
     FROM x JOIN {book} b ON b.part = x.part GROUP BY 1, 2)"""  # noqa: E731
    steps = [f"""x AS MATERIALIZED (SELECT vec_id, part, list_transform(embedding[part * len(embedding) // {parts} + 1:(part + 1) * len(embedding) // {parts}], lambda v: CAST(floor(CAST(v AS DOUBLE) * 4096) AS BIGINT)) AS c FROM d, range({parts}) r(part)),
 b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM x QUALIFY entry < {entries})"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED {assigned(f"b{i}")},
 s{i} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM (SELECT x.part, a.e AS entry, i, CAST(floor(sum(c[i]) / count(*)) AS BIGINT) AS v FROM a{i} JOIN x ON x.vec_id = a{i}.vec_id AND x.part = a{i}.part, range(1, len(c) + 1) r(i) GROUP BY ALL) GROUP BY 1, 2),
 b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s ON s.part = b.part AND s.entry = b.entry)""")
    return f"""
WITH d AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
 {", ".join(steps)},
 z AS (SELECT vec_id, string_agg(printf('%02x', a.e), '' ORDER BY part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM {assigned(f"b{rounds}")} GROUP BY 1),
 h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT z.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM z JOIN d ON d.vec_id = z.vec_id, h"""


ORACLES = {"op2_phrase_dedup": PHRASES, "op3_jaccard_join": JACCARD, "op6_line_dedup": LINE_RUNS, "op8_chat_formatting": CHAT, "op9_quality_rules": QUALITY, "op11_spelling_variants": SPELLING, "op12_embedding_near_dedup": VECTORS, "op13_vector_codes": _codes()}
