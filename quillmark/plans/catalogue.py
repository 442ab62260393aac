"""Named queries over the driver's tables, each with the SQL that must give the same rows.

A relational query is written once, over the views of operators.views and the tables, with their names in
braces; Spark gets DataFrames for them and DuckDB common table expressions. Queries that need
functions of one engine are written for each.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from quillmark.functions.text import all_of, let
from quillmark.operators import stats
from quillmark.operators.views import DUCK, build, pieces

QUERIES: dict = {}
ORACLE: dict = {}

NEEDS = {"tokens": ("units",)}


def both(name: str, sql: str) -> None:
    used = list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))

    def run(spark, sf_dir):
        return spark.sql(sql, **{n: build(spark, sf_dir, n) for n in used})

    run.__doc__ = f"Query {name}."
    parts = [n for u in used if u in DUCK for n in (*NEEDS.get(u, ()), u)]
    head = ", ".join(DUCK[n] for n in dict.fromkeys(parts))
    body = re.sub(r"\{(\w+)\}", r"\1", sql)
    if head and body.lstrip().upper().startswith("WITH "):
        body = f"WITH {head}, {body.lstrip()[5:]}"
    elif head:
        body = f"WITH {head} {body}"
    QUERIES[name], ORACLE[name] = run, body


# --- segmentation and statistics (B1, B6, C12, F1 to F8, F16) ---------------------------------

both("unit_explode", "SELECT doc_id, pos, text, n_words FROM {units}")

both("doc_length_stats", """
SELECT doc_id, CAST(count(*) AS BIGINT) AS units, CAST(sum(n_words) AS BIGINT) AS words, max(n_words) AS max_words,
 CAST(sum(n_words) AS DOUBLE) / count(*) AS mean_words,
 CAST(sum(CASE WHEN n_words <= 5 THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS short_share,
 CASE WHEN count(*) < 2 OR sum(n_words) = 0 THEN 0.0 ELSE
  sqrt(CAST(count(*) * sum(n_words * n_words) - sum(n_words) * sum(n_words) AS DOUBLE) / (count(*) * (count(*) - 1)))
  / (CAST(sum(n_words) AS DOUBLE) / count(*)) END AS burstiness
FROM {units} GROUP BY doc_id""")

#: The two readability formulas' constants.
FLESCH = (206.835, 1.015, 84.6)
KINCAID = (0.39, 11.8, 15.59)


def syllable_sql(extract: str) -> str:
    """Vowel groups, less one for a silent final e, at least one."""
    return f"""greatest(1, {extract} - CASE WHEN tok LIKE '%e' AND NOT (tok LIKE '%le' OR tok LIKE '%ie' OR tok LIKE '%ee' OR tok LIKE '%ye') AND {extract} > 1 THEN 1 ELSE 0 END)"""


def readability_sql(groups: str, tokens: str) -> str:
    a, b, c = FLESCH
    d, e, f = KINCAID
    return f"""
SELECT doc_id, units, words, syllables, {a}e0 - {b}e0 * (CAST(words AS DOUBLE) / units) - {c}e0 * (CAST(syllables AS DOUBLE) / words) AS ease,
 {d}e0 * (CAST(words AS DOUBLE) / units) + {e}e0 * (CAST(syllables AS DOUBLE) / words) - {f}e0 AS grade
FROM (SELECT doc_id, CAST(count(DISTINCT pos) AS BIGINT) AS units, CAST(count(*) AS BIGINT) AS words,
 CAST(sum({syllable_sql(groups)}) AS BIGINT) AS syllables FROM {tokens} WHERE lang = 'en' GROUP BY doc_id)"""


def readability(spark, sf_dir):
    """Reading ease and grade of English documents from whole-number sums."""
    return spark.sql(readability_sql("size(regexp_extract_all(tok, '[aeiouy]+', 0))", "{tokens}"), tokens=build(spark, sf_dir, "tokens"))


QUERIES["readability"] = readability
ORACLE["readability"] = f"WITH {DUCK['units']}, {DUCK['tokens']} " + readability_sql("len(regexp_extract_all(tok, '[aeiouy]+'))", "tokens")

#: English personal pronouns that count, demonstratives left out.
PRONOUNS = ("i", "me", "my", "we", "us", "our", "you", "your", "he", "him", "his", "she", "her", "it", "its", "they", "them", "their", "this", "these", "those")
IN_PRONOUNS = ", ".join(f"'{w}'" for w in PRONOUNS)
NOMINAL = " OR ".join(f"tok LIKE '%{x}'" for x in ("tion", "sion", "ment", "ness", "ity", "ance", "ence"))

both("pos_rates", f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS words,
 100.0e0 * sum(CASE WHEN tok IN ({IN_PRONOUNS}) THEN 1 ELSE 0 END) / count(*) AS pronoun_rate,
 100.0e0 * sum(CASE WHEN length(tok) > 5 AND ({NOMINAL}) THEN 1 ELSE 0 END) / count(*) AS nominal_rate
FROM {{tokens}} WHERE lang = 'en' GROUP BY doc_id""")

both("surface_features_long", f"""
WITH f AS (SELECT doc_id, pos, CAST(count(*) AS DOUBLE) AS length, CAST(sum(length(tok)) AS DOUBLE) / count(*) AS word_length,
  CAST(sum(CASE WHEN length(tok) >= 9 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS long_rate,
  CAST(sum(CASE WHEN {NOMINAL} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS nominal_rate,
  CAST(sum(CASE WHEN tok LIKE '%ing' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ing_rate FROM {{tokens}} GROUP BY doc_id, pos)
SELECT doc_id, pos, 'length' AS feature, length AS value FROM f UNION ALL SELECT doc_id, pos, 'word_length', word_length FROM f
UNION ALL SELECT doc_id, pos, 'long_rate', long_rate FROM f UNION ALL SELECT doc_id, pos, 'nominal_rate', nominal_rate FROM f
UNION ALL SELECT doc_id, pos, 'ing_rate', ing_rate FROM f""")

# --- detectors (D) ----------------------------------------------------------------------------

both("long_units", "SELECT doc_id, pos, n_words FROM {units} WHERE n_words > 16")
both("semicolon_units", "SELECT doc_id, pos FROM {units} WHERE contains(text, ';')")
both("dash_units", "SELECT doc_id, pos FROM {units} WHERE contains(text, '—') OR contains(text, ' -- ')")


def per_engine(name: str, spark_sql: str, duck_sql: str) -> None:
    """A query over units whose pattern functions differ."""
    spark_sql = re.sub(r"\{(\d+,\d*)\}", r"{{\1}}", spark_sql)
    QUERIES[name] = lambda spark, sf_dir: spark.sql(spark_sql, units=build(spark, sf_dir, "units"))
    ORACLE[name] = f"WITH {DUCK['units']} {duck_sql}"


TRIAD = "[,] [^,;:.]{1,50}[,] (and|or|und|et|y) "
per_engine("triad_units", f"SELECT doc_id, pos FROM {{units}} WHERE text RLIKE '{TRIAD}'", f"SELECT doc_id, pos FROM units WHERE regexp_matches(text, '{TRIAD}')")
COLON = ":[ ]"
per_engine("colon_units", f"SELECT doc_id, pos FROM {{units}} WHERE text RLIKE '{COLON}'", f"SELECT doc_id, pos FROM units WHERE regexp_matches(text, '{COLON}')")
TAIL = "^[^ ]+ [^ ]+ [^ ]+ [^,]*, [a-z]{3,}ing([^a-z]|$)"
per_engine("tail_units", f"SELECT doc_id, pos FROM {{units}} WHERE text RLIKE '{TAIL}'", f"SELECT doc_id, pos FROM units WHERE regexp_matches(text, '{TAIL}')")

#: A lexicon is a table to be joined; these words are common in the test corpus.
LEXICON = (("possibility", "this"), ("possibility", "that"), ("frequency", "the"), ("limiting", "with"), ("evidential", "from"))
LEXICON_SQL = " UNION ALL ".join(f"SELECT '{c}' AS class, '{w}' AS word" for c, w in LEXICON)

both("lexicon_hits", f"""
SELECT t.doc_id, t.pos, l.class, CAST(count(*) AS BIGINT) AS hits FROM {{tokens}} t JOIN ({LEXICON_SQL}) l ON t.tok = l.word GROUP BY t.doc_id, t.pos, l.class""")

both("opening_runs", """
WITH f AS (SELECT doc_id, pos, tok FROM {tokens} WHERE k = 1),
 g AS (SELECT doc_id, pos, tok, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev_pos FROM f),
 h AS (SELECT doc_id, pos, tok, sum(CASE WHEN prev = tok AND prev_pos = pos - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM g),
 r AS (SELECT doc_id, pos, tok, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS n FROM h)
SELECT doc_id, pos, tok AS word FROM r WHERE n = 3""")

STEMS = "SELECT DISTINCT doc_id, pos, substring(tok, 1, 5) AS stem FROM {tokens} WHERE length(tok) >= 4"

both("restatement_units", f"""
WITH s AS ({STEMS}), u AS (SELECT doc_id, pos, n_words FROM {{units}} WHERE n_words <= 6),
 c AS (SELECT s.doc_id, s.pos, count(*) AS stems, sum(CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.stem = s.stem AND o.pos <> s.pos AND o.pos BETWEEN s.pos - 2 AND s.pos + 2) THEN 1 ELSE 0 END) AS near
  FROM s GROUP BY s.doc_id, s.pos)
SELECT u.doc_id, u.pos FROM u JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos WHERE c.stems >= 2 AND c.stems = c.near""".replace(
    "sum(CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.stem = s.stem AND o.pos <> s.pos AND o.pos BETWEEN s.pos - 2 AND s.pos + 2) THEN 1 ELSE 0 END) AS near\n  FROM s",
    "sum(CASE WHEN p >= s.pos - 2 OR n <= s.pos + 2 THEN 1 ELSE 0 END) AS near\n  FROM (SELECT doc_id, pos, stem, lag(pos) OVER (PARTITION BY doc_id, stem ORDER BY pos) AS p, lead(pos) OVER (PARTITION BY doc_id, stem ORDER BY pos) AS n FROM s) s",
))

both("parallel_frames", """
WITH f AS (SELECT DISTINCT doc_id, pos, tok FROM {tokens} WHERE k <= 3 AND length(tok) > 3)
SELECT a.doc_id, a.pos, CAST(count(*) AS BIGINT) AS shared FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.tok = b.tok AND b.pos = a.pos + 1
 JOIN f c ON a.doc_id = c.doc_id AND a.tok = c.tok AND c.pos = a.pos + 2 GROUP BY a.doc_id, a.pos""")

both("rhythm_flags", """
WITH s AS (SELECT doc_id, count(*) AS n, sum(n_words) AS w, sum(CASE WHEN n_words <= 5 THEN 1 ELSE 0 END) AS short FROM {units} GROUP BY doc_id)
SELECT doc_id, 'staccato' AS kind FROM s WHERE n >= 10 AND (w < 8 * n OR 10 * short > 3 * n)
UNION ALL SELECT doc_id, 'short-sentences' FROM s WHERE n >= 10 AND 100 * short < 15 * n""")

both("add_on_endings", """
WITH e AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, tok, row_number() OVER (PARTITION BY doc_id, pos ORDER BY k DESC) AS r FROM {tokens}) WHERE r = 1 AND tok IN ('the', 'and', 'of', 'too')),
 n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS c FROM e)
SELECT doc_id, pos FROM n WHERE c > 2""")

both("duplicate_units", """
WITH w AS (SELECT DISTINCT doc_id, pos, tok FROM {tokens}), n AS (SELECT doc_id, pos, count(*) AS size FROM w GROUP BY doc_id, pos),
 i AS (SELECT a.doc_id, a.pos AS first_pos, b.pos, count(*) AS shared FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.tok = b.tok AND a.pos < b.pos GROUP BY a.doc_id, a.pos, b.pos)
SELECT i.doc_id, i.pos, min(i.first_pos) AS first_pos FROM i JOIN n x ON i.doc_id = x.doc_id AND i.first_pos = x.pos JOIN n y ON i.doc_id = y.doc_id AND i.pos = y.pos
WHERE (i.shared = x.size AND i.shared = y.size) OR (y.size >= 5 AND 4 * i.shared >= 3 * (x.size + y.size - i.shared)) GROUP BY i.doc_id, i.pos""")

both("findings_by_kind", """
WITH f AS (SELECT 'long-sentence' AS kind, lang, doc_id FROM {units} WHERE n_words > 16 UNION ALL SELECT 'semicolon', lang, doc_id FROM {units} WHERE contains(text, ';')
 UNION ALL SELECT 'short', lang, doc_id FROM {units} WHERE n_words <= 5)
SELECT lang, kind, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM f GROUP BY CUBE (lang, kind)""")

# --- facts and comparison (C, E) --------------------------------------------------------------

both("digit_numbers", "SELECT doc_id, value, CAST(count(*) AS BIGINT) AS times FROM {doc_numbers} GROUP BY doc_id, value")

# digit_numbers, new_numbers and missing_numbers take whole words only, as their SQL has it; the next three take all numbers of C1
both("all_numbers", "SELECT doc_id, value, CAST(count(*) AS BIGINT) AS times FROM {doc_digits} GROUP BY doc_id, value")
both("all_new_numbers", """
WITH t AS (SELECT DISTINCT conv_id, turn, value FROM {turn_digits})
SELECT a.conv_id, a.turn, a.value FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.value = b.value WHERE a.turn > 0 AND b.value IS NULL""")
both("all_missing_numbers", """
WITH t AS (SELECT DISTINCT conv_id, turn, value FROM {turn_digits})
SELECT a.conv_id, a.turn, a.value FROM t a JOIN (SELECT DISTINCT conv_id, turn FROM {conversations}) n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1
LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.value = b.value WHERE b.value IS NULL""")

#: Units that look like acronyms and are no terms.
UNIT_NAMES = (
    "MPa", "GPa", "TPa", "MeV", "GeV", "TeV", "MHz", "GHz", "THz",
    "MW", "GW", "TW", "MWh", "GWh", "TWh", "MJ", "GJ", "TB", "GB", "MB",
)
#: Characters of a term after its first letter, and marks cut off at its end.
TERM = "[A-Za-z][A-Za-z0-9²³¹⁰-₟.]*"
RAISED = "²³¹⁰ⁱ⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"


def terms_sql(found: str, matches: str, units: str) -> str:
    """The different names of a document: two capitals, or one and a digit."""
    bare = f"regexp_replace(regexp_replace(raw, '[.]+$', ''), '[{RAISED}]+$', '')"
    names = ", ".join(f"'{u}'" for u in UNIT_NAMES)
    return f"""
SELECT DISTINCT doc_id, term FROM (SELECT doc_id, {bare} AS term FROM (SELECT doc_id, {found} AS raw FROM {units}))
WHERE ({matches}(term, '[A-Z].*[A-Z]') OR ({matches}(term, '[A-Z]') AND {matches}(term, '[0-9²³¹⁰⁴-⁹₀-₉]'))) AND term NOT IN ({names})"""


per_engine("doc_terms", terms_sql(f"explode(regexp_extract_all(text, '{TERM}', 0))", "regexp_like", "{units}"), terms_sql(f"unnest(regexp_extract_all(text, '{TERM}'))", "regexp_matches", "units"))

both("length_audit", """
SELECT doc_id, CAST(sum(n_words) AS BIGINT) AS words, CAST(count(*) AS BIGINT) AS sentences, CAST(sum(CASE WHEN n_words <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS short,
 CAST(sum(CASE WHEN n_words > 16 THEN 1 ELSE 0 END) AS BIGINT) AS long, max(n_words) AS longest, CAST(sum(n_words) AS DOUBLE) / count(*) AS mean_words,
 CAST(sum(length(text) - length(replace(text, ';', ''))) AS BIGINT) AS semicolons, CAST(sum(length(text) - length(replace(text, ':', ''))) AS BIGINT) AS colons
FROM {units} GROUP BY doc_id""")

both("new_numbers", """
WITH t AS (SELECT DISTINCT conv_id, turn, value FROM {turn_numbers}), m AS (SELECT conv_id, max(turn) AS last FROM {conversations} GROUP BY conv_id)
SELECT a.conv_id, a.turn, a.value FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.value = b.value WHERE a.turn > 0 AND b.value IS NULL""")
both("missing_numbers", """
WITH t AS (SELECT DISTINCT conv_id, turn, value FROM {turn_numbers})
SELECT a.conv_id, a.turn, a.value FROM t a JOIN (SELECT DISTINCT conv_id, turn FROM {conversations}) n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1
LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.value = b.value WHERE b.value IS NULL""")
both("retention", """
WITH w AS (SELECT conv_id, turn, count(*) AS n FROM {turn_words} GROUP BY conv_id, turn)
SELECT a.conv_id, a.turn, CAST(a.n AS BIGINT) AS source_words, CAST(b.n AS BIGINT) AS draft_words, b.n * 100.0e0 / a.n AS retention,
 CASE WHEN b.n * 100 < 95 * a.n THEN 'FAIL' WHEN b.n * 100 > 110 * a.n THEN 'WARN' ELSE 'OK' END AS verdict
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
# retention gives no row where a turn has no words; here every source turn with a next turn has one, 0 for an empty source
both("retention_all", """
WITH n AS (SELECT conv_id, turn, count(*) AS n FROM {turn_words} GROUP BY conv_id, turn),
 t AS (SELECT c.conv_id, c.turn, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT conv_id, turn FROM {conversations}) c LEFT JOIN n ON c.conv_id = n.conv_id AND c.turn = n.turn),
 r AS (SELECT a.conv_id, a.turn, a.n AS source, b.n AS draft FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(source AS BIGINT) AS source_words, CAST(draft AS BIGINT) AS draft_words, CASE WHEN source = 0 THEN 0.0e0 ELSE draft * 100.0e0 / source END AS retention,
 CASE WHEN source = 0 OR draft * 100 < 95 * source THEN 'FAIL' WHEN draft * 100 > 110 * source THEN 'WARN' ELSE 'OK' END AS verdict FROM r""")
both("hedge_pivot", f"""
WITH h AS (SELECT w.conv_id, w.turn, l.class, count(*) AS n FROM {{turn_words}} w JOIN ({LEXICON_SQL}) l ON w.tok = l.word GROUP BY w.conv_id, w.turn, l.class)
SELECT a.conv_id, a.turn, a.class, CAST(a.n AS BIGINT) AS source_hits, CAST(coalesce(b.n, 0) AS BIGINT) AS draft_hits
FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.class = b.class WHERE coalesce(b.n, 0) < a.n""")
both("possible_drop", """
WITH s AS (SELECT DISTINCT conv_id, turn, substring(tok, 1, 5) AS stem FROM {turn_words} WHERE length(tok) >= 4)
SELECT a.conv_id, a.turn, CAST(count(*) AS BIGINT) AS stems, CAST(sum(CASE WHEN b.stem IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gone
FROM s a LEFT JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.stem = b.stem GROUP BY a.conv_id, a.turn
HAVING sum(CASE WHEN b.stem IS NULL THEN 1 ELSE 0 END) >= 3 AND 10 * sum(CASE WHEN b.stem IS NULL THEN 1 ELSE 0 END) >= 3 * count(*)""")
both("multiset_diff", """
WITH c AS (SELECT conv_id, turn, tok, count(*) AS n FROM {turn_words} GROUP BY conv_id, turn, tok)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn - 1) AS turn, coalesce(a.tok, b.tok) AS tok,
 CAST(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS BIGINT) AS missing, CAST(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS BIGINT) AS invented
FROM c a FULL OUTER JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.tok = b.tok WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
both("copied_turns", """
WITH s AS (SELECT DISTINCT conv_id, turn, tok FROM {turn_words}), n AS (SELECT conv_id, turn, count(*) AS size FROM s GROUP BY conv_id, turn),
 i AS (SELECT a.conv_id, a.turn, b.turn AS other, count(*) AS shared FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn)
SELECT i.conv_id, i.turn, max(CAST(i.shared AS DOUBLE) / (x.size + y.size - i.shared)) AS best FROM i JOIN n x ON x.conv_id = i.conv_id AND x.turn = i.turn
 JOIN n y ON y.conv_id = i.conv_id AND y.turn = i.other GROUP BY i.conv_id, i.turn""")
both("zip_gate", """
WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM {conversations} WHERE role = 'user'),
 b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM {conversations} WHERE role <> 'user')
SELECT a.conv_id, CAST(a.n AS BIGINT) AS para, b.text IS NOT NULL AND length(b.text) * 100 BETWEEN 90 * length(a.text) AND 115 * length(a.text) AS passed
FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.n = b.n""")
both("best_candidate", """
WITH r AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS rn FROM {documents} WHERE n_chars > 500)
SELECT lang, source, doc_id, n_chars FROM r WHERE rn = 1""")

# --- runs, labels and rank statistics (G, F10, F13 to F15) -------------------------------------

both("flag_runs", """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM {events}),
 f AS (SELECT user_id, pos, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM e WHERE event_type = 'error'),
 g AS (SELECT user_id, pos, sum(CASE WHEN prev >= pos - 2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, CAST(count(*) AS BIGINT) AS flagged FROM g GROUP BY user_id, run""")
both("transitions", """
WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, lag(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events})
SELECT prev, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(label) AS DOUBLE) / count(*) AS p FROM e WHERE prev IS NOT NULL GROUP BY prev""")
both("flag_share", """
SELECT d.lang, CAST(count(*) AS BIGINT) AS labelled, CAST(sum(l.quality) AS BIGINT) AS good, CAST(sum(CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END) AS DOUBLE) * 100 / sum(d.n_chars) AS share
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang""")
both("auc_by_feature", """
WITH u AS (SELECT doc_id, count(*) AS n, sum(n_words) AS w, max(n_words) AS m FROM {units} GROUP BY doc_id),
 f AS (SELECT 'units' AS feature, l.quality AS y, CAST(u.n AS DOUBLE) AS x FROM u JOIN {labels} l ON u.doc_id = l.doc_id
  UNION ALL SELECT 'words', l.quality, CAST(u.w AS DOUBLE) FROM u JOIN {labels} l ON u.doc_id = l.doc_id
  UNION ALL SELECT 'longest', l.quality, CAST(u.m AS DOUBLE) FROM u JOIN {labels} l ON u.doc_id = l.doc_id),
 t AS (SELECT feature, x, count(*) AS n, sum(y) AS pos FROM f GROUP BY feature, x),
 r AS (SELECT feature, n, pos, sum(n) OVER (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING) - n AS below FROM t)
SELECT feature, CAST(sum(n) AS BIGINT) AS rows, (CAST(sum(pos * (2 * below + n + 1)) AS DOUBLE) / 2 - CAST(sum(pos) * (sum(pos) + 1) AS DOUBLE) / 2) / (CAST(sum(pos) AS DOUBLE) * (sum(n) - sum(pos))) AS auc
FROM r GROUP BY feature""")

# --- matching of flags to units (G1): prefixes first, substrings for what is left -----------------

# prefixes only, of every fifth sentence, as its SQL has it; flag_match_all and unmatched are the whole of G1
both("flag_match", """
WITH u AS (SELECT doc_id, pos, text FROM {units} WHERE length(text) >= 12), k AS (SELECT doc_id, pos AS line_no, substring(text, 1, 24) AS flag FROM u WHERE pos % 5 = 1)
SELECT k.doc_id, k.line_no, u.pos FROM k JOIN u ON k.doc_id = u.doc_id AND (starts_with(u.text, k.flag) OR starts_with(k.flag, u.text))""".replace("starts_with", "startswith"))
ORACLE["flag_match"] = ORACLE["flag_match"].replace("startswith", "starts_with")

#: The fewest characters of a flag; a section number before a heading, with the letter after it.
LEAST_FLAG = 12
ENUMERATOR = "^[ \\t]*(([IVXLC]+|[A-Z])[.]|[0-9]+([.][0-9]+)*[.]?)[ \\t]+([A-Za-z])"


def flag_key(text):
    """A flag or sentence as compared: without a section number, lower-cased, runs of other characters as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, ENUMERATOR, "$4")), "[^a-z0-9]+", " "))


def match_flags(units, flags):
    """G1 of units (doc_id, pos, text) and flags (doc_id, line_no, flag): (matches, flags that match nothing).

    A flag goes to every sentence that one is a prefix of the other with, and if there is none, to every
    sentence that holds it. Both then share their first LEAST_FLAG characters, by which prefixes are joined.
    """
    k = flags.select("doc_id", "line_no", flag_key(F.col("flag")).alias("key")).where(F.length("key") >= LEAST_FLAG)
    s = units.select("doc_id", "pos", flag_key(F.col("text")).alias("s"))
    start = lambda c: F.substring(c, 1, LEAST_FLAG).alias("start")
    prefix = (F.col("k.doc_id") == F.col("s.doc_id")) & (F.col("k.start") == F.col("s.start")) & (F.startswith("s.s", "k.key") | F.startswith("k.key", "s.s"))
    near = k.select("*", start("key")).alias("k").join(s.select("*", start("s")).alias("s"), prefix, "left")
    near = near.select("k.doc_id", "k.line_no", "s.pos", F.when(F.col("s.pos").isNull(), F.col("k.key")).alias("key")).alias("n")
    holds = (F.col("n.doc_id") == F.col("s.doc_id")) & F.col("n.pos").isNull() & F.contains("s.s", "n.key")
    found = near.join(s.alias("s"), holds, "left").select("n.doc_id", "n.line_no", F.coalesce("n.pos", "s.pos").alias("pos"), "n.key")
    return found.where("pos is not null").drop("key"), found.where("pos is null").drop("pos")


#: Three made flags of each sentence: its beginning, its middle, and its beginning after what no sentence has.
FLAGS = ("substring(text, 1, 24)", "substring(text, 13, 24)", "concat('zq', substring(text, 1, 24))")


def made_flags(units):
    rows = units.select("doc_id", "pos", F.posexplode(F.array(*[F.expr(x) for x in FLAGS])).alias("i", "flag"))
    return rows.select("doc_id", F.expr("pos * 3 + i").alias("line_no"), "flag")


def flag_match_all(spark, sf_dir):
    """G1: the sentences of every flag of every sentence, prefixes first and then substrings."""
    units = build(spark, sf_dir, "units")
    return match_flags(units, made_flags(units))[0]


def unmatched(spark, sf_dir):
    """G1: the flags that match no sentence."""
    units = build(spark, sf_dir, "units")
    return match_flags(units, made_flags(units))[1]


def duck_flags(body: str) -> str:
    key = lambda t: f"trim(regexp_replace(lower(regexp_replace({t}, '{ENUMERATOR}', '\\4')), '[^a-z0-9]+', ' ', 'g'))"
    made = " UNION ALL ".join(f"SELECT doc_id, pos * 3 + {i} AS line_no, {x} AS flag FROM units" for i, x in enumerate(FLAGS))
    return f"""WITH {DUCK['units']}, s AS (SELECT doc_id, pos, {key('text')} AS s FROM units),
 k AS (SELECT * FROM (SELECT doc_id, line_no, {key('flag')} AS key FROM ({made})) WHERE length(key) >= {LEAST_FLAG}),
 near AS (SELECT k.doc_id, k.line_no, s.pos FROM k JOIN s ON k.doc_id = s.doc_id AND (starts_with(s.s, k.key) OR (length(s.s) >= {LEAST_FLAG} AND starts_with(k.key, s.s)))),
 rest AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.doc_id = k.doc_id AND n.line_no = k.line_no)),
 held AS (SELECT r.doc_id, r.line_no, s.pos FROM rest r JOIN s ON r.doc_id = s.doc_id AND contains(s.s, r.key))
{body}"""


QUERIES["flag_match_all"], QUERIES["unmatched"] = flag_match_all, unmatched
ORACLE["flag_match_all"] = duck_flags("SELECT * FROM near UNION ALL SELECT * FROM held")
ORACLE["unmatched"] = duck_flags("SELECT doc_id, line_no, key FROM rest WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = rest.doc_id AND h.line_no = rest.line_no)")

# --- text transforms (H) and scrubs (A16) -------------------------------------------------------

#: Ordered rewrite rules as data: pattern, replacement with group n as \n.
RULES = (("([a-z]) the ([a-z])", r"\1 that \2"), (" and ", " as well as "), ("([a-z]), ([a-z])", r"\1; \2"))
SPLITS = ((": ", ". "), ("; ", ". "))


def rewritten(column, rules):
    return reduce(lambda c, r: F.regexp_replace(c, r[0], re.sub(r"\\(\d)", r"$\1", r[1])), rules, column)


def duck_rewritten(column: str, rules) -> str:
    return reduce(lambda c, r: f"regexp_replace({c}, '{r[0]}', '{r[1]}', 'g')", rules, column)


def phrase_rewrite(spark, sf_dir):
    """H1 to H3: an ordered list of rules, then sentence splits at strong marks."""
    docs = build(spark, sf_dir, "documents")
    return docs.select("doc_id", rewritten(rewritten(F.col("text"), RULES), SPLITS).alias("text"))


QUERIES["phrase_rewrite"] = phrase_rewrite
ORACLE["phrase_rewrite"] = f"SELECT doc_id, {duck_rewritten(duck_rewritten('text', RULES), SPLITS)} AS text FROM documents"

VARIANTS = [("baseline", ())] + [(f"only-{i}", (i,)) for i in range(3)] + [(f"without-{i}", tuple(j for j in range(3) if j != i)) for i in range(3)]


def variant_matrix(spark, sf_dir):
    """Every variant of the rule set over every document, lengths against the baseline."""
    docs = build(spark, sf_dir, "documents")
    array = F.array(*[F.struct(F.lit(n).alias("variant"), F.length(rewritten(F.col("text"), [RULES[i] for i in v])).cast("long").alias("chars")) for n, v in VARIANTS])
    rows = docs.select("doc_id", F.length("text").cast("long").alias("base"), F.explode(array).alias("v"))
    return rows.select("doc_id", F.col("v.variant").alias("variant"), F.col("v.chars").alias("chars"), (F.col("v.chars") - F.col("base")).alias("delta"))


QUERIES["variant_matrix"] = variant_matrix
ORACLE["variant_matrix"] = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS variant, length({duck_rewritten('text', [RULES[i] for i in v])}) AS chars, length({duck_rewritten('text', [RULES[i] for i in v])}) - length(text) AS delta FROM documents" for n, v in VARIANTS
)

SCRUB = (("<(script|style)[^>]*>[^<]*</(script|style)>", " "), ("<[^>]+>", " "), ("[ \\n\\t\\r]+", " "))


def html_text(spark, sf_dir):
    """Text of raw pages by an ordered scrub."""
    pages = build(spark, sf_dir, "pages")
    return pages.select("page_id", F.trim(rewritten(F.col("html"), SCRUB)).alias("text"))


QUERIES["html_text"] = html_text
ORACLE["html_text"] = f"SELECT page_id, trim({duck_rewritten('html', SCRUB)}) AS text FROM pages"

# --- plans of Spark's own for four of the queries above; their SQL stays the oracle ------------------


def duplicate_units(spark, sf_dir):
    """The first earlier unit that a unit repeats; sets are made once, sizes compared before members, no exchange."""
    sets = F.transform(pieces(F.col("text")), lambda x, i: F.struct((i + 1).cast("int").alias("pos"), F.array_distinct(all_of(F.lower(x), "[a-z]+")).alias("s")))

    def like(old, new):
        n, m, both = F.size(old["s"]), F.size(new["s"]), F.size(F.array_intersect(old["s"], new["s"]))
        return (F.least(n, m) * 4 >= F.greatest(n, m) * 3) & (((n == m) & (both == n)) | ((m >= 5) & (both * 4 >= (n + m - both) * 3)))

    first = lambda all_, own, i: F.get(F.filter(F.slice(all_, 1, i), lambda w: like(w, own)), F.lit(0))["pos"]
    rows = let(F.filter(sets, lambda u: F.size(u["s"]) > 0), lambda all_: F.transform(all_, lambda own, i: F.struct(own["pos"].alias("pos"), first(all_, own, i).alias("first_pos"))))
    return build(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(rows, lambda r: r["first_pos"].isNotNull())).alias("r")).select("doc_id", "r.pos", "r.first_pos")


def surface_features_long(spark, sf_dir):
    """F16's five rates of each unit: one scan, all features from one array of words."""
    rows = build(spark, sf_dir, "units").select("doc_id", "pos", all_of(F.lower("text"), "[a-z]+").alias("w")).where("size(w) > 0")
    per = lambda n: n.cast("double") / F.size("w")
    count = lambda test: per(F.size(F.filter("w", test)))
    ends = ("tion", "sion", "ment", "ness", "ity", "ance", "ence")
    values = {
        "length": F.size("w").cast("double"), "word_length": per(F.length(F.array_join("w", ""))), "long_rate": count(lambda w: F.length(w) >= 9),
        "nominal_rate": count(lambda w: reduce(lambda a, b: a | b, [w.endswith(e) for e in ends])), "ing_rate": count(lambda w: w.endswith("ing")),
    }
    each = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()])
    return rows.select("doc_id", "pos", F.explode(each).alias("f")).select("doc_id", "pos", "f.feature", "f.value")


def findings_by_kind(spark, sf_dir):
    """counts by language and kind and of all of either, from one scan."""
    kinds = F.array_compact(F.array(F.when(F.col("n_words") > 16, "long-sentence"), F.when(F.contains("text", F.lit(";")), "semicolon"), F.when(F.col("n_words") <= 5, "short")))
    rows = build(spark, sf_dir, "units").select("lang", "doc_id", F.explode(kinds).alias("kind"))
    return rows.cube("lang", "kind").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents"))


def auc_by_feature(spark, sf_dir):
    """area under the curve of three lengths: units and labels are read and joined once."""
    units = build(spark, sf_dir, "units").groupBy("doc_id").agg(F.count("*").alias("units"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest"))
    each = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in ("units", "words", "longest")])
    rows = build(spark, sf_dir, "labels").join(units, "doc_id").select(F.col("quality").alias("label"), F.explode(each).alias("f"))
    return stats.auc(rows.select("label", "f.*"))


for _name in ("duplicate_units", "surface_features_long", "findings_by_kind", "auc_by_feature"):
    QUERIES[_name] = globals()[_name]
