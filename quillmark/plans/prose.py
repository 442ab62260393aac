"""Queries over whole documents beside authored passages, each with SQL of its own for DuckDB.

The corpus is invented prose without hedges, lists or sections, so a passage that has them is put after every
document: as its source, its draft and its fact sheet. The rules then read every whole document and find
something. Spark runs the operators, one map over the rows; the SQL says the same with joins, windows and lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import latex, rewrite
from quillmark.functions import lexicon as L
from quillmark.functions import segment as S
from quillmark.functions import text as T
from quillmark.operators import compare, gate, runs, stats
from quillmark.operators.views import duck_digits

QUERIES: dict = {}
ORACLE: dict = {}

#: Passages (source, draft, facts), dealt to documents by doc_id.
PASSAGES = (
    ("Cell Results\n\nWe tested fifty cells (1) at 3.5 volts. The cells may often lose some charge under load. See ⟦1⟧ and ⟦2⟧ in Fig. 3 now.\n- Label: first item here.\n- second item\n  goes on; it ends.\nE = m c\nThe DOE report is clear.",
     "Cell Results\n\nWe tested 60 cells at 3.5 volts. The cells must clearly lose charge, making them weak. See ⟦2⟧ and ⟦2⟧ and ⟦9⟧ too. Furthermore, it is a testament; it ends.\nE = m c\nThe DOE and NASA reports agree.",
     "# Facts\n<!-- 99 -->\n- The NASA run had 60 cells.\n"),
    ("The large language model (LLM) suggests two hundred and five answers. Some answers are likely wrong. It is not only slow. Dissolved cathode metal quickly poisons electrolyte additives.",
     "The large language model (LLM) gives 205 answers. However, the user, however, sees red, green, and blue. The test is not only fast, but also small. It also ran. It also sat. It also ate. It also fell.",
     ""),
    ("We ran. We sat. We saw it. We won the game. Battery cells lose charge. Cells lose charge. It ended.",
     "We ran too. We sat as well. We saw the same effect. Lithium cells age fast. Lithium cells fail. Old lithium packs swell. Lithium burns. Cells age. It ended — mostly.",
     "- nothing new\n"),
    ("First, we mix 1,200 grams. Second, we heat it to 7.0 degrees. Third, we wait. The big red fox runs home fast.",
     "First, we mix 1200 grams. Third, we wait for CO2 and H2O. There is one thing: speed. The big red fox runs home fast. The big red fox runs home slow.",
     "- CO2 is measured\n"),
    ("Results may indicate that numerous individuals utilize it prior to the test.",
     "This study highlights a pivotal role. We must deploy it; it hinges on aligning parts: they fit. Numerous individuals utilize it in order to demonstrate value. It was quickly measured. Samples are made.",
     ""),
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def pairs(spark, sf_dir):
    """pair_id, source, draft and facts of every document, its passage after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int")
    with_ = lambda i: F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), F.get(F.array(*[F.lit(p[i]) for p in PASSAGES]), at))
    return docs.select(F.col("doc_id").alias("pair_id"), with_(0).alias("source"), with_(1).alias("draft"), F.get(F.array(*[F.lit(p[2]) for p in PASSAGES]), at).alias("facts"))


def _with(i: int) -> str:
    return "coalesce(text, '') || chr(10) || chr(10) || list_extract([" + ", ".join(quoted(p[i]) for p in PASSAGES) + f"], CAST(doc_id % {len(PASSAGES)} AS INTEGER) + 1)"


#: White space of Java's Unicode class, inside a class of RE2, and as one.
_IN = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = f"[{_IN}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def n_words(x: str) -> str:
    return f"len(list_filter(string_split({flat(x)}, ' '), lambda w: w <> ''))"


def among(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def stripped(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '{T.PLACEHOLDER}', '', 'g'), '[ \\t\\x{{a0}}]+([.,;:!?)\\]])', '\\1', 'g')"
    return f"CASE WHEN regexp_matches({x}, '{T.PLACEHOLDER}') THEN regexp_replace({bare}, '[ \\t]{{2,}}', ' ', 'g') ELSE {x} END"


def sentences(name: str, source: str) -> str:
    """CTEs that end in `name` (id, para, idx, pos, text, heading), from `source` (id, text)."""
    formula = lambda x: f"(regexp_matches({x}, '(^|{W})=({W}|$)') AND NOT regexp_matches({x}, '[.?!]$'))"
    marker = lambda x: f"regexp_matches({x}, '^([-*•]|[0-9]{{1,2}}[.)]){W}+')"
    end = "([.?!][\"”’'')\\]]?)"
    return f"""{name}_p AS (SELECT id, unnest(l) AS t, generate_subscripts(l, 1) AS para FROM (SELECT id, list_filter(list_transform(string_split_regex(text, '\\n{W}*\\n'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM {source})),
 {name}_h AS (SELECT id, para, t, {flat('t')} AS f FROM {name}_p),
 {name}_i AS (SELECT *, (NOT contains(t, chr(10)) AND {n_words('t')} <= 30 AND NOT regexp_matches(f, '[.?!:]["”)\\]]?$')) AS heading FROM {name}_h),
 {name}_l AS (SELECT id, para, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM {name}_i WHERE NOT heading),
 {name}_b AS (SELECT id, para, list_filter(string_split(array_to_string(list_transform(l, lambda x, i: (CASE WHEN i = 1 OR {marker('x')} OR {formula('x')} OR {formula('l[i - 1]')} THEN chr(1) || (CASE WHEN {formula('x')} THEN 'F' ELSE 'P' END) ELSE ' ' END) || x), ''), chr(1)), lambda b: b <> '') AS bs FROM {name}_l),
 {name}_k AS (SELECT id, para, generate_subscripts(bs, 1) AS b, unnest(bs) AS raw FROM {name}_b),
 {name}_s AS (SELECT id, para, b, starts_with(raw, 'F') AS heading, CASE WHEN starts_with(raw, 'F') THEN [{flat('substr(raw, 2)')}] ELSE string_split(regexp_replace({flat('substr(raw, 2)')}, '{end}{W}+', '\\1' || chr(1), 'g'), chr(1)) END AS ps FROM {name}_k),
 {name}_g AS (SELECT id, para, b, heading, string_split(array_to_string(list_transform(ps, lambda x, i: (CASE WHEN i = 1 THEN '' WHEN list_contains({among(L.ABBREVIATIONS)}, ltrim(regexp_extract(ps[i - 1], '(\\S+)$', 1), '([')) OR regexp_matches(x, '^\\p{{Ll}}') THEN ' ' ELSE chr(1) END) || x), ''), chr(1)) AS ps FROM {name}_s),
 {name}_u AS (SELECT id, para, b, heading, generate_subscripts(ps, 1) AS s, unnest(ps) AS text FROM {name}_g UNION ALL SELECT id, para, 0, TRUE, 1, f FROM {name}_i WHERE heading),
 {name} AS (SELECT id, CAST(para AS INTEGER) AS para, CAST(row_number() OVER (PARTITION BY id, para ORDER BY b, s) AS INTEGER) AS idx, row_number() OVER (PARTITION BY id ORDER BY para, b, s) AS pos, text, heading FROM {name}_u)"""


def word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def stems(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: len(w) >= 4 AND NOT list_contains({among(L.STOPWORDS)}, w)), lambda w: w[1:5]))"


def number_words(x: str) -> str:
    """List of the numbers that number words stand for."""
    unit = f"(?:{'|'.join(sorted([*L.SMALL_NUMBERS, *L.TENS], key=len, reverse=True))})\\b"
    scale = f"(?:{'|'.join(L.SCALES)})\\b(?:[{_IN}-]+and\\b)?"
    found = f"regexp_extract_all({x}, '(?i)\\b(?:{unit}|{scale})(?:[{_IN}-]+(?:{unit}|{scale}))*')"
    case = "CASE b.w " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in {**L.SMALL_NUMBERS, **L.TENS}.items()) + " ELSE 0 END"
    some = "(CASE WHEN a.c = 0 THEN 1 ELSE a.c END)"
    step = f"""{{'t': CAST(CASE b.w WHEN 'thousand' THEN a.t + {some} * 1000 WHEN 'million' THEN a.t + {some} * 1000000 ELSE a.t END AS BIGINT),
  'c': CAST(CASE WHEN b.w = 'hundred' THEN {some} * 100 WHEN b.w IN ('thousand', 'million') THEN 0 ELSE a.c + {case} END AS BIGINT), 'w': ''}}"""
    zero = "{'t': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT), 'w': %s}"
    words = "list_filter(regexp_extract_all(lower(r), '[a-z]+'), lambda w: w <> 'and')"
    total = f"list_reduce(list_transform({words}, lambda w: {zero % 'w'}), lambda a, b: {step}, {zero % (chr(39) * 2)})"
    return f"list_transform(list_filter({found}, lambda r: array_to_string({words}, ' ') <> 'one'), lambda r: (lambda_total(r)))".replace("(lambda_total(r))", f"CAST(({total}).t + ({total}).c AS VARCHAR)")


#: Texts of the pairs without placeholders, and the sentences of each side.
BASE = f"""given AS (SELECT doc_id AS id, {_with(0)} AS source, {_with(1)} AS draft, list_extract([{", ".join(quoted(p[2]) for p in PASSAGES)}], CAST(doc_id % {len(PASSAGES)} AS INTEGER) + 1) AS facts FROM documents),
 bare AS (SELECT id, {stripped('source')} AS source, {stripped('draft')} AS draft,
  array_to_string(list_filter(string_split(regexp_replace(facts, '(?s)<!--.*?-->', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^{W}*#')), chr(10)) AS facts FROM given),
 draft_text AS (SELECT id, draft AS text FROM bare), source_text AS (SELECT id, source AS text FROM bare), facts_text AS (SELECT id, facts AS text FROM bare),
 {sentences('ds', 'draft_text')}, {sentences('ss', 'source_text')},
 prose AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM ds WHERE NOT heading)"""


def register(name: str, run, sql: str | None = None) -> None:
    run.__doc__ = run.__doc__ or f"Query {name}."
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def found(rules: list, **more):
    """A query of the findings of some rules."""

    def run(spark, sf_dir):
        rows = compare.findings(pairs(spark, sf_dir), rules, **more)
        return rows.select(F.col("pair_id").alias("doc_id"), "kind", "para", "idx", "detail")

    return run


# --- segmentation (B1 to B5, B7, B8) ---------------------------------------------------------------


def sentence_units(spark, sf_dir):
    """Every unit of the drafts."""
    rows = compare.prepared(pairs(spark, sf_dir)).select(F.col("pair_id").alias("doc_id"), F.explode("draft_units").alias("u"))
    return rows.select("doc_id", "u.*")


register("sentence_units", sentence_units, f"WITH {BASE} SELECT id AS doc_id, para, idx, text, heading FROM ds")


def rewritable_units(spark, sf_dir):
    """The units of the drafts without the title, and B5 of each: whether it is a label with a colon."""
    docs = pairs(spark, sf_dir).select(F.col("pair_id").alias("doc_id"), F.col("source").alias("text"))
    return runs.units_of(docs).select("doc_id", "pos", "heading", S.is_label_colon(F.col("text")).alias("label"), S.strip_marker(F.col("text")).alias("bare"))


register("rewritable_units", rewritable_units, f"""WITH {BASE}, raw AS (SELECT id, source AS text FROM given), {sentences('rs', 'raw')},
 kept AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos, text, heading FROM rs WHERE NOT (heading AND para = 1))
SELECT id AS doc_id, CAST(pos AS INTEGER) AS pos, heading, regexp_matches(text, '^{W}*([-*•]|[0-9]{{1,2}}[.)]){W}+') AND len(string_split(text, ':')) = 2 AND {n_words("string_split(text, ':')[1]")} <= 8 AS label,
 regexp_replace(text, '^{W}*([-*•]|[0-9]{{1,2}}[.)]){W}+', '') AS bare FROM kept""")

# --- findings (D) ----------------------------------------------------------------------------------

_KIND = "SELECT id AS doc_id, '{}' AS kind, para, idx, {} AS detail FROM prose WHERE {}"
_NONE = "CAST(NULL AS VARCHAR)"
_LABEL = f"(regexp_matches(text, '^{W}*([-*•]|[0-9]{{1,2}}[.)]){W}+') AND len(string_split(text, ':')) = 2 AND {n_words("string_split(text, ':')[1]")} <= 8)"
_SIMPLE = [
    ("long-sentence", f"CAST({n_words('text')} AS VARCHAR)", f"{n_words('text')} > 16"),
    ("semicolon", _NONE, "contains(text, ';')"),
    ("colon", _NONE, f"regexp_matches(text, ':{W}') AND NOT {_LABEL}"),
    ("em-dash", _NONE, f"regexp_matches(text, '—|{W}--{W}')"),
    ("however", _NONE, f"regexp_matches(text, '(?i),{W}*however{W}*,')"),
    ("triad", _NONE, f"regexp_matches(text, ',{W}[^,;:.]{{1,50}},{W}(and|or){W}')"),
]
register("sentence_findings", found([k for k, _, _ in _SIMPLE]), f"WITH {BASE} " + " UNION ALL ".join(_KIND.format(*x) for x in _SIMPLE))
register("stock_phrases", found(["stock-phrase"]), f"WITH {BASE} SELECT id AS doc_id, 'stock-phrase' AS kind, para, idx, unnest(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(L.STOCK_PHRASES)})\\b')) AS detail FROM prose")
register("participial_tails", found(["participial-tail"]), f"""WITH {BASE},
 cut AS (SELECT id, para, idx, string_split(regexp_replace(text, ',({W}+[a-z]{{3,}}ing\\b)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM prose),
 each AS (SELECT id, para, idx, unnest(list_transform(l, lambda x, i: {{'w': regexp_extract(x, '^{W}+([a-z]{{3,}}ing)\\b', 1), 'i': i, 'n': list_sum(list_transform(l[1:i - 1], lambda y: {n_words('y')}))}})) AS e FROM cut)
SELECT id AS doc_id, 'participial-tail' AS kind, para, idx, e.w AS detail FROM each WHERE e.i > 1 AND e.w <> '' AND NOT list_contains({among(L.NOT_PARTICIPLES)}, e.w) AND e.n >= 4""")
register("duplicate_findings", found(["duplicate"]), f"""WITH {BASE}, s AS (SELECT id, para, idx, n, {word_set('text')} AS w, {n_words('text')} AS size FROM prose)
SELECT DISTINCT b.id AS doc_id, 'duplicate' AS kind, b.para, b.idx, {_NONE} AS detail FROM s b JOIN s a ON a.id = b.id AND a.n < b.n
WHERE (len(a.w) = len(b.w) AND len(list_intersect(a.w, b.w)) = len(b.w)) OR (b.size >= 5 AND 4 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))""")
register("opening_findings", found(["openings"]), f"""WITH {BASE},
 f AS (SELECT id, para, idx, n, string_split({flat('text')}, ' ')[1] AS word, regexp_replace(lower(coalesce(list_filter(string_split({flat(f"regexp_replace(text, '^{W}*([-*•]|[0-9]{{1,2}}[.)]){W}+', '')")}, ' '), lambda w: w <> '')[1], '')), '[^a-z]', '', 'g') AS w FROM prose),
 l AS (SELECT *, lag(w, 1) OVER p AS a, lag(w, 2) OVER p AS b, lag(w, 3) OVER p AS c FROM f WINDOW p AS (PARTITION BY id ORDER BY n))
SELECT id AS doc_id, 'openings' AS kind, para, idx, word AS detail FROM l WHERE n >= 3 AND w = a AND w = b AND (n = 3 OR w <> c)""")
register("add_on_findings", found(["add-on"]), f"""WITH {BASE},
 e AS (SELECT *, count(*) OVER (PARTITION BY id) AS times FROM prose WHERE regexp_matches(text, '(?i)\\b(?:{L.ADD_ON_ENDINGS})[.!?]$')),
 c AS (SELECT id, count(*) AS n, sum(CASE WHEN regexp_matches(text, '(?i)\\b(?:{L.ADD_ON_CONNECTORS})\\b') THEN 1 ELSE 0 END) AS links FROM prose GROUP BY id)
SELECT id AS doc_id, 'add-on' AS kind, para, idx, CAST(times AS VARCHAR) AS detail FROM e WHERE times > 2
UNION ALL SELECT id, 'add-on', CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(CAST(links AS BIGINT) AS VARCHAR) FROM c WHERE links > 3 AND links * 50 > n * 3""")
register("restatement_findings", found(["restatement"]), f"""WITH {BASE}, s AS (SELECT *, {stems('text')} AS st FROM prose),
 near AS (SELECT *, list_concat(list_concat(coalesce(lag(st, 2) OVER p, []), coalesce(lag(st, 1) OVER p, [])), list_concat(coalesce(lead(st, 1) OVER p, []), coalesce(lead(st, 2) OVER p, []))) AS around FROM s WINDOW p AS (PARTITION BY id ORDER BY n))
SELECT id AS doc_id, 'restatement' AS kind, para, idx, {_NONE} AS detail FROM near WHERE {n_words('text')} <= 6 AND len(st) >= 2 AND len(list_filter(st, lambda x: NOT list_contains(around, x))) = 0""")
register("parallel_findings", found(["parallel"]), f"""WITH {BASE},
 h AS (SELECT id, para, idx, n, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '^{W}*([-*•]|[0-9]{{1,2}}[.)]){W}+', ''), '[A-Za-z][A-Za-z''-]*')[1:3], lambda w: lower(w)), lambda w: NOT list_contains({among(L.FRAME_STOPWORDS)}, w)) AS w FROM prose),
 x AS (SELECT a.id, a.n, list_min(list_filter(a.w, lambda v: list_contains(b.w, v) AND list_contains(c.w, v))) AS shared FROM h a JOIN h b ON a.id = b.id AND b.n = a.n + 1 JOIN h c ON a.id = c.id AND c.n = a.n + 2),
 g AS (SELECT id, list_reduce(list(struct_pack(f := n, o := CAST([] AS BIGINT[])) ORDER BY n), lambda a, b: CASE WHEN b.f >= a.f THEN struct_pack(f := b.f + 3, o := list_append(a.o, b.f)) ELSE a END, struct_pack(f := CAST(0 AS BIGINT), o := CAST([] AS BIGINT[]))) AS r FROM x WHERE shared IS NOT NULL GROUP BY id),
 k AS (SELECT id, unnest(r.o) AS n FROM g)
SELECT k.id AS doc_id, 'parallel' AS kind, h.para, h.idx, x.shared AS detail FROM k JOIN x ON x.id = k.id AND x.n = k.n JOIN h ON h.id = k.id AND h.n = k.n + 2""")

_SYL = "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND NOT regexp_matches(w, '(le|ie|ee|ye)$') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
STATS = f"""lens AS (SELECT id, text, {n_words('text')} AS size, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)) AS aw, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS mw,
  list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: lower(w)) AS uw FROM prose),
 st AS (SELECT id, count(*) AS n, CAST(sum(size) AS BIGINT) AS total, CAST(sum(size * size) AS BIGINT) AS squares, max(size) AS most, sum(CASE WHEN size <= 5 THEN 1 ELSE 0 END) AS short,
  CAST(sum(len(aw)) AS BIGINT) AS words, CAST(sum(list_sum(list_transform(aw, lambda w: {_SYL}))) AS BIGINT) AS syl, CAST(sum(len(mw)) AS BIGINT) AS marked,
  sum(len(list_filter(uw, lambda w: regexp_full_match(w, '{'|'.join(L.PRONOUNS)}')))) AS pronouns,
  sum(len(list_filter(uw, lambda w: regexp_full_match(w, '{L.NOMINAL}') AND NOT list_contains({among(L.NOT_NOMINAL)}, w)))) AS nominal,
  sum(CASE WHEN regexp_matches(text, '(?i)\\b(?:{L.PASSIVE_BE}){W}+(?:\\w+ly{W}+){{0,2}}(?:\\w+ed|{'|'.join(L.PASSIVE_IRREGULAR)})\\b') THEN 1 ELSE 0 END) AS passive FROM lens GROUP BY id)"""
_EASE = "206.835e0 - 1.015e0 * (CAST(words AS DOUBLE) / n) - 84.6e0 * (CAST(syl AS DOUBLE) / words)"
_WHOLE = "SELECT id AS doc_id, '{}' AS kind, CAST(NULL AS INTEGER) AS para, CAST(NULL AS INTEGER) AS idx, CAST(NULL AS VARCHAR) AS detail FROM st WHERE n >= 10 AND {}"
register("text_findings", found(["rhythm", "readability"], pos_checks=True), f"WITH {BASE}, {STATS} " + " UNION ALL ".join(_WHOLE.format(*x) for x in [
    ("staccato", "(total < n * 8 OR short * 10 > n * 3)"), ("short-sentences", "short * 100 < n * 15"), ("readability", f"coalesce(round({_EASE}, 1), 0) < 30"),
    ("pronoun", "coalesce(round(pronouns * 100e0 / marked, 1), 0) < 1.5"), ("nominalization", "coalesce(round(nominal * 100e0 / marked, 1), 0) > 11"),
]))

# --- comparison (C, E) -------------------------------------------------------------------------------

FACTS = f"""{sentences('fs', 'facts_text')},
 marked AS (SELECT 'd' AS side, id, pos, para, idx, text FROM ds UNION ALL SELECT 's', id, pos, para, idx, text FROM ss UNION ALL SELECT 'f', id, pos, para, idx, text FROM fs),
 clean AS (SELECT side, id, pos, para, idx, regexp_replace(text, '\\({W}*(?:[0-9]{{1,2}}|[a-z]|[ivx]{{1,4}}){W}*\\)', ' ', 'g') AS text FROM marked),
 {duck_digits('dn', 'side, id, pos, para, idx', 'clean')},
 nums AS (SELECT DISTINCT * FROM (SELECT side, id, pos, para, idx, value FROM dn UNION ALL SELECT side, id, pos, para, idx, unnest({number_words('text')}) FROM clean)),
 sides AS (SELECT DISTINCT side, id, value FROM nums)"""
register("number_findings", found(["new-number", "missing-number"]), f"""WITH {BASE}, {FACTS}
SELECT id AS doc_id, 'new-number' AS kind, para, idx, value AS detail FROM nums d WHERE side = 'd' AND NOT EXISTS (SELECT 1 FROM sides o WHERE o.id = d.id AND o.side <> 'd' AND o.value = d.value)
UNION ALL SELECT id, 'missing-number', arg_min(para, pos), arg_min(idx, pos), value FROM nums s WHERE side = 's' AND NOT EXISTS (SELECT 1 FROM sides o WHERE o.id = s.id AND o.side = 'd' AND o.value = s.value) GROUP BY id, value""")


def fact_numbers(spark, sf_dir):
    """A row for each number of source and fact sheet, and whether the draft uses it."""
    rows = compare.prepared(pairs(spark, sf_dir)).select("pair_id", F.explode(F.array_union("source_numbers", "facts_numbers")).alias("value"), "source_numbers", "draft_numbers")
    has = lambda c: F.array_contains(c, F.col("value"))
    return rows.select(F.col("pair_id").alias("doc_id"), "value", has("source_numbers").alias("in_source"), has("draft_numbers").alias("in_draft"))


register("number_ledger", fact_numbers, f"""WITH {BASE}, {FACTS}
SELECT a.id AS doc_id, a.value, max(CASE WHEN a.side = 's' THEN 1 ELSE 0 END) = 1 AS in_source, EXISTS (SELECT 1 FROM sides d WHERE d.side = 'd' AND d.id = a.id AND d.value = a.value) AS in_draft FROM sides a WHERE a.side <> 'd' GROUP BY a.id, a.value""")

_TERM = f"regexp_replace(regexp_replace(raw, '[.]+$', ''), '[{T.RAISED}]+$', '')"


def terms(name: str, source: str, keys: str) -> str:
    is_term = "(regexp_matches(term, '[A-Z].*[A-Z]') OR (regexp_matches(term, '[A-Z]') AND regexp_matches(term, '[0-9²³¹⁰⁴-⁹₀-₉]')))"
    return f"{name} AS (SELECT DISTINCT {keys}, term FROM (SELECT {keys}, {_TERM} AS term FROM (SELECT {keys}, unnest(regexp_extract_all(text, '{T.TERM}')) AS raw FROM {source})) WHERE {is_term} AND NOT list_contains({among(T.UNIT_NAMES)}, term))"


_INITIALS = f"list_transform(list_filter(list_slice(regexp_extract_all(before, '\\b[A-Za-z]+\\b'), -15, -1), lambda w: NOT list_contains({among(L.ACRONYM_STOPWORDS)}, lower(w))), lambda w: lower(w[1]))"
register("term_findings", found(["new-term"]), f"""WITH {BASE}, {terms('dt', 'ds', 'id, para, idx')}, {terms('known', "(SELECT id, text FROM source_text UNION ALL SELECT id, text FROM facts_text)", 'id')},
 cut AS (SELECT id, string_split(regexp_replace(text, '\\(([A-Za-z][A-Za-z-]{{1,15}})\\)', chr(1) || '\\1)', 'g'), chr(1)) AS l FROM draft_text),
 acro AS (SELECT id, unnest(list_transform(l, lambda x, i: {{'a': regexp_extract(x, '^([A-Za-z-]+)\\)', 1), 'before': array_to_string(l[1:i - 1], '('), 'i': i}})) AS e FROM cut),
 init AS (SELECT id, e.a AS a, list_transform(regexp_extract_all(e.a, '[A-Z]'), lambda c: lower(c)) AS caps, {_INITIALS.replace('before', 'e.before')} AS firsts FROM acro WHERE e.i > 1),
 defined AS (SELECT id, a AS term FROM init WHERE len(caps) >= 2 AND len(firsts) >= len(caps) AND list_slice(firsts, len(firsts) - len(caps) + 1, len(firsts)) = caps)
SELECT d.id AS doc_id, 'new-term' AS kind, d.para, d.idx, d.term AS detail FROM dt d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = d.id AND k.term = d.term) AND NOT EXISTS (SELECT 1 FROM defined k WHERE k.id = d.id AND k.term = d.term)""")


def _hedge(name: str, words: str) -> str:
    """List of the matches of a class; what stands after "not" is consumed and left out."""
    if "(?<!" in words:
        words = words.replace("(?<!not )only", "only")
        return f"list_filter(regexp_extract_all({{}}, '(?i)not only\\b|\\b({words})\\b', 1), lambda w: w <> '')"
    return f"regexp_extract_all({{}}, '(?i)\\b(?:{words})\\b')"


_MUST, _SURE = "regexp_extract_all({}, '(?i)\\bmust\\b')", "regexp_extract_all({}, '(?i)\\b(?:" + "|".join(L.CERTAINTY) + ")\\b')"
register("hedge_findings", found(["hedge", "modal", "certainty"]), f"WITH {BASE} " + " UNION ALL ".join([
    *[f"SELECT s.id AS doc_id, 'hedge' AS kind, s.para, s.idx, '{n}: ' || {_hedge(n, w).format('s.text')}[1] AS detail FROM ss s JOIN bare b ON s.id = b.id WHERE len({_hedge(n, w).format('b.draft')}) < len({_hedge(n, w).format('b.source')}) AND len({_hedge(n, w).format('s.text')}) > 0" for n, w in L.HEDGES.items()],
    *[f"SELECT s.id, '{k}', s.para, s.idx, {_NONE} FROM ds s JOIN bare b ON s.id = b.id WHERE len({p.format('b.draft')}) > len({p.format('b.source')}) AND len({p.format('s.text')}) > 0" for k, p in (("modal", _MUST), ("certainty", _SURE))],
]))
register("drop_findings", found(["possible-drop"]), f"""WITH {BASE}, st AS (SELECT s.id, s.para, s.idx, {stems('s.text')} AS own, {stems('b.draft')} AS there FROM ss s JOIN bare b ON s.id = b.id WHERE NOT s.heading),
 gone AS (SELECT *, list_sort(list_filter(own, lambda x: NOT list_contains(there, x))) AS lost FROM st)
SELECT id AS doc_id, 'possible-drop' AS kind, para, idx, array_to_string(lost, ' ') AS detail FROM gone WHERE len(lost) >= 3 AND len(lost) * 10 >= len(own) * 3""")
register("placeholder_findings", found(["placeholder"]), f"""WITH {BASE},
 m AS (SELECT id, 's' AS side, unnest(regexp_extract_all(source, '{T.PLACEHOLDER}')) AS t FROM given UNION ALL SELECT id, 'd', unnest(regexp_extract_all(draft, '{T.PLACEHOLDER}')) FROM given),
 c AS (SELECT id, t, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'd') AS d FROM m GROUP BY id, t),
 k AS (SELECT id, 'missing ' || t AS detail FROM c WHERE d < s UNION ALL SELECT id, 'repeated ' || t FROM c WHERE d > 1 AND s > 0 UNION ALL SELECT id, 'invented ' || t FROM c WHERE s = 0)
SELECT id AS doc_id, 'placeholder' AS kind, CAST(NULL AS INTEGER) AS para, CAST(NULL AS INTEGER) AS idx, detail FROM k""")


def pair_stats(spark, sf_dir):
    """The statistics of each pair and whether nothing failed."""
    rows = compare.counted(pairs(spark, sf_dir))
    return rows.select(F.col("pair_id").alias("doc_id"), "stats.*", "failures", (F.col("failures") == 0).alias("passed"))


_R = "CASE WHEN sw > 0 THEN CAST(dw AS DOUBLE) / sw * 100 ELSE 0e0 END"
register("pair_stats", pair_stats, f"""WITH {BASE}, {STATS}, {FACTS},
 w AS (SELECT id, {n_words('source')} AS sw, {n_words('draft')} AS dw FROM bare),
 m AS (SELECT id, 's' AS side, unnest(regexp_extract_all(source, '{T.PLACEHOLDER}')) AS t FROM given UNION ALL SELECT id, 'd', unnest(regexp_extract_all(draft, '{T.PLACEHOLDER}')) FROM given),
 c AS (SELECT id, t, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'd') AS d FROM m GROUP BY id, t),
 bad AS (SELECT id, 1 AS x FROM c WHERE d < s UNION ALL SELECT id, 1 FROM c WHERE d > 1 AND s > 0 UNION ALL SELECT id, 1 FROM c WHERE s = 0
  UNION ALL SELECT id, 1 FROM nums d WHERE side = 'd' AND NOT EXISTS (SELECT 1 FROM sides o WHERE o.id = d.id AND o.side <> 'd' AND o.value = d.value)
  UNION ALL SELECT id, 1 FROM sides s WHERE side = 's' AND NOT EXISTS (SELECT 1 FROM sides o WHERE o.id = s.id AND o.side = 'd' AND o.value = s.value)
  UNION ALL SELECT id, 1 FROM w WHERE {_R} < 95),
 f AS (SELECT id, count(*) AS failures FROM bad GROUP BY id)
SELECT w.id AS doc_id, CAST(sw AS INTEGER) AS source_words, CAST(dw AS INTEGER) AS draft_words, {_R} AS retention, CAST(coalesce(n, 0) AS INTEGER) AS sentences,
 coalesce(CAST(total AS DOUBLE) / n, 0) AS mean_length, CAST(coalesce(most, 0) AS INTEGER) AS max_length, coalesce(CAST(short AS DOUBLE) * 100 / n, 0) AS short_share,
 CASE WHEN n > 1 AND total > 0 THEN sqrt(CAST(n * squares - total * total AS DOUBLE) / (n * (n - 1))) / (CAST(total AS DOUBLE) / n) ELSE 0e0 END AS length_burstiness,
 coalesce({_EASE}, 0) AS flesch_reading_ease, coalesce(0.39e0 * (CAST(words AS DOUBLE) / n) + 11.8e0 * (CAST(syl AS DOUBLE) / words) - 15.59e0, 0) AS flesch_kincaid_grade,
 coalesce(CAST(pronouns AS DOUBLE) * 100 / marked, 0) AS pronoun_rate, coalesce(CAST(nominal AS DOUBLE) * 100 / marked, 0) AS nominalization_rate, coalesce(CAST(passive AS DOUBLE) * 100 / n, 0) AS passive_share,
 coalesce(failures, 0) AS failures, coalesce(failures, 0) = 0 AS passed FROM w LEFT JOIN st ON st.id = w.id LEFT JOIN f ON f.id = w.id""")

# --- gates, runs and review (E13 to E21, G3, G4, F10) --------------------------------------------------


def document_gate(spark, sf_dir):
    """The gate of every paragraph of each pair, by the overlap of stems."""
    rows = compare.prepared(pairs(spark, sf_dir)).select(F.col("pair_id").alias("doc_id"), F.explode(gate.gate_document(F.col("source"), F.col("draft"))).alias("g"))
    return rows.select("doc_id", "g.para", "g.passed", F.array_join("g.reasons", ",").alias("reasons"))


register("document_gate", document_gate)


def cosine_gate(spark, sf_dir):
    """Each vector against the next one of its label, by cosine."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = v.alias("a"), v.alias("b")
    rows = a.join(b, (F.col("b.vec_id") == F.col("a.vec_id") + 1)).select("a.vec_id", gate.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("c"))
    return rows.select("vec_id", F.round("c", 6).alias("similarity"), F.coalesce(F.col("c") >= gate.COSINE, F.lit(False)).alias("passed"))


register("cosine_gate", cosine_gate, """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
 coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9, FALSE) AS passed FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")


def flagged_units(spark, sf_dir):
    docs = pairs(spark, sf_dir).select(F.col("pair_id").alias("doc_id"), F.col("draft").alias("text"))
    return runs.find_runs(runs.units_of(docs).withColumn("flagged", F.pmod(F.col("pos") * 7, F.lit(5)) < 2))


def unit_runs(spark, sf_dir):
    """Runs of flagged units of the drafts (two of five flagged), with the units beside them."""
    return runs.runs(flagged_units(spark, sf_dir)).select("doc_id", "run", "para", "first_pos", "last_pos", "before", "after", "original")


def unit_share(spark, sf_dir):
    """F10 of each draft."""
    return runs.flagged_share(flagged_units(spark, sf_dir)).select("doc_id", "flagged", "units", "flagged_words", "words", "share", F.col("runs").cast("long").alias("runs"))


_RUNS = f"""raw AS (SELECT id, draft AS text FROM given), {sentences('rs', 'raw')},
 u AS (SELECT id, para, text, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos FROM rs WHERE NOT (heading AND para = 1)),
 fl AS (SELECT *, (pos * 7) % 5 < 2 AS flagged, {n_words(stripped('text'))} AS size, lag(text) OVER d AS pt, lead(text) OVER d AS nt, lag(para) OVER d AS pp, lead(para) OVER d AS np FROM u WINDOW d AS (PARTITION BY id ORDER BY pos)),
 g AS (SELECT *, lag(pos) OVER d AS lp, lag(para) OVER d AS lq FROM fl WHERE flagged WINDOW d AS (PARTITION BY id ORDER BY pos)),
 n AS (SELECT *, sum(CASE WHEN lq = para AND pos - lp <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM g),
 r AS (SELECT id, CAST(run AS INTEGER) AS run, min(para) AS para, min(pos) AS first_pos, max(pos) AS last_pos FROM n GROUP BY id, run)"""
register("unit_runs", unit_runs, f"""WITH {BASE}, {_RUNS}
SELECT r.id AS doc_id, r.run, r.para, CAST(first_pos AS INTEGER) AS first_pos, CAST(last_pos AS INTEGER) AS last_pos, min(CASE WHEN f.pos = first_pos AND f.pp = f.para THEN f.pt END) AS before, min(CASE WHEN f.pos = last_pos AND f.np = f.para THEN f.nt END) AS after,
 string_agg(f.text, ' ' ORDER BY f.pos) AS original FROM r JOIN fl f ON f.id = r.id AND f.pos BETWEEN first_pos AND last_pos GROUP BY r.id, r.run, r.para, first_pos, last_pos""")
register("unit_share", unit_share, f"""WITH {BASE}, {_RUNS}, k AS (SELECT id, count(*) AS runs FROM r GROUP BY id)
SELECT f.id AS doc_id, count(*) FILTER (flagged) AS flagged, count(*) AS units, CAST(sum(CASE WHEN flagged THEN size ELSE 0 END) AS BIGINT) AS flagged_words, CAST(sum(size) AS BIGINT) AS words,
 CAST(sum(CASE WHEN flagged THEN size ELSE 0 END) AS DOUBLE) * 100 / greatest(sum(size), 1) AS share, coalesce(max(k.runs), 0) AS runs FROM fl f LEFT JOIN k ON k.id = f.id GROUP BY f.id""")


def enumerations(spark, sf_dir):
    """Ordinals of the drafts that the passage before them lost."""
    rows = pairs(spark, sf_dir).select(F.col("pair_id").alias("doc_id"), F.explode(runs.enumeration_changes(F.col("source"), F.col("draft"))).alias("e"))
    return rows.select("doc_id", "e.para", "e.ordinal", "e.previous")


_ORD = [(b, o) for b, o in zip(L.ORDINALS, L.ORDINALS[1:], strict=False)]
_BROKEN = " UNION ALL ".join(f"SELECT id, side, para, '{o}' AS ordinal, '{b}' AS previous FROM par WHERE regexp_matches(t, '(?i)\\b{o}\\b') AND NOT regexp_matches(t, '(?i)\\b{b}\\b') AND NOT regexp_matches(t, '(?i)\\bnext\\b')" for b, o in _ORD)
register("broken_enumerations", enumerations, f"""WITH {BASE}, both_ AS (SELECT id, 's' AS side, source AS text FROM given UNION ALL SELECT id, 'd', draft FROM given),
 par AS (SELECT id, side, unnest(l) AS t, CAST(generate_subscripts(l, 1) AS INTEGER) AS para FROM (SELECT id, side, list_filter(list_transform(string_split_regex(text, '\\n{W}*\\n'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM both_)),
 br AS ({_BROKEN}) SELECT id AS doc_id, para, ordinal, previous FROM br WHERE side = 'd' EXCEPT SELECT id, para, ordinal, previous FROM br WHERE side = 's'""")


def copied_sentences(spark, sf_dir):
    """Sentences of the passages that their drafts nearly copy."""
    at = F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int")
    part = lambda i: F.get(F.array(*[F.lit(p[i]) for p in PASSAGES]), at)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(runs.copied(part(0), part(1))).alias("c"))
    return rows.select("doc_id", "c.text", "c.similarity")


_PART = lambda i: "list_extract([" + ", ".join(quoted(p[i]) for p in PASSAGES) + f"], CAST(doc_id % {len(PASSAGES)} AS INTEGER) + 1)"
register("copied_sentences", copied_sentences, f"""WITH o AS (SELECT doc_id AS id, {_PART(0)} AS text FROM documents), r AS (SELECT doc_id AS id, {_PART(1)} AS text FROM documents), {sentences('os', 'o')}, {sentences('rs', 'r')},
 a AS (SELECT id, pos, text, {word_set('text')} AS w FROM os), b AS (SELECT id, {word_set('text')} AS w FROM rs),
 j AS (SELECT a.id, a.pos, a.text, max(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1)) AS similarity FROM a JOIN b ON a.id = b.id WHERE len(a.w) >= 4 GROUP BY a.id, a.pos, a.text)
SELECT id AS doc_id, text, similarity FROM j WHERE similarity * 5 >= 4""")

# --- statistics (F9, F14, F16 to F18, A15) --------------------------------------------------------------


def sentence_features(spark, sf_dir):
    """F16: the seven surface features of every sentence of the drafts."""
    docs = compare.prepared(pairs(spark, sf_dir)).select(F.col("pair_id").alias("doc_id"), F.col("draft").alias("text"))
    return stats.surface_features(docs)


_F16 = {
    "earlier_in_document": "-CAST(n - 1 AS DOUBLE) / total", "length_words": "CAST(len(w) AS DOUBLE)", "mean_word_length": "CAST(list_sum(list_transform(w, lambda x: len(x))) AS DOUBLE) / len(w)",
    "long_word_rate": "CAST(len(list_filter(w, lambda x: len(x) >= 9)) AS DOUBLE) / len(w)", "ing_rate": "CAST(len(list_filter(ow, lambda x: regexp_full_match(x, '.{3,}ing'))) AS DOUBLE) / len(w)",
    "nominalization_rate": "CAST(len(list_filter(uw, lambda x: regexp_full_match(x, '" + L.LABEL_NOMINAL.replace("\\w", ".") + "'))) AS DOUBLE) / len(w)", "no_digit": "CASE WHEN regexp_matches(text, '[0-9]') THEN -1e0 ELSE 0e0 END",
}
_UNITS = "SELECT p.id, p.n, count(*) OVER (PARTITION BY p.id) AS total, p.text, list_transform(regexp_extract_all(p.text, '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: lower(w)) AS uw, regexp_extract_all(p.text, '[\\p{L}\\p{M}\\p{N}_]+') AS ow, CASE WHEN len(regexp_extract_all(p.text, '[A-Za-z][A-Za-z''-]*')) > 0 THEN regexp_extract_all(p.text, '[A-Za-z][A-Za-z''-]*') ELSE ['x'] END AS w FROM prose p"
register("sentence_features", sentence_features, f"WITH {BASE}, e AS ({_UNITS}) " + " UNION ALL ".join(f"SELECT id AS doc_id, CAST(n AS INTEGER) AS pos, '{k}' AS feature, {v} AS value FROM e" for k, v in _F16.items()))


def error_transitions(spark, sf_dir):
    """F14 over one sequence of all events, users one after the other."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), F.struct("ts", "event_id").alias("pos"), (F.col("event_type") == "error").cast("int").alias("label"))
    return stats.transitions(rows)


register("error_transitions", error_transitions, """WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, lag(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY user_id, ts, event_id) AS prev FROM events)
SELECT prev, count(*) AS pairs, CAST(sum(label) AS DOUBLE) / count(*) AS p FROM e WHERE prev IS NOT NULL GROUP BY prev""")


def page_highlights(spark, sf_dir):
    """Order lines as boxes on pages of orders, met by those that were returned."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    box = rows.select(F.pmod("l_orderkey", F.lit(97)).alias("page"), F.col("l_linenumber").alias("word_no"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 0.4).alias("x1"), F.pmod("l_partkey", F.lit(50)).cast("double").alias("y0"), F.pmod("l_partkey", F.lit(50)).cast("double").alias("y1"), "l_returnflag", "l_suppkey")
    words = box.withColumn("y1", F.col("y1") + 0.4)
    marks = box.where("l_returnflag = 'R' and l_suppkey % 7 = 0").withColumn("y1", F.col("y1") + 0.2)
    return stats.highlight_share(words, marks)


register("page_highlights", page_highlights, """WITH b AS (SELECT l_orderkey % 97 AS page, l_quantity AS x0, l_quantity + 0.4e0 AS x1, CAST(l_partkey % 50 AS DOUBLE) AS y, l_returnflag, l_suppkey FROM lineitem),
 m AS (SELECT * FROM b WHERE l_returnflag = 'R' AND l_suppkey % 7 = 0),
 f AS (SELECT page, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.page = b.page AND b.x0 < m.x1 AND m.x0 < b.x1 AND b.y < m.y + 0.2e0 AND m.y < b.y + 0.4e0) THEN 1 ELSE 0 END AS hit FROM b)
SELECT page, count(*) AS words, CAST(sum(hit) AS BIGINT) AS flagged, CAST(sum(hit) AS DOUBLE) * 100 / count(*) AS share FROM f GROUP BY page""")


def size_levels(spark, sf_dir):
    """body size and heading levels of part sizes by brand."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return stats.heading_levels(rows.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("span_no"), F.col("p_size").cast("double").alias("size")))


register("size_levels", size_levels, """WITH c AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS size, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_brand, p_size),
 b AS (SELECT p_brand, arg_max(size, n * 1000000000 - f) AS body FROM c GROUP BY p_brand), l AS (SELECT c.p_brand, body, size, dense_rank() OVER (PARTITION BY c.p_brand ORDER BY size DESC) AS level FROM c JOIN b ON b.p_brand = c.p_brand WHERE size > body + 1.2e0)
SELECT p_brand AS doc_id, body, size, CAST(level AS INTEGER) AS level FROM l WHERE level <= 3""")


def draft_audit(spark, sf_dir):
    """F9 of each pair."""
    rows = pairs(spark, sf_dir).select(F.col("pair_id").alias("doc_id"), stats.audit(F.col("source"), F.col("draft")).alias("a"))
    return rows.select("doc_id", "a.original_words", "a.words", "a.retention", "a.sentences", "a.short", "a.long", "a.longest", "a.semicolons", "a.colons")


register("draft_audit", draft_audit, f"""WITH given AS (SELECT doc_id AS id, {_with(0)} AS source, {_with(1)} AS draft FROM documents),
 l AS (SELECT id, source, draft, list_transform(list_filter(list_transform(string_split(regexp_replace({strip('draft')}, '([.?!]){W}+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> ''), lambda x: {n_words('x')}) AS z FROM given)
SELECT id AS doc_id, CAST({n_words('source')} AS INTEGER) AS original_words, CAST({n_words('draft')} AS INTEGER) AS words, CAST({n_words('draft')} AS DOUBLE) * 100 / {n_words('source')} AS retention, CAST(len(z) AS INTEGER) AS sentences,
 CAST(len(list_filter(z, lambda x: x <= 5)) AS INTEGER) AS short, CAST(len(list_filter(z, lambda x: x > 16)) AS INTEGER) AS long, CAST(list_max(z) AS INTEGER) AS longest,
 CAST(length(draft) - length(replace(draft, ';', '')) AS INTEGER) AS semicolons, CAST(length(draft) - length(replace(draft, ':', '')) AS INTEGER) AS colons FROM l""")

# --- rewrites and masking (H, I) -------------------------------------------------------------------------


def scrubbed(spark, sf_dir):
    """H1 to H3: the drafts with phrases, modals and "however" replaced."""
    rows = pairs(spark, sf_dir)
    return rows.select(F.col("pair_id").alias("doc_id"), rewrite.however(rewrite.modals(rewrite.phrases(F.col("draft")))).alias("text"))


def _nested(column: str, rules) -> str:
    for pattern, new in rules:
        # no group is followed by a digit; white space of RE2 is written out
        pattern = pattern.replace("\\s_-", _IN + "_-").replace("\\s", W)
        column = f"regexp_replace({column}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return column


register("phrase_scrub", scrubbed, f"WITH given AS (SELECT doc_id, {_with(1)} AS draft FROM documents) SELECT doc_id, {_nested('draft', [*L.PHRASES, *L.MODALS, *L.HOWEVER])} AS text FROM given")


def punct_split(spark, sf_dir):
    """H5 of the drafts."""
    rows = pairs(spark, sf_dir)
    return rows.select(F.col("pair_id").alias("doc_id"), rewrite.strong_marks(F.col("draft")).alias("text"))


def _raised(column: str, pattern: str) -> str:
    return f"array_to_string(list_transform(string_split(regexp_replace({column}, '{pattern}', '. ' || chr(2) || '\\1', 'g'), chr(2)), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), '')"


register("punct_split", punct_split, f"WITH given AS (SELECT doc_id, {_with(1)} AS draft FROM documents), a AS (SELECT doc_id, {_raised('draft', f';{W}*([a-z])')} AS t FROM given), b AS (SELECT doc_id, regexp_replace(t, ';{W}*', '. ', 'g') AS t FROM a) SELECT doc_id, {_raised('t', f':{W}+([a-z])')} AS text FROM b")


def register_swap(spark, sf_dir):
    """H10 of the drafts, with the number of words replaced."""
    rows = pairs(spark, sf_dir)
    return rows.select(F.col("pair_id").alias("doc_id"), rewrite.plainer(F.col("draft")).alias("text"), rewrite.n_plainer(F.col("draft")).alias("changes"))


_SWAPS = [(f"\\b{c(k)}\\b", c(v)) for k, v in sorted(L.REGISTER.items(), key=lambda x: -len(x[0])) for c in (str, lambda x: x[:1].upper() + x[1:])]
register("register_swap", register_swap, f"WITH given AS (SELECT doc_id, {_with(1)} AS draft FROM documents) SELECT doc_id, {_nested('draft', _SWAPS)} AS text, CAST(len(regexp_extract_all(draft, '(?i)\\b(?:{'|'.join(sorted(L.REGISTER, key=len, reverse=True))})\\b')) AS INTEGER) AS changes FROM given")


def whole_rewrite(spark, sf_dir):
    """H1 to H9 in their order, and the audit of what they made of each draft."""
    rows = pairs(spark, sf_dir).select(F.col("pair_id").alias("doc_id"), "draft", rewrite.rewritten(F.col("draft")).alias("text"))
    return rows.select("doc_id", "text", stats.audit(F.col("draft"), F.col("text")).alias("a")).select("doc_id", "text", "a.retention", "a.sentences", "a.triads")


register("whole_rewrite", whole_rewrite)


def variant_manifest(spark, sf_dir):
    """The variants of each passage and what they keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = F.pmod("doc_id", F.lit(len(PASSAGES))).cast("int")
    texts = docs.select("doc_id", F.get(F.array(*[F.lit(p[1]) for p in PASSAGES]), at).alias("text"))
    return rewrite.manifest(texts).select("doc_id", "variant", "words", "word_delta", "sentences", "sentence_delta", "numbers_ok", "retention", "warnings")


register("variant_manifest", variant_manifest)


def latex_round_trip(spark, sf_dir):
    """Every document inside LaTeX, masked and restored: whether the file came back, and what was kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = "\\documentclass{article}\n\\begin{document}\n\\section{Intro \\& more}\nWe \\emph{see}~\\cite{a} that $x_1$ holds.\n"
    tex = F.concat(F.lit(head), F.coalesce("text", F.lit("")), F.lit("\n\\end{document}\n"))
    rows = docs.select("doc_id", tex.alias("tex")).withColumn("m", latex.masked("tex")).withColumn("r", latex.restored("m.view", "m.map"))
    return rows.select("doc_id", F.coalesce(F.col("r.tex") == F.col("tex"), F.lit(False)).alias("same"), (F.length("m.view") > 0).alias("shown"))


register("latex_round_trip", latex_round_trip, "SELECT doc_id, TRUE AS same, TRUE AS shown FROM documents")
