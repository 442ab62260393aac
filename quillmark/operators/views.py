"""The segmentation views that the operators read: units (sentences), tokens, words, turns.

Each view is a DataFrame here and a common table expression for DuckDB in `DUCK`, so one relational query
runs on both. A unit is a piece of a paragraph that ends with a mark and white space; a newline ends a
paragraph. Both are found with one marked replacement, without look-behind, as RE2 has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\x01"


def pieces(text):
    """Array of the trimmed sentences of a text column."""
    cut = F.split(F.regexp_replace(text, r"([.?!])[ \t\r]+|\n+", f"$1{MARK}"), MARK)
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def words(text):
    """Array of the blank-separated words of a text column."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def units(docs: DataFrame, key: str = "doc_id", carry: tuple = ("lang",)) -> DataFrame:
    """One row for each sentence: key, carried columns, pos from 1, text, n_words."""
    rows = docs.select(key, *carry, F.posexplode(pieces(F.col("text"))).alias("at", "text"))
    return rows.select(key, *carry, (F.col("at") + 1).cast("int").alias("pos"), "text", F.size(words(F.col("text"))).alias("n_words"))


def tokens(units_: DataFrame, key: str = "doc_id", carry: tuple = ("lang",)) -> DataFrame:
    """One row for each run of ASCII letters, lower-cased: pos of its unit, k from 1 in the unit, tok."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = units_.select(key, *carry, "pos", F.posexplode(found).alias("at", "tok"))
    return rows.select(key, *carry, "pos", (F.col("at") + 1).cast("int").alias("k"), "tok")


def numbers(texts: DataFrame, *keys: str) -> DataFrame:
    """One row for each number among the blank-separated words, in canonical form.

    Commas between thousands, leading zeros and zeros at a fraction's end don't count; marks at
    a word's end are left out.
    """
    rows = texts.select(*keys, F.explode(words(F.regexp_replace("text", r"[\n\t\r]", " "))).alias("w"))
    bare = F.regexp_replace("w", r"[.,;:!?)\]]+$", "")
    rows = rows.select(*keys, bare.alias("w")).where(F.col("w").rlike(r"^[0-9]+(,[0-9][0-9][0-9])*([.][0-9]+)?$"))
    return rows.select(*keys, canonical("w").alias("value"))


def canonical(number):
    """One form of a number: without commas, leading zeros and zeros at a fraction's end."""
    plain = F.regexp_replace(number, ",", "")
    plain = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "[.]$", "")).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(plain, "^0+", ""), "^([.]|$)", "0$1")


#: Digits glued to a letter, a digit or a formula mark, or to a letter and hyphen, are no number.
DIGITS = r"(?<![A-Za-z0-9_^{/.])(?<![A-Za-z]-)([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)([.][0-9]+)?"


def digits(texts: DataFrame, *keys: str) -> DataFrame:
    """One row for each number of C1 wherever it stands, within words too, in canonical form."""
    rows = texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(DIGITS), F.lit(0))).alias("w"))
    return rows.select(*keys, canonical(F.col("w")).alias("value"))


def duck_digits(name: str, keys: str, source: str) -> str:
    """digits() for DuckDB: RE2 has no look-behind, so glued digits are consumed and leave an empty group."""
    found = r"(?:[A-Za-z]-|[A-Za-z_^{/.])[0-9]+|((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.][0-9]+)?)[0-9]*"
    return rf"""{name} AS (SELECT {keys}, CASE WHEN p = '' OR starts_with(p, '.') THEN '0' || p ELSE p END AS value
 FROM (SELECT {keys}, regexp_replace(CASE WHEN contains(c, '.') THEN regexp_replace(regexp_replace(c, '0+$', ''), '[.]$', '') ELSE c END, '^0+', '') AS p
  FROM (SELECT {keys}, replace(w, ',', '') AS c FROM (SELECT {keys}, unnest(regexp_extract_all(text, '{found}', 1)) AS w FROM {source}) WHERE w <> '')))"""


DUCK = {
    "units": r"""units AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS pos, text,
 CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS INTEGER) AS n_words
 FROM (SELECT doc_id, lang, unnest(l) AS raw, trim(raw) AS text, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, lang, string_split(regexp_replace(text, '([.?!])[ \t\r]+|\n+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents))
 WHERE text <> '')""",
    "tokens": r"""tokens AS (SELECT doc_id, lang, pos, CAST(generate_subscripts(l, 1) AS INTEGER) AS k, unnest(l) AS tok
 FROM (SELECT doc_id, lang, pos, regexp_extract_all(lower(text), '[a-z]+') AS l FROM units))""",
    "turn_numbers": r"""turn_numbers AS (SELECT conv_id, turn, CASE WHEN p = '' OR starts_with(p, '.') THEN '0' || p ELSE p END AS value
 FROM (SELECT conv_id, turn, regexp_replace(CASE WHEN contains(c, '.') THEN regexp_replace(regexp_replace(c, '0+$', ''), '[.]$', '') ELSE c END, '^0+', '') AS p
  FROM (SELECT conv_id, turn, replace(w, ',', '') AS c FROM (SELECT conv_id, turn, regexp_replace(unnest(string_split(regexp_replace(text, '[\n\t\r]', ' ', 'g'), ' ')), '[.,;:!?)\]]+$', '') AS w FROM conversations)
   WHERE regexp_matches(w, '^[0-9]+(,[0-9][0-9][0-9])*([.][0-9]+)?$'))))""",
    "doc_numbers": r"""doc_numbers AS (SELECT doc_id, CASE WHEN p = '' OR starts_with(p, '.') THEN '0' || p ELSE p END AS value
 FROM (SELECT doc_id, regexp_replace(CASE WHEN contains(c, '.') THEN regexp_replace(regexp_replace(c, '0+$', ''), '[.]$', '') ELSE c END, '^0+', '') AS p
  FROM (SELECT doc_id, replace(w, ',', '') AS c FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '[\n\t\r]', ' ', 'g'), ' ')), '[.,;:!?)\]]+$', '') AS w FROM documents)
   WHERE regexp_matches(w, '^[0-9]+(,[0-9][0-9][0-9])*([.][0-9]+)?$'))))""",
    "turn_words": r"""turn_words AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM conversations)""",
    "doc_digits": duck_digits("doc_digits", "doc_id", "documents"),
    "turn_digits": duck_digits("turn_digits", "conv_id, turn", "conversations"),
}


def build(spark, sf_dir: str, name: str) -> DataFrame:
    """A view, or else a table."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "units":
        return units(read("documents"))
    if name == "tokens":
        return tokens(units(read("documents")))
    if name == "turn_numbers":
        return numbers(read("conversations"), "conv_id", "turn")
    if name == "doc_numbers":
        return numbers(read("documents"), "doc_id")
    if name == "doc_digits":
        return digits(read("documents"), "doc_id")
    if name == "turn_digits":
        return digits(read("conversations"), "conv_id", "turn")
    if name == "turn_words":
        found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
        return read("conversations").select("conv_id", "turn", F.explode(found).alias("tok"))
    return read(name)
