"""Column builders for words, stems, numbers, terms and acronyms of a text. Null texts give null.

Four tokenisers stand side by side, as the rules do: white space, letters, letters with marks inside, and
letters with digits. None of them needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import lexicon as L
from quillmark.operators.views import DIGITS, canonical

SPACE = r"(?U)\s+"
#: Text between two of these is one piece; no text has it.
CUT = "\x01"
#: A character of a word where only ASCII counts: the SQL's patterns end words before all others.
ASCII = "[A-Za-z0-9_]"


def let(value, body) -> Column:
    """body(value) with the value computed once a row, however often the body and its inner functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def listed(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def all_of(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def begin(words_) -> str:
    """Start of a (?iU) pattern of whole words: cheap tests for their first letters, in lower case here, before a costly one.

    A character that is no Latin-1 one may equal a letter where the case doesn't matter, and is let through.
    """
    firsts = {w[0] for w in words_}
    return f"(?-iU:(?=[{''.join(sorted(firsts | {c.upper() for c in firsts}))}\\u0130-\\u212a])(?<![A-Za-z]))"


def whole(alternatives: str) -> str:
    """Pattern of alternatives as whole words, in either case."""
    return rf"(?iU)\b(?:{alternatives})\b"


def strip(text) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def flat(text) -> Column:
    """White space as single blanks, none at the ends."""
    # a single blank, which is most white space, is passed over
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def words(text) -> Column:
    """Words parted by white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_flat(text) -> Column:
    """Words of a text of single blanks, none at the ends: one more than its blanks."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def n_words(text) -> Column:
    return let(flat(text), n_flat)


def alpha_words(text) -> Column:
    return all_of(text, "[A-Za-z]+")


def marked_words(text) -> Column:
    """Words of letters, with apostrophes and hyphens inside."""
    return all_of(text, "[A-Za-z][A-Za-z'-]*")


def word_set(text) -> Column:
    """C11: the different words of letters and digits."""
    return F.array_distinct(all_of(F.lower(text), "[a-z0-9]+"))


def stems(text) -> Column:
    """First five letters of the different content words."""
    content = F.filter(all_of(F.lower(text), "[a-z]{4,}"), lambda w: ~w.isin(*L.STOPWORDS))
    return F.array_distinct(F.transform(content, lambda w: F.substring(w, 1, 5)))


def syllables(word) -> Column:
    """Vowel groups of a word of letters, less a silent final e."""
    word = F.lower(word)
    groups = F.size(all_of(word, "[aeiouy]+"))
    silent = word.endswith("e") & ~word.rlike("(?:le|ie|ee|ye)$") & (groups > 1)
    return F.when(word == "", 0).otherwise(F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0)))


#: Words of letters without a vowel, and those of two vowel groups or more with a silent final e.
_VOWEL, _OTHER = "[AEIOUYaeiouy]", "[B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]"
_NO_VOWEL = f"(?={_OTHER})(?<![A-Za-z]){_OTHER}++(?![A-Za-z])"
_SILENT = f"(?=[A-Za-z])(?<![A-Za-z]){_OTHER}*+{_VOWEL}++{_OTHER}++[A-Za-z]++(?<=[^LlIiEeYy][Ee])"


def n_syllables(text) -> Column:
    """The sum of syllables() over the words of letters of a text, by three counts.

    A word has its vowel groups, one if there is none, and one less if it has several and its final e is silent.
    """
    n = lambda pattern: F.size(all_of(text, pattern))
    return n(f"{_VOWEL}+") + n(_NO_VOWEL) - n(_SILENT)


def jaccard_at_least(a, b, up: int, down: int) -> Column:
    """Whether two sets without repeats have a similarity of up / down or more; the sizes are compared first."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    # the sizes decide first
    return (F.least(n, m) * down >= F.greatest(n, m) * up) & (both * down >= (n + m - both) * up)


# --- facts ---------------------------------------------------------------------------------------

#: Marks of list items, which are no facts.
LIST_MARKER = r"(?U)\(\s*(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})\s*\)"
_VALUES = {**L.SMALL_NUMBERS, **L.TENS}
_UNIT = f"(?:{'|'.join(sorted(_VALUES, key=len, reverse=True))})(?!{ASCII})"
_SCALE = rf"(?:{'|'.join(L.SCALES)})(?!{ASCII})(?:(?U:[\s-]+)and(?!{ASCII}))?"
#: C4: number words with blanks or hyphens between them, and "and" after a scale. A digit beside a number word makes it none.
NUMBER_RUN = rf"(?i){begin([*_VALUES, *L.SCALES])}(?<!{ASCII})(?:{_UNIT}|{_SCALE})(?:(?U:[\s-]+)(?:{_UNIT}|{_SCALE}))*"


def without_list_markers(text) -> Column:
    return F.regexp_replace(text, LIST_MARKER, " ")


def number_of(run) -> Column:
    """C4: the number that a run of number words stands for; null for a lone "one" and beyond 38 digits."""
    return let(F.filter(F.split(F.lower(run), "[^a-z]+"), lambda w: ~w.isin("", "and")), _number_of)


def _number_of(parts) -> Column:
    big = lambda x: x.cast("decimal(38,0)")
    values = F.create_map(*[F.lit(x) for w, n in _VALUES.items() for x in (w, n)])
    scales = F.create_map(*[F.lit(x) for w, n in L.SCALES.items() for x in (w, n)])
    start = F.struct(big(F.lit(0)).alias("total"), big(F.lit(0)).alias("own"))

    def step(acc, w):
        some = F.when(acc["own"] == 0, big(F.lit(1))).otherwise(acc["own"])
        scaled = big(F.try_multiply(some, big(F.try_element_at(scales, w))))
        added = big(F.try_add(acc["total"], scaled))
        plain = big(F.try_add(acc["own"], big(F.try_element_at(values, w))))
        own = F.when(w == "hundred", scaled).when(w.isin("thousand", "million"), big(F.lit(0))).otherwise(plain)
        return F.struct(F.when(w.isin("thousand", "million"), added).otherwise(acc["total"]).alias("total"), own.alias("own"))

    total = F.aggregate(parts, start, step, lambda acc: acc["total"] + acc["own"])
    return F.when(F.array_join(parts, " ") != "one", total.cast("string"))


def number_words(text) -> Column:
    """C4: numbers written as words."""
    return F.filter(F.transform(all_of(text, NUMBER_RUN), number_of), lambda n: n.isNotNull())


def numbers(text) -> Column:
    """The different numbers of one sentence, in digits or words, in one form."""
    found = lambda t: F.concat(F.transform(all_of(t, DIGITS), canonical), number_words(t))
    return F.array_distinct(let(without_list_markers(text), found))


def numbers_of(texts) -> Column:
    """The different numbers of an array of sentences: no number goes over a CUT."""
    return numbers(F.array_join(texts, CUT))


#: Units that look like acronyms and are no terms; marks cut off at a term's end.
UNIT_NAMES = (
    "MPa", "GPa", "TPa", "MeV", "GeV", "TeV", "MHz", "GHz", "THz",
    "MW", "GW", "TW", "MWh", "GWh", "TWh", "MJ", "GJ", "TB", "GB", "MB",
)
RAISED = "²³¹⁰ⁱ⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"
TERM = "[A-Za-z][A-Za-z0-9²³¹⁰-₟.]*"
#: What TERM finds that has a capital, in group 1: a run of its characters without what is no letter before the first one.
CAPITAL_TERM = "(?<![A-Za-z0-9²³¹⁰-₟.])[0-9²³¹⁰-₟.]*+((?:[a-z][a-z0-9²³¹⁰-₟.]*+)?[A-Z][A-Za-z0-9²³¹⁰-₟.]*+)"


def terms(text) -> Column:
    """The different names: two capitals, or one and a digit."""
    bare = F.transform(all_of(text, CAPITAL_TERM, 1), lambda t: F.regexp_replace(F.regexp_replace(t, "[.]+$", ""), f"[{RAISED}]+$", ""))
    name = lambda t: (t.rlike("[A-Z].*[A-Z]") | (t.rlike("[A-Z]") & t.rlike("[0-9²³¹⁰⁴-⁹₀-₉]"))) & ~t.isin(*UNIT_NAMES)
    return F.array_distinct(F.filter(bare, name))


def defined_acronyms(text) -> Column:
    """Acronyms in brackets whose capitals are the first letters of the words before them.

    The text is cut before each bracket, and every cut piece holds a word, so the last 15 words before an
    acronym are in the 16 pieces before it.
    """
    cut = F.split(F.regexp_replace(text, r"\(([A-Za-z][A-Za-z-]{1,15})\)", f"{CUT}$1)"), CUT)
    # of each piece the acronym that it begins with, and its words
    cut = F.transform(cut, lambda p: F.struct(F.regexp_extract(p, r"^([A-Za-z-]+)\)", 1).alias("a"), all_of(p, r"(?U)\b[A-Za-z]+\b").alias("w")))

    def defined(pieces, i):
        acronym = F.get(pieces, i)["a"]
        letters = F.transform(all_of(acronym, "[A-Z]"), F.lower)
        k = F.size(letters)
        before = F.flatten(F.transform(F.slice(pieces, F.greatest(F.lit(1), i - 15), F.least(i, F.lit(16))), lambda p: p["w"]))
        before = F.slice(before, F.greatest(F.lit(1), F.size(before) - 14), F.lit(15))
        before = F.filter(F.transform(before, F.lower), lambda w: ~w.isin(*L.ACRONYM_STOPWORDS))
        last = F.when(F.size(before) >= k, F.slice(before, F.size(before) - k + 1, k))
        fits = (k >= 2) & (F.transform(last, lambda w: F.substring(w, 1, 1)) == letters)
        return F.when(F.coalesce(fits, F.lit(False)), terms(acronym)).otherwise(F.array().cast("array<string>"))

    at = lambda pieces: F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    return let(cut, lambda pieces: F.array_distinct(F.flatten(F.transform(at(pieces), lambda i: defined(pieces, i)))))


def fact_sheet(text) -> Column:
    """A fact sheet without comments and headings."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.array_join(F.filter(F.split(bare, "\r\n|\n|\r"), lambda x: ~x.rlike(r"(?U)^\s*#")), "\n")


#: Marks that stand for kept LaTeX.
PLACEHOLDER = "⟦/?[0-9]+⟧"


def placeholders(text) -> Column:
    return all_of(text, PLACEHOLDER)


def strip_placeholders(text) -> Column:
    """A text without placeholders and the blanks that they leave."""
    bare = F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, ""), r"[ \t\xa0]+([.,;:!?)\]])", "$1")
    return F.when(text.rlike(PLACEHOLDER), F.regexp_replace(bare, r"[ \t]{2,}", " ")).otherwise(text)
