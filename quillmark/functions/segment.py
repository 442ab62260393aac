"""Segmentation as Column expressions: paragraphs, blocks, sentences.

Whether a line starts a block depends on it and the line before only, and whether a piece goes to the sentence
before it on the two pieces only. So blocks and sentences are made by marking the cuts and splitting once,
in time proportional to the text, and nothing is folded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import lexicon as L
from quillmark.functions.text import CUT, flat, let, n_flat, n_words, strip

#: A bullet, or a list number, at the start of a line.
MARKER = r"(?U)^\s*(?:[-*•]|[0-9]{1,2}[.)])\s+"
END = r"[.?!][\"”’')\]]?"
SENTENCE = "struct<para:int,idx:int,text:string,heading:boolean>"


def is_formula(line) -> Column:
    """An equals sign by itself, and no mark at the end."""
    return F.contains(line, F.lit("=")) & line.rlike(r"(?U)(?:^|\s)=(?:\s|$)") & ~strip(line).rlike("[.?!]$")


def strip_marker(text) -> Column:
    """A text without the bullet or number that it starts with."""
    return F.regexp_replace(text, MARKER, "")


def is_label_colon(text) -> Column:
    """A bullet of the form "Label: description"."""
    parts = F.split(text, ":")
    return text.rlike(MARKER) & (F.size(parts) == 2) & (n_words(parts[0]) <= 8)


def stripped(parts) -> Column:
    """The parts without white space at their ends, and without empty ones; only those that have some are searched for it."""
    edges = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return F.filter(F.transform(parts, lambda x: F.when(edges(x).rlike(r"(?U)\s"), strip(x)).otherwise(x)), lambda x: x != "")


def paragraphs(text) -> Column:
    """The paragraphs of a text, parted by blank lines."""
    return stripped(F.split(text, r"(?U)\n\s*\n"))


def joined(parts, before) -> Column:
    """The parts with before(part, part before it) in front of each; the first has "" as the one before it."""
    return let(parts, lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(before(x, F.coalesce(F.get(p, i - 1), F.lit("")), i == 0), x)), ""))


def blocks(para) -> Column:
    """B2: array of (text, formula): bullets and formulas start blocks, other lines go on with theirs."""
    lines = stripped(F.split(para, "\n"))

    def before(x, last, first):
        starts = first | x.rlike(MARKER) | is_formula(x) | is_formula(last)
        return F.when(starts, F.concat(F.lit(CUT), F.when(is_formula(x), "F").otherwise("P"))).otherwise(F.lit(" "))

    found = F.filter(F.split(joined(lines, before), CUT), lambda b: b != "")
    return F.transform(found, lambda b: F.struct(flat(F.substring(b, 2, 2**31 - 1)).alias("text"), b.startswith("F").alias("formula")))


def pieces(block) -> Column:
    """Sentences of a block of single blanks: after an end mark and white space, but not after abbreviations or before small letters."""
    parts = F.split(F.regexp_replace(block, rf"(?U)({END})\s+", f"$1{CUT}"), CUT)

    def before(x, last, first):
        token = F.ltrim(F.substring_index(last, " ", -1), F.lit("(["))
        glued = token.isin(*L.ABBREVIATIONS) | x.rlike(r"^\p{Ll}")
        return F.when(first, F.lit("")).when(glued, F.lit(" ")).otherwise(F.lit(CUT))

    return F.split(joined(parts, before), CUT)


def sentences(text) -> Column:
    """B1: array of (para, idx, text, heading) of all sentences, headings and formulas of a text."""
    return units_of(paragraphs(text))


def units_of(paras) -> Column:
    """sentences() of a text of these paragraphs. The units of a paragraph follow from it alone."""

    def of_paragraph(para):
        return let(flat(para), lambda one: unit_list(para, one))

    def unit_list(para, one):
        heading = ~F.contains(para, F.lit("\n")) & (n_flat(one) <= 30) & ~one.rlike(r"[.?!:][\"”)\]]?$")
        unit = lambda t, h: F.struct(t.alias("text"), h.alias("heading"))
        of_block = lambda b: F.when(b["formula"], F.array(unit(b["text"], F.lit(True)))).otherwise(F.transform(pieces(b["text"]), lambda x: unit(x, F.lit(False))))
        return F.when(heading, F.array(unit(one, F.lit(True)))).otherwise(F.flatten(F.transform(blocks(para), of_block)))

    found = F.transform(paras, of_paragraph)
    place = lambda units, p: F.transform(units, lambda u, i: F.struct((p + 1).cast("int").alias("para"), (i + 1).cast("int").alias("idx"), u["text"].alias("text"), u["heading"].alias("heading")))
    return F.flatten(F.transform(found, place))


def prose(units) -> Column:
    """The units that are sentences."""
    return F.filter(units, lambda u: ~u["heading"])


def rewritable(units) -> Column:
    """All units but the title, a heading in the first paragraph."""
    return F.filter(units, lambda u: ~(u["heading"] & (u["para"] == 1)))
