"""Text rewrites as Column expressions (H1 to H11, H13's inflection): ordered rules from data, folded into one map.

Where a group of a match must change its letters, the rule puts marks around the group, the text is split at the
marks, and the marked pieces are changed; so the work stays in the JVM. Brackets inside brackets (H11) need an Arrow function.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillmark.functions import lexicon as L
from quillmark.functions import text as T

#: Around the part of a replacement that is changed afterwards.
OPEN, CLOSE = "\x02", "\x03"


def changed(text, change) -> Column:
    """The text with change() applied to each part between OPEN and CLOSE, without the marks."""
    parts = F.split(text, OPEN)

    def one(part, i):
        both = F.split(part, CLOSE)
        return F.when((i == 0) | (F.size(both) < 2), part).otherwise(F.concat(change(both[0]), F.get(both, F.lit(1))))

    return F.array_join(F.transform(parts, one), "")


def upper_first(x) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))


def capitalised(x) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))


def replaced(text, rules, flags: str = "(?U)") -> Column:
    """Ordered rules (pattern, replacement with $n) applied one after the other."""
    return reduce(lambda t, r: F.regexp_replace(t, flags + r[0], r[1]), rules, text)


def phrases(text) -> Column:
    """H1."""
    return replaced(text, L.PHRASES)


def modals(text) -> Column:
    """H2."""
    return replaced(text, L.MODALS)


def however(text) -> Column:
    """H3."""
    return replaced(text, L.HOWEVER)


def triads(text) -> Column:
    """H4: lists of three become the first two of them. This drops the third: compare.check() shows what is lost."""
    marked = F.regexp_replace(text, f"(?U){L.TRIAD_OF}", f"{OPEN}$1{CLOSE} and {OPEN}$2{CLOSE}")
    return changed(marked, T.strip)


def strong_marks(text) -> Column:
    """H5: semicolons and colons end the sentence, the next letter becomes large."""
    text = changed(F.regexp_replace(text, r"(?U);\s*([a-z])", f". {OPEN}$1{CLOSE}"), F.upper)
    text = F.regexp_replace(text, r"(?U);\s*", ". ")
    return changed(F.regexp_replace(text, r"(?U):\s+([a-z])", f". {OPEN}$1{CLOSE}"), F.upper)


def tails(text) -> Column:
    """H6: clauses after a comma become sentences."""
    for pattern, new in L.TAILS:
        if L.CAPITAL in new:
            first, middle, last = new.split(L.CAPITAL)
            text = changed(F.regexp_replace(text, f"(?U){pattern}", f"{first}{OPEN}{middle}{CLOSE}{last}"), capitalised)
        else:
            text = F.regexp_replace(text, f"(?U){pattern}", new)
    return text


def simple_sentences(text) -> Column:
    """Pieces after an end mark and white space."""
    return F.split(text, r"(?U)(?<=[.?!])\s+")


def compounds(text) -> Column:
    """H7: a sentence of more than 16 words is split where the first rule that fits fits first."""

    def one(s):
        out = s
        for pattern, new in reversed(L.COMPOUNDS):
            once = F.regexp_replace(s, rf"(?sU)^(.*?){pattern}", "$1" + new.replace("$1", "$2"))
            out = F.when(s.rlike(f"(?U){pattern}"), once).otherwise(out)
        return F.when(T.n_words(s) > 16, out).otherwise(s)

    return F.array_join(F.transform(simple_sentences(text), one), " ")


def pacing(text) -> Column:
    """H8: of three sentences in a row with more than 12 words each the middle one is split at its first comma."""
    return T.let(simple_sentences(text), _pacing)


def _pacing(parts) -> Column:
    left = lambda s: T.strip(F.substring_index(s, ",", 1))
    right = lambda s: T.strip(F.substr(s, F.instr(s, ",") + 1, F.length(s)))
    splits = lambda s: F.contains(s, F.lit(",")) & (T.n_words(left(s)) >= 3) & (T.n_words(right(s)) >= 3)
    rows = F.transform(parts, lambda s: F.struct((T.n_words(s) > 12).alias("long"), splits(s).alias("splits")))
    hits = lambda rs: F.transform(rs, lambda r, i: F.coalesce(r["long"] & F.get(rs, i + 1)["long"] & F.get(rs, i + 2)["long"] & F.get(rs, i + 1)["splits"], F.lit(False)))
    hit = T.let(rows, hits)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("free"), F.array().cast("array<int>").alias("cut"))
    step = lambda a, h: F.struct(
        (a["i"] + 1).alias("i"),
        F.when(h & (a["i"] >= a["free"]), a["i"] + 2).otherwise(a["free"]).alias("free"),
        F.when(h & (a["i"] >= a["free"]), F.concat(a["cut"], F.array(a["i"] + 1))).otherwise(a["cut"]).alias("cut"),
    )
    cut = F.aggregate(hit, start, step, lambda a: a["cut"])
    out = lambda cut: F.transform(parts, lambda s, i: F.when(F.array_contains(cut, i), F.concat(left(s), F.lit(". "), upper_first(right(s)))).otherwise(s))
    return F.array_join(F.transform(F.array(cut), out)[0], " ")


def cleaned(text) -> Column:
    """The end of H9: single blanks, no doubled stops, large letters after a stop."""
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)\.\s*\.", ".")
    return T.strip(changed(F.regexp_replace(text, r"(?U)\.\s+([a-z])", f". {OPEN}$1{CLOSE}"), F.upper))


#: H9: the order of the rewrites.
ORDER = (phrases, modals, however, strong_marks, triads, tails, compounds, pacing, cleaned)


def rewritten(text) -> Column:
    """H9: all rewrites on each paragraph."""
    paras = F.filter(F.split(text, "\n\n"), lambda p: T.strip(p) != "")
    return F.array_join(F.transform(paras, lambda p: reduce(lambda t, f: F.transform(F.array(t), f)[0], ORDER, p)), "\n\n")


# --- plainer words, and brackets -----------------------------------------------------------------

_REGISTER = rf"(?iU)\b({'|'.join(sorted(L.REGISTER, key=len, reverse=True))})\b"


def plainer(text) -> Column:
    """Words of the register list replaced, the first letter's case kept."""
    to = F.create_map(*[F.lit(x) for pair in L.REGISTER.items() for x in pair])
    new = lambda w: F.try_element_at(to, F.lower(w))
    case = lambda w: F.when(F.substring(w, 1, 1).rlike(r"^\p{Lu}"), upper_first(new(w))).otherwise(new(w))
    return changed(F.regexp_replace(text, _REGISTER, f"{OPEN}$1{CLOSE}"), case)


def n_plainer(text) -> Column:
    return F.regexp_count(text, F.lit(_REGISTER))


def bracket_parts(inner: str) -> list:
    """The parts of a bracket's content between commas with a blank that are in no bracket inside it."""
    depth, parts, part = 0, [], ""
    for piece in _pieces(inner):
        depth += (piece == "(") - (piece == ")")
        if piece == ", " and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += piece
    return [p.strip() for p in [*parts, part] if p.strip()]


def _pieces(text: str) -> list:
    return re.findall(r", |[()]|[^(),]+|,", text)


def split_brackets(text: str) -> tuple:
    """(text, number of brackets split): each outermost bracket with several parts becomes one for each part."""
    out, depth, inner, n = "", 0, "", 0
    pieces = _pieces(text)
    # brackets that are never closed are plain text: the places of those that are
    stack, closed = [], {}
    for i, piece in enumerate(pieces):
        if piece == "(":
            stack.append(i)
        elif piece == ")" and stack:
            closed[stack.pop()] = i
    i = 0
    while i < len(pieces):
        if pieces[i] == "(" and i in closed:
            inner = "".join(pieces[i + 1 : closed[i]])
            parts = bracket_parts(inner)
            out += " ".join(f"({p})" for p in parts) if len(parts) > 1 else f"({inner})"
            n += len(parts) > 1
            i = closed[i]
        else:
            out += pieces[i]
        i += 1
    return out, n


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("changes", IntegerType())]))
def brackets(text: pd.Series) -> pd.DataFrame:
    rows = [(None, 0) if t is None else split_brackets(t) for t in text]
    return pd.DataFrame({"text": [r[0] for r in rows], "changes": pd.Series([r[1] for r in rows], dtype="int32")})


def third_person(verb) -> Column:
    """A verb's form after he, she or it."""
    irregular = F.create_map(*[F.lit(x) for x in ("be", "is", "have", "has", "do", "does", "go", "goes")])
    regular = F.when(verb.rlike("(?:s|sh|ch|x|z|o)$"), F.concat(verb, F.lit("es"))).when(verb.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(verb, "y$", ""), F.lit("ies"))).otherwise(F.concat(verb, F.lit("s")))
    return F.coalesce(F.try_element_at(irregular, verb), regular)


# --- variants ------------------------------------------------------------------------------------

#: The transforms of the variants in their order, and those that need no parser.
TRANSFORMS = ("clause_split", "lexical_register", "demonstrative_chain", "paren_isolation", "lexical_repeat", "voice_alternation")
APPLY = ("clause_split", "lexical_register", "voice_alternation", "demonstrative_chain", "lexical_repeat", "paren_isolation")
AVAILABLE = ("lexical_register", "paren_isolation")


def variant_specs(mode: str) -> list:
    """(variant, names of its transforms) of the modes single, all and leave-one-out."""
    single = [(f"single__{t}", (t,)) for t in TRANSFORMS]
    but_one = [(f"loo__minus_{t}", tuple(x for x in TRANSFORMS if x != t)) for t in TRANSFORMS]
    return [("baseline", ())] + {"single": single, "all": [("all", TRANSFORMS)], "leave-one-out": [("all", TRANSFORMS), *but_one]}[mode]


def variants(docs, mode: str = "leave-one-out", key: str = "doc_id"):
    """A row for each text and variant: its text, and the changes of each transform (null: needs a parser)."""
    specs = F.array(*[F.struct(F.lit(n).alias("variant"), F.array(*[F.lit(t) for t in a]).cast("array<string>").alias("active")) for n, a in variant_specs(mode)])
    rows = docs.select(key, F.col("text").alias("base"), F.explode(specs).alias("v")).select(key, "base", "v.*")
    on = lambda t: F.array_contains("active", t)
    rows = rows.withColumn("text", F.when(on("lexical_register"), plainer(F.col("base"))).otherwise(F.col("base")))
    rows = rows.withColumn("split", brackets(F.when(on("paren_isolation"), F.col("text"))))
    counts = {"lexical_register": n_plainer(F.col("base")), "paren_isolation": F.col("split.changes")}
    made = F.array(*[F.when(on(t), F.struct(F.lit(t).alias("key"), counts.get(t, F.lit(None)).cast("int").alias("value"))) for t in APPLY])
    changes = F.map_from_entries(F.filter(made, lambda e: e.isNotNull()))
    return rows.select(key, "variant", "active", "base", F.when(on("paren_isolation"), F.col("split.text")).otherwise(F.col("text")).alias("text"), changes.alias("changes"))


def manifest(docs, mode: str = "leave-one-out", key: str = "doc_id"):
    """Words and sentences of each variant, how they differ from the text's own, and whether its facts are kept."""
    from quillmark.functions.segment import prose, sentences
    from quillmark.operators import compare, gate

    rows = variants(docs, mode, key)
    pairs = rows.select(F.struct(key, "variant", "active", "changes").alias("pair_id"), F.col("base").alias("source"), F.col("text").alias("draft"), F.lit("").alias("facts"))
    checked = compare.check(pairs, keep=True)
    count = lambda c: F.size(prose(sentences(F.col(c))))
    size = lambda c: T.n_words(F.col(c))
    f = gate.fidelity(F.col("findings"))
    return checked.select(
        f"pair_id.{key}", "pair_id.variant", "pair_id.active", "pair_id.changes", size("given_draft").alias("words"), (size("given_draft") - size("given_source")).alias("word_delta"),
        count("given_draft").alias("sentences"), (count("given_draft") - count("given_source")).alias("sentence_delta"), f.alias("f"), F.col("stats.retention").alias("retention"),
    ).select("*", "f.*").drop("f")


def scrubbed_latex(tex) -> Column:
    """Plain paragraphs of more than five words of a LaTeX body, by ordered scrubs."""
    rules = (
        (r"\\(textbf|textit|emph|texttt)\{([^}]+)\}", "$2"), (r"\\(section|subsection|subsubsection)\*?\{([^}]+)\}", "\n\n$2\n\n"),
        (r"\\cite\{[^}]+\}", ""), (r"%.*", ""), (r"\$([^$]+)\$", "$1"), (r"\\,|~", " "), (r"\\pm", "±"),
        (r"\\(begin|end)\{[^}]+\}", ""), (r"\\[a-zA-Z]+(\[[^\]]*\])?(\{[^}]*\})?", " "),
    )
    paras = F.transform(F.split(replaced(tex, rules, ""), "\n\n"), T.flat)
    return F.array_join(F.filter(paras, lambda p: T.n_words(p) > 5), "\n\n")
