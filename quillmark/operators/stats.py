"""Statistics over units, labels, tokens and boxes (F9, F13 to F18, A14's and A15's relational part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import lexicon as L
from quillmark.functions import text as T
from quillmark.functions.segment import prose, sentences


def audit(original, text) -> Column:
    """counts of a text beside its original: sentences also end at line breaks."""
    parts = F.filter(F.transform(F.split(T.strip(text), r"(?U)(?<=[.?!])\s+|\n+"), T.strip), lambda s: s != "")
    sizes = F.transform(parts, T.n_words)
    count = lambda test: F.size(F.filter(sizes, test))
    n, total = F.size(sizes), F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    marks = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.struct(
        T.n_words(original).alias("original_words"), T.n_words(text).alias("words"),
        F.when(T.n_words(original) > 0, T.n_words(text) * 100 / T.n_words(original)).otherwise(0.0).alias("retention"),
        n.alias("sentences"), count(lambda x: x <= 5).alias("short"), count(lambda x: x > 16).alias("long"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest"),
        F.when(n > 0, total / n).otherwise(0.0).alias("mean"), F.regexp_count(text, F.lit(f"(?U){L.TRIAD_COUNT}")).alias("triads"), marks(";").alias("semicolons"), marks(":").alias("colons"),
    )


def surface_features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """F16: a row (key, pos, feature, value) for each of the seven features of each sentence; one scan, no exchange."""
    rows = docs.select(key, prose(sentences(F.col("text"))).alias("u"))
    rows = rows.select(key, F.size("u").alias("n"), F.posexplode(F.transform("u", lambda u: u["text"])).alias("at", "text"))
    rows = rows.select(key, "n", "at", "text", T.marked_words(F.col("text")).alias("w"))
    rows = rows.withColumn("w", F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.lit("x"))))
    per = lambda c: c / F.size("w")
    features = {
        "earlier_in_document": -F.col("at") / F.col("n"),
        "length_words": F.size("w").cast("double"),
        "mean_word_length": per(F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w))),
        "long_word_rate": per(F.size(F.filter("w", lambda w: F.length(w) >= 9))),
        "nominalization_rate": per(F.size(T.all_of(F.col("text"), rf"(?iU)\b{L.LABEL_NOMINAL}\b"))),
        "ing_rate": per(F.size(T.all_of(F.col("text"), r"(?U)\b\w{3,}ing\b"))),
        "no_digit": -F.col("text").rlike("[0-9]").cast("double"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in features.items()])
    return rows.select(key, (F.col("at") + 1).alias("pos"), F.explode(each).alias("f")).select(key, "pos", "f.*")


def labelled(units: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units with the label 1 if they begin with a yellow prefix, null from an unknown one on, else 0.

    labels has key, yellow_prefixes, unknown_prefixes and unknown_from_prefix of each document.
    """
    starts = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.startswith(F.col("text"), p))
    from_ = F.coalesce(F.startswith(F.col("text"), F.when(F.col("unknown_from_prefix") != "", F.col("unknown_from_prefix"))), F.lit(False))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = units.join(labels, key).withColumn("unknown", F.max(from_).over(w) | starts(F.col("unknown_prefixes")))
    return rows.select(key, "pos", "text", F.when(~F.col("unknown"), starts(F.col("yellow_prefixes")).cast("int")).alias("label"))


def shares(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """known and highlighted sentences of each document, and their share in percent."""
    out = rows.where("label is not null").groupBy(key).agg(F.count("*").alias("known"), F.sum("label").alias("highlighted"))
    return out.withColumn("share", F.col("highlighted") * 100 / F.col("known"))


def transitions(rows: DataFrame, key: str = "doc_id", pos: str = "pos", label: str = "label") -> DataFrame:
    """F14 over one sequence of all rows, by a whole-number key and pos: pairs and share of 1 after 0 and after 1.

    Rows of unknown label are passed over. Each document hands on its last label to the next one of its block of
    documents, and each block to the next block, so no task sees the whole sequence.
    """
    known = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(pos).alias("p"), F.col(label).alias("label"))
    before = lambda c, w: F.lag(c).over(w).alias("prev")
    inside = known.select("label", before("label", Window.partitionBy("k").orderBy("p")))
    docs = known.groupBy("k").agg(F.min_by("label", "p").alias("first"), F.max_by("label", "p").alias("last")).withColumn("block", F.shiftright("k", 16))
    between = docs.select(F.col("first").alias("label"), before("last", Window.partitionBy("block").orderBy("k")))
    blocks = docs.groupBy("block").agg(F.min_by("first", "k").alias("first"), F.max_by("last", "k").alias("last"))
    across = blocks.select(F.col("first").alias("label"), before("last", Window.orderBy("block")))
    pairs = inside.union(between).union(across).where("prev is not null")
    return pairs.groupBy("prev").agg(F.count("*").alias("pairs"), (F.sum("label") / F.count("*")).alias("p"))


def auc(features: DataFrame, label: str = "label", bins: int = 1024) -> DataFrame:
    """area under the curve of each feature (rows feature, value, label), ties counted half.

    Equal values are counted first. What lies below a value comes from the totals of the bins below its own
    and from the values inside it, so no task sees a whole feature.
    """
    counts = features.where(F.col(label).isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    ends = counts.groupBy("feature").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    step = F.when(F.col("most") > F.col("least"), (F.col("value") - F.col("least")) / (F.col("most") - F.col("least")) * bins).otherwise(0.0)
    dealt = counts.join(F.broadcast(ends), "feature").withColumn("bin", F.floor(step)).drop("least", "most")  # a row a feature
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.groupBy("feature", "bin").agg(F.sum("n").alias("all"))
    below = below.select("feature", "bin", F.coalesce(F.sum("all").over(earlier(Window.partitionBy("feature").orderBy("bin"))), F.lit(0)).alias("under"))
    own = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("feature", "bin").orderBy("value"))), F.lit(0))
    ranked = dealt.withColumn("own", own).join(below, ["feature", "bin"]).withColumn("below", F.col("under") + F.col("own"))
    total = ranked.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * (F.col("below") * 2 + F.col("n") + 1)).alias("twice"))
    wins = F.col("twice") / 2 - F.col("pos") * (F.col("pos") + 1) / 2
    return total.select("feature", "rows", (wins / F.nullif(F.col("pos") * (F.col("rows") - F.col("pos")), F.lit(0))).alias("auc"))


def token_features(sentences_: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """mean negative log-likelihood, share of ranks to 10 and mean log rank of the tokens inside each sentence.

    sentences_ has key, pos, start, end; tokens has key, start, end, nll, rank. A token belongs to the sentence that
    holds it whole. Sentences don't overlap, so the last one that starts before a token decides: one union, sorted by place, in
    place of a range join.
    """
    s = sentences_.select(key, "start", F.lit(0).alias("kind"), "pos", F.col("end").alias("until"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("double").alias("nll"), F.lit(None).cast("long").alias("rank"))
    t = tokens.select(key, "start", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("until"), F.col("end").cast("long").alias("end"), F.col("nll").cast("double"), F.col("rank").cast("long"))
    w = Window.partitionBy(key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = s.union(t).withColumns({"pos": F.last("pos", True).over(w), "until": F.last("until", True).over(w)})
    inside = rows.where("kind = 1 and pos is not null and end <= until")
    return inside.groupBy(key, "pos").agg(F.count("*").alias("tokens"), F.avg("nll").alias("mean_nll"), F.avg((F.col("rank") <= 10).cast("double")).alias("top10_share"), F.avg(F.log("rank")).alias("mean_logrank"))


def highlight_share(words: DataFrame, boxes: DataFrame, page: str = "page") -> DataFrame:
    """Of each page the words and those that meet a box; both have page, x0, y0, x1, y1 (words: word_no too)."""
    w, b = words.alias("w"), boxes.alias("b")
    meets = (F.col("w.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("w.x1")) & (F.col("w.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("w.y1"))
    hit = w.join(b, (F.col(f"w.{page}") == F.col(f"b.{page}")) & meets, "left_semi").groupBy(page).agg(F.count("*").alias("flagged"))
    out = words.groupBy(page).agg(F.count("*").alias("words")).join(hit, page, "left").na.fill(0, ["flagged"])
    return out.withColumn("share", F.col("flagged") * 100 / F.col("words"))


def heading_levels(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """of each document its body size (the most frequent one, the first seen of ties) and the levels of sizes above it.

    spans has doc, span_no and size. Sizes more than 1.2 above the body's are headings, the three largest of levels 1 to 3.
    """
    sizes = spans.groupBy(doc, F.round("size", 1).alias("size")).agg(F.count("*").alias("n"), F.min("span_no").alias("first"))
    body = sizes.groupBy(doc).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    larger = sizes.join(body, doc).where(F.col("size") > F.col("body") + 1.2)
    level = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc("size")))
    return larger.select(doc, "body", "size", level.alias("level")).where("level <= 3")


def joined_hyphens(text) -> Column:
    """Words parted at a line's end joined, no blanks before marks."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2"), r"(?U)\s+([,.:;?!])", "$1")
