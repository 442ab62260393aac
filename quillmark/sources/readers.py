"""Readers and sinks (A1 to A8, A11 to A13, A17): folders of documents, fact sheets, flags, labels and reports.

Files are read by Spark's own readers; only the XML inside a .docx needs Python. What a tool outside would do
(the text of a PDF) is a column of the input here, and a problem with a file is a column of the output, so one
bad file fails no job.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmark.functions import text as T
from quillmark.functions.latex import masked

# Kinds of files in the order of choice, names of main files, and hints in a name.
KINDS = ("tex", "docx", "pdf", "md", "markdown", "txt")
ROOTS = ("main.tex", "paper.tex", "root.tex", "manuscript.tex")
HINTS = ("paper", "conference", "report")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, folder, name and content of all files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")


def kind(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))


def primary(rows: DataFrame) -> DataFrame:
    """A1: of each folder the main document: by kind; among .tex files by name, then by document class, hints first."""
    name = F.col("name")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind(name))
    root = F.array_position(F.array(*[F.lit(r) for r in ROOTS]), name)
    classed = F.contains(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), F.lit("\\documentclass"))
    own = F.lower(F.regexp_extract("folder", "([^/]*)$", 1))
    hinted = F.contains(F.lower(name), own)
    for h in HINTS:
        hinted = hinted | F.contains(F.lower(name), F.lit(h))
    rank = F.when(kind(name) != "tex", 0).when(root > 0, root).when(classed & hinted, 10).when(classed, 11).otherwise(12)
    usable = rows.where(~name.startswith(".") & (order > 0))
    first = Window.partitionBy("folder").orderBy(order, rank, "path")
    return usable.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def docx_text(data: bytes) -> tuple:
    """A3: (text, problem) of a .docx: its paragraphs, parted by blank lines."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")
        root = ET.fromstring(xml)
    except zipfile.BadZipFile:
        return None, "not a zip archive"
    except KeyError:
        return None, "word/document.xml is missing"
    except ET.ParseError:
        return None, "document.xml is broken"
    marks = {WORD + "tab": "\t", WORD + "br": " ", WORD + "cr": " "}
    lines = ("".join(n.text or "" if n.tag == WORD + "t" else marks.get(n.tag, "") for n in p.iter()).strip() for p in root.iter(WORD + "p"))
    text = "\n\n".join(x for x in lines if x)
    return (text + "\n", None) if text else (None, "the document has no text")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("problem", StringType())]))
def docx(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if c is None else docx_text(bytes(c)) for c in content], columns=["text", "problem"])


def pdf_lines(text: Column) -> Column:
    """A4: the text of a PDF page by page, as a layout tool gives it, cleaned: single blanks, one blank line at most."""
    lines = F.transform(F.split(T.strip(F.replace(text, F.lit("\x0c"), F.lit(""))), "\n"), lambda x: T.strip(F.regexp_replace(x, r"[ \t]+", " ")))
    out = T.strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
    return F.when(out != "", F.concat(out, F.lit("\n")))


def ingest(rows: DataFrame, pdf_text: Column | None = None) -> DataFrame:
    """A2 to A5: path, text, map and problem of each file; pdf_text is the text that a tool found in a PDF."""
    of = kind(F.col("name"))
    plain = F.decode("content", "UTF-8")
    split = rows.withColumns({"docx": docx(F.when(of == "docx", F.col("content"))), "tex": masked(F.when(of == "tex", plain))})
    pdf = F.lit(None).cast("string") if pdf_text is None else pdf_lines(pdf_text)
    text = F.when(of.isin("txt", "md", "markdown"), plain).when(of == "docx", F.col("docx.text")).when(of == "tex", F.col("tex.view")).when(of == "pdf", pdf)
    why = F.when(~of.isin(*KINDS), "unsupported format").when(of == "docx", F.col("docx.problem")).when((of == "pdf") & pdf.isNull(), "no text: no tool for PDF, or a scan")
    return split.select("path", text.alias("text"), F.when(of == "tex", F.col("tex.map")).alias("map"), why.alias("problem"))


def flagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """File, line number and text of the lines that aren't blank."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "line"))
    return rows.select("file", (F.col("at") + 1).alias("line_no"), T.strip(F.col("line")).alias("line")).where("line <> ''")


LABELS = "map<string, struct<file:string, zerogpt_score:double, yellow_prefixes:array<string>, unknown_prefixes:array<string>, unknown_from_prefix:string>>"


def label_sets(spark: SparkSession, path: str) -> DataFrame:
    """Name, file, score and prefixes of each document of a file of labels."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", LABELS)).alias("name", "d"))
    return rows.select("name", "d.file", F.col("d.zerogpt_score").alias("score"), "d.yellow_prefixes", "d.unknown_prefixes", "d.unknown_from_prefix")


def write_ready(rows: DataFrame, path: str) -> None:
    """Rows by column ready: those that are go to path/ready=true, the others to path/ready=false; older ones are replaced."""
    rows.write.mode("overwrite").partitionBy("ready").parquet(path)


def report(findings: DataFrame, key: str = "pair_id") -> DataFrame:
    """A Markdown report of each text's findings, failures first."""
    line = F.concat_ws(" ", F.concat(F.lit("- "), F.col("level")), F.concat(F.lit("**"), F.col("kind"), F.lit("**")), F.coalesce(F.col("detail"), F.lit("")), F.concat(F.lit("> "), F.substring("text", 1, 110)))
    rows = findings.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("level") == "FAIL").alias("failed"), F.array_sort(F.collect_list(F.struct("level", "kind", "para", "idx", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("# Findings: "), F.col("n").cast("string"), F.lit(", failed: "), F.col("failed").cast("string"), F.lit("\n\n"))
    return rows.select(key, F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def manifest_report(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """A Markdown table of each text's variants, from rewrite.manifest()."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    numbers = F.when(F.col("numbers_ok"), "PASS").otherwise("FAIL")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "variant", F.array_join("active", ", "), cell("words"), cell("word_delta"), cell("sentences"), cell("sentence_delta"), numbers, F.round("retention", 1).cast("string"), cell("warnings")), F.lit(" |"))
    rows = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("variant", row.alias("row")))).alias("rows"))
    head = "| variant | active | words | delta | sentences | delta | numbers | retention | warnings |\n" + "| -- " * 9 + "|\n"
    return rows.select(key, F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n")).alias("text"))
