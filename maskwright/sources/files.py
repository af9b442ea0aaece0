"""Files: list files, text extracts, binary documents; and what is written."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import OCR_NOTE
from ..functions.text import split_lines
from ..operators.audit import failing_documents
from .lines import join_lines
from .store import numbered

LIST_NAME = "redaction_list.txt"
#: Categories of a list, and what they are for.
CATEGORY_NOTES = {
    "name": "persons; other orders of a name's words are replaced too",
    "employer": "employers, payers, banks, brokers",
    "ssn": "social security numbers in any grouping",
    "email": "mail addresses",
    "dob": "dates of birth, month first; other ways to write them are replaced too",
    "id": "numbers of licences and of other papers",
    "phone": "telephone numbers with any separators",
    "addr": "street addresses; commas and spaces needn't be as in the text",
    "acct": "account numbers",
}


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), line of a list file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(split_lines(F.col("value"))).alias("pos", "line")).select((F.col("pos") + 1).alias("line_no"), "line")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_ord (from 1, by path), path, content of binary files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.join(numbered(files.select("path"), ["path"], "doc_ord"), "path").select("doc_ord", "path", "content")


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of text extracts; the list file isn't one."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return df.filter(F.col("path").endswith(".txt") & ~F.col("path").endswith("/" + LIST_NAME))


def extracts(redacted: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """doc_ord, text: each document's redacted lines under a header that begins with #. names: doc_ord, name."""
    text = join_lines(redacted, "redacted").join(redacted.groupBy("doc_ord").agg(F.bool_or("is_ocr").alias("is_ocr")), "doc_ord")
    if names is not None:
        text = text.join(names, "doc_ord", "left")
    name = F.coalesce("name", F.col("doc_ord").cast("string")) if names is not None else F.col("doc_ord").cast("string")
    note = F.when(F.col("is_ocr"), f" {OCR_NOTE}: compare amounts with the original.").otherwise("")
    header = F.concat(F.lit("# Redacted extract of "), name, F.lit("; tokens are the same in all extracts of this run."), note, F.lit("\n\n"))
    return text.select("doc_ord", F.concat(header, "text").alias("text"))


def promote(made: DataFrame, audited: DataFrame) -> DataFrame:
    """What may be handed on: the documents without a failing line."""
    return made.join(failing_documents(audited), "doc_ord", "left_anti")


def write_extracts(made: DataFrame, audited: DataFrame, path: str) -> None:
    """Write those extracts that pass, a folder for each document."""
    promote(made, audited).write.mode("overwrite").partitionBy("doc_ord").text(path, lineSep="\n")


def list_path(spark: SparkSession, folder: str) -> str:
    """The list of a folder: in it, or one or two levels up; if there is none, where it would be made."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at = fs.makeQualified(at)
    places = [at, at.getParent(), at.getParent() and at.getParent().getParent()]
    lists = [spark._jvm.org.apache.hadoop.fs.Path(p, LIST_NAME) for p in places if p is not None]
    return next((p for p in lists if fs.exists(p)), lists[0]).toString()


def lists_for(spark: SparkSession, folder: str, master: str | None = None) -> list[DataFrame]:
    """The lists to read, the folder's own first, as load_entries wants them; those that don't exist are left out."""
    out = []
    for path in [list_path(spark, folder), *([master] if master else [])]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            out.append(read_list(spark, path))
    return out


def template() -> str:
    """The head of a new list, which says what may stand in it."""
    kinds = [f"#   {k + ':':<11}{said}" for k, said in CATEGORY_NOTES.items()]
    return "\n".join([
        f"# {LIST_NAME}: values that are replaced wherever they stand. Once filled in it is as private as the documents.",
        "# One value a line. What follows a # is a comment; a value behind one is never replaced, and never offered again.",
        "# A value can begin with its category; without one it is a name:", *kinds,
    ])


def append_entries(found: DataFrame, path: str, source: str) -> None:
    """Append candidates (category, value) to a list held as a folder of text files, under a dated header; a new list begins
    with the template. Nothing is written if there are none."""
    spark = found.sparkSession
    if found.isEmpty():
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    lines = [] if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else template().split("\n")
    lines.append(f"# added {date.today().isoformat()} from {source}: comment out what is wrong")
    head = spark.createDataFrame([("\n".join(lines), 0)], "value string, nth int").select("nth", "value")
    rows = found.select(F.lit(1).alias("nth"), F.concat_ws(": ", "category", "value").alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("nth", "value").select("value").write.mode("append").text(path)


def pdf_glyphs(documents: DataFrame) -> DataFrame:
    """Characters of PDF files, if a PDF library is installed: doc_ord, page_no, ch, x0, y0, x1, y1, size, upright, matrix."""
    try:
        import pdfplumber  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pdfplumber; a table of characters can be given instead") from e

    def read(batches):  # noqa: ANN001, ANN202
        import io

        import pandas as pd
        import pdfplumber

        for pdf in batches:
            rows = []
            for doc, raw in zip(pdf["doc_ord"], pdf["content"], strict=True):
                with pdfplumber.open(io.BytesIO(raw)) as file:
                    for n, page in enumerate(file.pages, 1):
                        ox, oy = page.bbox[:2]
                        rows += [(doc, n, c["text"], c["x0"] - ox, c["top"] - oy, c["x1"] - ox, c["bottom"] - oy, c["size"], c.get("upright", True), list(c.get("matrix") or ())[:4]) for c in page.chars]
            yield pd.DataFrame(rows, columns=["doc_ord", "page_no", "ch", "x0", "y0", "x1", "y1", "size", "upright", "matrix"])

    return documents.select("doc_ord", "content").mapInPandas(
        read, "doc_ord bigint, page_no int, ch string, x0 double, y0 double, x1 double, y1 double, size double, upright boolean, matrix array<double>"
    )
