"""Files as listings and as sections of text."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import clean_text, count_contained, extension, strip
from ..ranges import row_numbers

# Known extensions and their types, size limit, block sizes, keywords.
EXTENSIONS = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".txt": "txt", ".md": "markdown", ".csv": "csv", ".xlsx": "xlsx", ".xls": "xlsx",
    ".pptx": "pptx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".json": "json", ".rtf": "rtf", ".ods": "ods", ".odt": "odt",
}
UPLOADABLE = [".pdf", ".docx", ".txt", ".md", ".csv", ".xlsx", ".xls", ".pptx", ".json", ".png", ".jpg", ".jpeg", ".rtf", ".ods", ".odt"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
ROWS_PER_SECTION = 20
JSON_SLICE = 3000
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TIMETABLE_WORDS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "time", "period", "lecture", "lab", "slot"]
MARKSHEET_WORDS = ["marks", "total", "grade", "result", "usn", "sgpa", "cgpa", "pass", "fail", "semester", "internal", "external"]
FACULTY_WORDS = ["faculty", "professor", "department", "designation", "hod", "lecturer", "instructor"]


def file_type(name: Column) -> Column:
    """The type of a file name's extension; null for unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension(name))


def listed(files: DataFrame) -> DataFrame:
    """Rows of the binaryFile source -> one row per visible file of a known type, with its content and hash."""
    name = F.substring_index("path", "/", -1)
    out = files.select(F.col("path").alias("file_path"), name.alias("filename"), file_type(name).alias("file_type"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_hash"), "content")
    return out.filter(F.col("file_type").isNotNull() & ~F.col("filename").startswith("."))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The top level of a folder; files below it are not read."""
    return listed(spark.read.format("binaryFile").load(f"{folder}/*"))


def admitted(uploads: DataFrame, name: str = "filename", size: str = "size_bytes") -> DataFrame:
    """Uploads with an allowed extension and a size within the limit."""
    return uploads.filter(extension(F.col(name)).isin(UPLOADABLE) & (F.col(size) > 0) & (F.col(size) <= MAX_UPLOAD_BYTES))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def _sections(files: DataFrame, pieces: Column, *, source_type: str, text: Column, **meta: Column) -> DataFrame:
    """A section for each piece whose text is not blank; sections are numbered as they come."""
    rows = files.select("file_path", F.posexplode(pieces).alias("n", "piece"))
    rows = rows.select("file_path", "n", clean_text(text).alias("text"), F.lit(source_type).alias("source_type"), *[c.alias(k) for k, c in meta.items()]).filter("text <> ''")
    return rows.withColumn("section_index", F.row_number().over(W.partitionBy("file_path").orderBy("n")) - 1).drop("n")


def text_sections(files: DataFrame) -> DataFrame:
    return _sections(files, F.array(decoded(F.col("content"))), source_type="txt", text=F.col("piece"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """A section from each heading to the next; what stands before the first one has an empty heading."""
    head = r"(?d)^#{1,6}[ \t\f\x0B\r]+"
    pieces = F.split(decoded(F.col("content")), r"(?dm)(?=^#{1,6}[ \t\f\x0B\r]+)")
    first = F.substring_index("piece", "\n", 1)
    heading = F.when(first.rlike(head), strip(F.regexp_replace(first, head, ""))).otherwise(F.lit(""))
    return _sections(files, pieces, source_type="markdown", text=F.col("piece"), section=heading)


def row_text(columns: list[str]) -> Column:
    """`column: value` lines of the cells that are not empty; null where none is left."""
    cells = [F.when(~F.trim(F.col(f"`{c}`")).isin(NA_WORDS), F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`")))) for c in columns]
    return F.nullif(F.concat_ws("\n", *cells), F.lit(""))


def table_sections(rows: DataFrame, group: str, order: list[str], columns: list[str], source_type: str = "csv", size: int = ROWS_PER_SECTION) -> DataFrame:
    """Rows of tables -> sections of `size` non-empty rows each, with the table's columns and the range of rows."""
    texts = rows.select(group, *order, row_text(columns).alias("row")).filter("row is not null")
    numbered = row_numbers(texts, group, order, "rn").withColumn("section_index", F.floor((F.col("rn") - 1) / size).cast("int"))
    blocks = numbered.groupBy(group, "section_index").agg(F.array_sort(F.collect_list(F.struct("rn", "row"))).alias("x"))
    body = clean_text(F.array_join("x.row", "\n\n"))
    span = F.concat_ws("-", F.array_min("x.rn").cast("string"), F.array_max("x.rn").cast("string"))
    return blocks.select(group, "section_index", body.alias("text"), F.lit(source_type).alias("source_type"), F.lit(", ".join(columns)).alias("columns"), span.alias("row_range")).filter("text <> ''")


csv.field_size_limit((1 << 31) - 1)  # a cell may be any text


def csv_blocks(content: bytes, size: int = ROWS_PER_SECTION) -> Iterator[tuple[str, str, str]]:
    """(text, columns, range of rows) of each `size` non-empty rows of a CSV file, which has a header of its own. Values
    keep their spelling; rows with more cells than the header are left out, missing cells are empty."""
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    rows = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
    header, missing = next(rows, []), set(NA_WORDS)
    cells = ([f"{c}: {v.strip()}" for c, v in zip(header, row) if v.strip() not in missing] for row in rows if len(row) <= len(header))
    filled, at = ("\n".join(row) for row in cells if row), 1
    while block := list(islice(filled, size)):
        yield "\n\n".join(block), ", ".join(header), f"{at}-{at + len(block) - 1}"
        at += len(block)


def csv_sections(files: DataFrame) -> DataFrame:
    """CSV files with their content -> sections; a narrow step."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                found = list(csv_blocks(content.as_py() or b""))
                texts, columns, spans = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(found), b.schema.field(0).type), pa.array(range(len(found)), pa.int32()), *[pa.array(x, pa.string()) for x in (texts, columns, spans)]], names=["file_path", "section_index", "text", "columns", "row_range"])

    kind = files.schema["file_path"].dataType.simpleString()
    rows = files.select("file_path", "content").mapInArrow(run, f"file_path {kind}, section_index int, text string, columns string, row_range string")
    return rows.select("file_path", "section_index", clean_text(F.col("text")).alias("text"), F.lit("csv").alias("source_type"), "columns", "row_range").filter("text <> ''")


def flattened(value, prefix: str = "") -> Iterator[str]:
    """`path: value` lines of nested JSON; empty objects and lists give none."""
    stack = [(prefix, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield f"{at}: {v}"


@F.arrow_udf(T.StringType())
def flat_json(text: pa.Array) -> pa.Array:
    """JSON texts as lines; null for texts that are no JSON."""
    out = []
    for t in text.to_pylist():
        try:
            out.append(None if t is None else "\n".join(flattened(json.loads(t))))
        except ValueError:
            out.append(None)
    return pa.array(out, type=pa.string())


def slices(text: Column, size: int = JSON_SLICE) -> Column:
    """A text in parts of so many characters; an empty array for an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def json_sections(files: DataFrame) -> DataFrame:
    whole = files.select("file_path", clean_text(flat_json(decoded(F.col("content")))).alias("text"))
    rows = whole.select("file_path", F.posexplode(slices(F.col("text"))).alias("section_index", "text"))
    return rows.select("file_path", "section_index", "text", F.lit("json").alias("source_type"))


def preview_manifests(spark: SparkSession, folder: str, name: str = "preview.json") -> DataFrame:
    """The manifests of the folders below: JSON over several lines, one object or an array of them in a file."""
    schema = "document_id string, filename string, file_type string, file_hash string, status string, page_count int, preview_type string, has_pdf boolean, has_images boolean, created_at timestamp"
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/{name}")


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes], list[tuple[str, dict]]]]) -> DataFrame:
    """Extension point: files(file_path, file_type, content) -> (file_path, section_index, text, meta map, error).

    parsers maps a type to a function from bytes to (text, metadata) pairs. A file that gives no text, fails or has no
    parser is one row with an error of at most 500 characters.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf["file_path"], pdf["file_type"], pdf["content"]):
                try:
                    if kind not in parsers:
                        raise ValueError(f"No parser for type: {kind}")
                    got = [(t, {k: str(v) for k, v in m.items()}) for t, m in parsers[kind](bytes(content)) if t.strip()]
                    rows += [(path, i, t, m, None) for i, (t, m) in enumerate(got)] or [(path, None, None, None, "No readable content found")]
                except Exception as e:
                    rows.append((path, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["file_path", "section_index", "text", "meta", "error"]).astype({"section_index": "Int32"})

    return files.select("file_path", "file_type", "content").mapInPandas(run, "file_path string, section_index int, text string, meta map<string,string>, error string")


def dataset_type(name: Column, text: Column) -> Column:
    """timetable, marksheet, faculty or general, by the file's name or the keywords in its first 2000 characters."""
    stem = F.lower(F.regexp_replace(name, r"(?<=[^./])\.[^./]+$", ""))
    head = F.lower(F.substring(text, 1, 2000))
    return (
        F.when(stem.contains("timetable") | (count_contained(head, TIMETABLE_WORDS) >= 3), "timetable")
        .when(stem.contains("marks") | (count_contained(head, MARKSHEET_WORDS) >= 3), "marksheet")
        .when(stem.contains("faculty") | (count_contained(head, FACULTY_WORDS) >= 2), "faculty")
        .otherwise("general")
    )
