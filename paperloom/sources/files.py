"""Files as rows: guards, decoding, and tables inside CSV and XLSX files."""

from __future__ import annotations

import csv
import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.text import a1_range, js_trim, markdown_table, safe_file_name, source_hash
from ..operators.columns import promote

#: Fixed values.
MAX_BYTES = 5 * 1024 * 1024
EXTENSIONS = ("txt", "md", "csv", "xlsx", "pdf")
MIME = (
    "text/plain", "text/markdown", "text/csv", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/octet-stream", "application/pdf",
)
CONTENT_TYPES = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "xlsx": MIME[4], "pdf": "application/pdf"}
MAX_SHEETS = 200


def directory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of files, with fileName (a + stays one); ``in_order`` sorts them."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return got.withColumn("fileName", F.url_decode(F.replace(F.regexp_extract("path", "([^/]*)$", 1), F.lit("+"), F.lit("%2B"))))


def in_order(files: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """``files`` of some extensions (exactly as written) by path, which ranges of a sort deal out over tasks."""
    own = F.regexp_extract("fileName", r"(\.[^./]*)$", 1)
    return (files if extensions is None else files.where(own.isin(*(f".{e}" for e in extensions)))).orderBy("path")


def extension(file_name: Column) -> Column:
    got = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(got.isin(*EXTENSIONS), got)


def content_type(file_name: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))[extension(file_name)], F.lit("application/octet-stream"))


def upload_guard(files: DataFrame) -> DataFrame:
    """``files`` (fileName, contentType, content) with reject_code, null for those that are taken."""
    kind = js_trim(F.lower(F.coalesce("contentType", F.lit(""))))
    size = F.octet_length("content")
    code = (
        F.when(size.isNull() | (size == 0), "empty_file").when(size > MAX_BYTES, "too_large").when(extension(F.col("fileName")).isNull(), "extension_not_allowed")
        .when((kind != "") & ~kind.isin(*MIME), "mime_not_allowed")
    )
    return files.withColumn("reject_code", code).withColumn("safeName", safe_file_name(F.col("fileName")))


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes without a leading byte-order mark; null if they are not UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


SHEETS = "array<struct<sheetName:string,range:string,rows:array<array<string>>>>"


#: A cell, quoted or without any quote, and what ends it.
_CELL = re.compile(r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)(,|\r\n|[\r\n]|\Z)')


def _misquoted(text: str) -> int | None:
    """Where the first cell begins that is neither quoted as a whole nor free of quotes."""
    at = 0
    while at < len(text):
        m = _CELL.match(text, at)
        if not m:
            return at
        at = m.end()
    return None


def csv_rows(text: str) -> tuple[list[list[str]], str | None]:
    """Rows of a CSV text, of any widths and without empty lines; or none, and what is wrong."""
    text = text.removeprefix("﻿")
    if '"' in text and (place := _misquoted(text)) is not None:
        return [], f"CSV parse failed: a quote at {place} neither opens nor closes a field"
    csv.field_size_limit(2**31 - 1)  # cells of any length; Python's own limit is 131 072
    try:
        return [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r], None
    except csv.Error as e:
        return [], f"CSV parse failed: {e}"


def _csv(text: Column) -> Column:
    """rows and error of each CSV text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            got = [csv_rows(t or "") for t in part]
            yield pd.DataFrame({"rows": [r for r, _ in got], "error": [e for _, e in got]})

    small_batches()
    return F.pandas_udf(run, "rows array<array<string>>, error string", F.PandasUDFType.SCALAR_ITER)(text)


def _chunk(df: DataFrame, now: str, provider: str, source_input: Column) -> DataFrame:
    """Spreadsheet chunks: docId, sheetName, range, text, title, labels and warnings are there already."""
    locator = F.struct(F.lit("spreadsheet").alias("kind"), "sheetName", "range", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("paragraphId"), F.lit(None).cast("int").alias("slide"))
    at = F.concat(F.lit("spreadsheet:"), "sheetName", F.lit(":"), "range")
    made = df.select(
        "id", "docId", F.lit(1).alias("schemaVersion"), F.lit("spreadsheet").alias("sourceType"), F.lit("table").alias("structureType"), locator.alias("locator"), F.col("fileName").alias("title"), "text",
        "sensitivity", "aiUsePolicy", F.lit("inherited").alias("sensitivitySource"), F.lit(None).cast("string").alias("sensitivityReason"), F.lit(provider).alias("extractionProvider"), "extractionWarnings",
        source_hash(at, source_input).alias("sourceHash"), F.lit(now).alias("createdAt"), F.lit(now).alias("updatedAt"),
    )
    return promote(made)


def csv_chunks(files: DataFrame, now: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """One chunk for each CSV file (docId, fileName, text, sensitivity, aiUsePolicy): its rows as a table, padded to the widest."""
    got = files.withColumn("_csv", _csv(F.col("text"))).withColumn("rows", F.col("_csv.rows"))
    width = F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0))
    made = got.withColumns({
        "id": F.concat("docId", F.lit(":csv:Sheet1")), "sheetName": F.lit("Sheet1"), "range": a1_range(F.size("rows"), width), "input": F.col("text"),
        "extractionWarnings": F.filter(F.array("_csv.error"), lambda x: x.isNotNull()),
    }).withColumn("text", markdown_table(F.col("rows")))
    return _chunk(made, now, "csv", F.col("input"))


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet_cells(root: ElementTree.Element, ns: str, shared: list[str], dates: set[int]) -> dict[tuple[int, int], str]:
    cells: dict[tuple[int, int], str] = {}
    for c in root.iter(f"{ns}c"):
        m = re.match(r"([A-Z]+)(\d+)$", c.get("r", ""))
        if not m:
            continue
        column = 0
        for ch in m[1]:
            column = column * 26 + ord(ch) - 64
        kind, v = c.get("t", "n"), c.find(f"{ns}v")
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(f"{ns}t"))
        elif v is None or v.text is None:
            continue
        elif kind == "s":
            value = shared[int(v.text)]
        elif kind == "b":
            value = "true" if v.text == "1" else "false"
        elif kind in ("str", "e"):
            value = v.text
        elif kind == "d":
            value = v.text[:10]
        elif int(c.get("s", "0")) in dates:
            value = (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(v.text))).date().isoformat()
        else:
            number = float(v.text)
            value = str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
        cells[int(m[2]), column] = value
    for merged in root.iter(f"{ns}mergeCell"):
        m = re.match(r"([A-Z]+)(\d+):([A-Z]+)(\d+)$", merged.get("ref", ""))
        if m:
            c1, c2 = (sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(x))) for x in (m[1], m[3]))
            for key in [k for k in cells if int(m[2]) <= k[0] <= int(m[4]) and c1 <= k[1] <= c2 and k != (int(m[2]), c1)]:
                cells[key] = ""
    return cells


def xlsx_sheets(content: bytes) -> list[dict]:
    """Sheets of an OOXML workbook: name, used range and its rows as text."""
    if content[:2] != b"PK":
        raise ValueError("XLSX content must be an OOXML zip package.")
    ns, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        xml = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in xml("xl/sharedStrings.xml").iter(f"{ns}si")] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{ns}numFmt") if re.search(r"[ymd]", re.sub(r"\[[^\]]*\]|\"[^\"]*\"", "", f.get("formatCode", "").lower()))}
            formats = styles.find(f"{ns}cellXfs")
            dates = {k for k, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", "0")) in own | {*range(14, 23), 45, 46, 47}}
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        out = []
        for k, sheet in enumerate(xml("xl/workbook.xml").iter(f"{ns}sheet"), 1):
            target = targets[sheet.get(f"{rel}id")]
            cells = _sheet_cells(xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), ns, shared, dates)
            name = (sheet.get("name") or "").strip() or f"Sheet{k}"
            if not cells:
                out.append({"sheetName": name, "range": "A1:A1", "rows": []})
                continue
            rows, columns = [r for r, _ in cells], [c for _, c in cells]
            r1, r2, c1, c2 = min(rows), max(rows), min(columns), max(columns)
            out.append({"sheetName": name, "range": f"{_letters(c1)}{r1}:{_letters(c2)}{r2}", "rows": [[cells.get((r, c), "") for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)]})
    return out


def xlsx_chunks(files: DataFrame, now: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """One chunk for each sheet of each workbook (docId, fileName, content, sensitivity, aiUsePolicy)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sheets=[xlsx_sheets(bytes(c)) for c in frame["content"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + f", sheets {SHEETS}"
    each = files.mapInPandas(run, schema).withColumn("many", F.size("sheets")).select("*", F.explode("sheets").alias("s"))
    table = markdown_table(F.col("s.rows"))
    made = each.withColumns({
        "sheetName": F.col("s.sheetName"), "range": F.col("s.range"), "id": F.concat("docId", F.lit(":xlsx:"), "s.sheetName", F.lit(":"), "s.range"),
        "text": F.when(table == "", F.concat(F.lit("## "), "s.sheetName")).otherwise(F.concat(F.lit("## "), "s.sheetName", F.lit("\n\n"), table)),
        "extractionWarnings": F.filter(F.array(F.when(F.col("many") > MAX_SHEETS, F.concat(F.lit("workbook has "), F.col("many").cast("string"), F.lit(f" sheets; more than {MAX_SHEETS}")))), lambda x: x.isNotNull()),
    })
    return _chunk(made, now, "xlsx", F.base64("content"))


def workbook_markdown(sheets: Column) -> Column:
    """Text of all sheets of ``SHEETS``, one after the other."""
    text = lambda s: F.when(F.size(s["rows"]) == 0, F.concat(F.lit("## "), s["sheetName"])).otherwise(F.concat(F.lit("## "), s["sheetName"], F.lit("\n\n"), markdown_table(s["rows"])))
    return F.array_join(F.transform(sheets, text), "\n\n")


def extracted(files: DataFrame, now: str = "1970-01-01T00:00:00.000Z") -> tuple[DataFrame, DataFrame]:
    """Chunks of files by their extension, and files (with error) that have no extractor or are not UTF-8."""
    from ..operators.chunking import plain_text_chunks

    kinds = files.withColumn("_ext", extension(F.col("fileName"))).withColumn("text", F.when(F.col("_ext") != "xlsx", decoded(F.col("content"))))
    bad = F.when(F.col("_ext").isNull() | (F.col("_ext") == "pdf"), "no extractor for this extension").when((F.col("_ext") != "xlsx") & F.col("text").isNull(), "not UTF-8")
    good = kinds.where(bad.isNull())
    plain = plain_text_chunks(good.where(F.col("_ext").isin("txt", "md")).withColumn("title", F.col("fileName")), now=now)
    tables = csv_chunks(good.where("_ext = 'csv'"), now).unionByName(xlsx_chunks(good.where("_ext = 'xlsx'").drop("text"), now))
    return tables.unionByName(plain, allowMissingColumns=True), kinds.withColumn("error", bad).where("error IS NOT NULL").drop("_ext", "text")
