"""Pages into blocks, and blocks into addressable, hashed chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import release, small_batches
from ..functions.invariants import MAX_CHUNK_BYTES
from ..functions.text import SPACE, canonical_locator, js_trim, source_hash

#: Fixed values.
LOCATOR = "struct<kind:string,sheetName:string,range:string,page:int,paragraphId:string,slide:int>"
CHUNK_FIELDS = (
    "docId", "schemaVersion", "sourceType", "structureType", "locator", "title", "maskedText", "sensitivity", "aiUsePolicy",
    "sensitivitySource", "sensitivityReason", "extractionProvider", "extractionWarnings", "createdAt", "updatedAt", "id", "text", "sourceHash",
)
STRUCTURE = {"paragraph": "paragraph", "heading": "paragraph", "table": "table", "image_text": "imageText"}
SOURCE_TYPE = {"official-doc-pdf": "pdf", "scan-pdf": "pdf", "slide-pdf": "slide", "office-native": "text"}
PROVIDER = {"official-doc-pdf": "pdf", "scan-pdf": "pdf", "slide-pdf": "slides", "office-native": "text"}
HEADINGS = (
    (r"^第\s*[0-9０-９一二三四五六七八九十]+\s*章", 1),
    (r"^第\s*[0-9０-９一二三四五六七八九十]+\s*節", 2),
    (r"^[0-9０-９]+\s*[.．、]\s*\S", 2),
    (r"^[（(]\s*[0-9０-９]+\s*[)）]", 3),
)
HEADING_MAX = 60


def _pick(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]


def heading_level(line: Column) -> Column:
    """Level of a short numbered line; null if it is no heading."""
    at = F.lit(None).cast("int")
    for pattern, level in reversed(HEADINGS):
        at = F.when(line.rlike(pattern), level).otherwise(at)
    return F.when(F.length(line).between(1, HEADING_MAX), at)


def page_segments(text: Column) -> Column:
    """Array of (kind, text, headingLevel): a page's paragraphs, of which single numbered lines are headings."""
    plain = F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\u00a0"), F.lit(" "))
    lines = F.transform(F.split(plain, r"\n{2,}"), lambda p: F.filter(F.transform(F.split(p, "\n"), js_trim), lambda x: x != ""))
    paras = F.filter(lines, lambda x: F.size(x) > 0)

    def made(ls: Column) -> Column:
        level = F.when(F.size(ls) == 1, heading_level(F.element_at(ls, 1)))
        return F.struct(F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("kind"), F.array_join(ls, " ").alias("text"), level.alias("headingLevel"))

    return F.transform(paras, made)


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines; if there is but one, its lines; never none."""
    cut = lambda by: F.filter(F.transform(F.split(text, by), js_trim), lambda x: x != "")
    return F.when(F.size(cut(r"\n{2,}")) > 1, cut(r"\n{2,}")).when(F.size(cut("\n")) > 0, cut("\n")).otherwise(F.array(text))


def plain_text_chunks(docs: DataFrame, text: str = "text", doc_id: str = "docId", now: str = "1970-01-01T00:00:00.000Z", keep: tuple[str, ...] = ()) -> DataFrame:
    """One paragraph chunk for each document with visible text; its hash is over the text as it came. Columns in ``keep`` are carried along."""
    locator = F.struct(F.lit("paragraph").alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in (("sheetName", "string"), ("range", "string"), ("page", "int"), ("paragraphId", "string"), ("slide", "int"))))
    body = js_trim(F.col(text))
    made = docs.withColumns({"_body": body, "locator": locator}).where(F.col("_body") != "")
    return made.select(
        F.concat(F.col(doc_id).cast("string"), F.lit(":text:paragraph")).alias("id"), F.col(doc_id).cast("string").alias("docId"), F.lit(1).alias("schemaVersion"),
        F.lit("text").alias("sourceType"), F.lit("paragraph").alias("structureType"), "locator", F.col("_body").alias("text"), *[c for c in ("title", "sensitivity", "aiUsePolicy") if c in docs.columns],
        F.lit("inherited").alias("sensitivitySource"), F.lit("text").alias("extractionProvider"), source_hash(F.lit("paragraph"), F.col(text)).alias("sourceHash"), F.lit(now).alias("createdAt"), F.lit(now).alias("updatedAt"), *keep,
    )


def ir_blocks(documents: DataFrame) -> DataFrame:
    """One row for each block of ``pages``, with its place; documents' other columns stay."""
    rest = [c for c in documents.columns if c != "pages"]
    pages = documents.select(*rest, F.posexplode("pages").alias("pageOrd", "page"))
    return pages.select(*rest, "pageOrd", F.col("page.pageNumber").alias("pageNumber"), F.posexplode("page.blocks").alias("blockOrd", "block")).select(*rest, "pageOrd", "pageNumber", "blockOrd", "block.*")


def _locator(page: Column, subtype: Column) -> Column:
    """Where a block is: by page and paragraph or table row, by slide, or not at all."""
    none = lambda t: F.lit(None).cast(t)
    make = lambda kind, page=None, para=None, slide=None: F.struct(
        F.lit(kind).alias("kind"), none("string").alias("sheetName"), none("string").alias("range"), (none("int") if page is None else page).alias("page"),
        (none("string") if para is None else para).alias("paragraphId"), (none("int") if slide is None else slide).alias("slide"),
    ).cast(LOCATOR)
    at = F.col("locator")
    para = F.when(at["tableIndex"].isNotNull() & at["rowIndex"].isNotNull(), F.concat(F.lit("table-"), at["tableIndex"].cast("string"), F.lit("-row-"), at["rowIndex"].cast("string"))).otherwise(F.col("blockId"))
    return (
        F.when(F.col("kind") == "image_text", make("imageText"))
        .when(subtype.isin("official-doc-pdf", "scan-pdf"), make("pdf", page=page, para=para))
        .when(subtype == "slide-pdf", make("slide", slide=F.coalesce(at["slideNumber"], page)))
        .otherwise(make("paragraph"))
    )


def _number(c: Column) -> Column:
    """A double as a script writes it: without .0."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _warnings() -> Column:
    level = F.coalesce(F.try_element_at(F.col("metadata"), F.lit("headingLevel")), F.lit("1"))
    box = F.col("locator")["bbox"]
    said = F.array(
        F.when(F.col("kind") == "heading", F.concat(F.lit("headingLevel="), level, F.lit(" (heading demoted to paragraph; KnowledgeChunk has no heading structureType)"))),
        F.when(box.isNotNull(), F.concat(F.lit("bbox=["), F.array_join(F.transform(F.slice(box, 1, 4), _number), ","), F.lit("] (locator schema has no bbox; preserved as warning)"))),
    )
    return F.filter(said, lambda x: x.isNotNull())


def _payload(row: dict, text: str) -> int:
    """UTF-8 bytes of a chunk as JSON, without absent fields."""
    body = {k: ({a: b for a, b in v.items() if b is not None} if isinstance(v, dict) else list(v) if hasattr(v, "tolist") else v) for k, v in row.items() if v is not None}
    return len(json.dumps(body | {"text": text}, ensure_ascii=False, separators=(",", ":")).encode())


def char_windows(piece: str, room: int, size) -> list[str]:
    """The longest prefixes that fit, one after the other; at least one character each."""
    out = []
    while piece:
        low, high = 1, len(piece)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if size(piece[:mid]) <= room else (low, mid - 1)
        out.append(piece[:low])
        piece = piece[low:]
    return out


def split_oversize(text: str, room: int, size) -> list[str]:
    """Paragraphs packed, in order and with a blank line between, into parts whose ``size`` is at most ``room``."""
    trim = lambda s: re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", s)
    if size(text) <= room:
        return [text]
    pieces = [p for p in map(trim, re.split(r"\n{2,}", text)) if p]
    if len(pieces) <= 1:
        pieces = [p for p in map(trim, text.split("\n")) if p] or [text]
    parts: list[str] = []
    now: str | None = None
    for piece in pieces:
        joined = piece if now is None else f"{now}\n\n{piece}"
        if size(joined) <= room:
            now = joined
            continue
        if now is not None:
            parts.append(now)
            now = None
        if size(piece) <= room:
            now = piece
        else:
            parts += char_windows(piece, room, size)
    return parts + ([now] if now is not None else [])


def ir_chunks(documents: DataFrame, now: str = "1970-01-01T00:00:00.000Z", most: int = MAX_CHUNK_BYTES) -> DataFrame:
    """Chunks of documents: docId, sourceSubtype, extractorInput, sensitivity, aiUsePolicy, pages and, if there, title, maskedText,
    sensitivitySource, sensitivityReason. Notes go; what is over ``most`` bytes as JSON is split along its paragraphs.

    Only blocks over the cap pass through Python.
    """
    optional = {"title": None, "maskedText": None, "sensitivitySource": "inherited", "sensitivityReason": None}
    documents = documents.withColumns({c: F.lit(v).cast("string") for c, v in optional.items() if c not in documents.columns})
    b = ir_blocks(documents).withColumn("structureType", _pick(F.col("kind"), STRUCTURE)).where(F.col("structureType").isNotNull())
    b = b.withColumns({
        "_at": _locator(F.col("pageNumber").cast("int"), F.col("sourceSubtype")), "extractionWarnings": F.when(F.size(_warnings()) > 0, _warnings()),
        "sourceType": _pick(F.col("sourceSubtype"), SOURCE_TYPE), "extractionProvider": _pick(F.col("sourceSubtype"), PROVIDER),
        "id": F.concat("docId", F.lit(":"), "blockId"), "schemaVersion": F.lit(1), "createdAt": F.lit(now), "updatedAt": F.lit(now),
    }).drop("locator").withColumnRenamed("_at", "locator")
    b = b.withColumn("sourceHash", source_hash(canonical_locator(F.col("locator")), F.col("extractorInput")))
    b = b.withColumn("bytes", F.octet_length(F.to_json(F.struct(*CHUNK_FIELDS))))
    keep = [*CHUNK_FIELDS, "pageOrd", "blockOrd"]
    fits = b.where(F.col("bytes") <= most).select(*keep, F.lit(0).alias("part"))
    return fits.unionByName(_parts(b.where(F.col("bytes") > most).select(*keep, "extractorInput"), most))


def _parts(big: DataFrame, most: int) -> DataFrame:
    """Rows of blocks over the cap, split; each part is measured with the longest suffix and note that it could bear."""
    note = lambda k, n: f"split={k}/{n} (exceeded {most}B; paragraph-aligned)"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                chunk = {k: row[k] for k in CHUNK_FIELDS if k != "text"}
                probe = dict(chunk, id=row["id"] + ":part-999", extractionWarnings=[*(row["extractionWarnings"] if row["extractionWarnings"] is not None else []), note(999, 999)])
                if row["locator"]["kind"] == "pdf":
                    probe["locator"] = dict(row["locator"], paragraphId=(row["locator"]["paragraphId"] or "") + ":part-999")
                out.append(split_oversize(row["text"], most, lambda t, probe=probe: _payload(probe, t)))
            yield frame.assign(parts=out)
        release()

    small_batches(big.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema) + ", parts array<string>"
    cut = big.mapInPandas(run, schema)
    n = F.size("parts").alias("n")
    each = cut.select("*", n, F.posexplode("parts").alias("k", "piece")).withColumn("part", F.col("k") + 1)
    tail = F.concat(F.lit(":part-"), F.col("part").cast("string"))
    para = F.when(F.col("locator.kind") == "pdf", F.concat(F.coalesce("locator.paragraphId", F.lit("")), tail)).otherwise(F.col("locator.paragraphId"))
    said = F.concat(F.lit("split="), F.col("part").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(f" (exceeded {most}B; paragraph-aligned)"))
    each = each.withColumns({
        "id": F.concat("id", tail), "text": F.col("piece"), "locator": F.col("locator").withField("paragraphId", F.regexp_replace(para, "^:", "")),
        "extractionWarnings": F.concat(F.coalesce("extractionWarnings", F.array().cast("array<string>")), F.array(said)),
    })
    return each.withColumn("sourceHash", source_hash(canonical_locator(F.col("locator")), F.col("extractorInput"))).drop("parts", "n", "k", "piece", "extractorInput")
