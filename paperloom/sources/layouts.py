"""Page layouts as blocks: text-layer pages with tables, slides, scans, Markdown with page breaks.

Reading PDF files, and the models that read slides and scans, are injected; they give the columns named here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..operators.chunking import heading_level, page_segments
from ..schemas import BLOCK, OCR_PAGES, PAGES, SLIDES


def _block(block_id, kind, text, page, slide=None, table=None, row=None, bbox=None, metadata: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    at = F.struct(page.cast("int").alias("pageNumber"), (none("int") if slide is None else slide.cast("int")).alias("slideNumber"), (none("int") if table is None else table.cast("int")).alias("tableIndex"), (none("int") if row is None else row.cast("int")).alias("rowIndex"), (none("array<double>") if bbox is None else bbox).alias("bbox"))
    return F.struct(block_id.alias("blockId"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), at.alias("locator"), (none("map<string,string>") if metadata is None else metadata).alias("metadata")).cast(BLOCK)


def _text(c: Column) -> Column:
    return c.cast("string")


def page_blocks(number: Column, text: Column, tables: Column, mark: str = "p") -> Column:
    """Blocks of one page: first the rows of its tables that hold something, then its prose; numbering runs on."""
    cells = F.flatten(F.transform(tables, lambda t, i: F.transform(t, lambda r, j: F.struct(i.alias("i"), j.alias("j"), F.transform(r, lambda c: js_trim(F.coalesce(c, F.lit("")))).alias("cells")))))
    kept = F.coalesce(F.filter(cells, lambda x: F.exists(x["cells"], lambda c: c != "")), F.array().cast("array<struct<i:int,j:int,cells:array<string>>>"))
    rows = F.transform(kept, lambda x: _block(
        F.concat(F.lit(mark), _text(number), F.lit("-t"), _text(x["i"]), F.lit("-r"), _text(x["j"])), "table", F.array_join(x["cells"], "\t"), number, table=x["i"], row=x["j"],
        metadata=F.create_map(F.lit("columnCount"), _text(F.size(x["cells"])), F.lit("isHeaderRow"), _text(x["j"] == 0)),
    ))
    prose = F.transform(page_segments(F.coalesce(text, F.lit(""))), lambda s, k: _block(
        F.concat(F.lit(mark), _text(number), F.lit("-b"), _text(F.size(kept) + k + 1)), s["kind"], s["text"], number, slide=number if mark == "s" else None,
        metadata=F.when(s["headingLevel"].isNotNull(), F.create_map(F.lit("headingLevel"), _text(s["headingLevel"]))),
    ))
    return F.concat(rows, prose)


def text_layer(pages: DataFrame, doc: str = "docId", mark: str = "p") -> DataFrame:
    """docId, pages, textContent from pages (docId, page, text, tables)."""
    one = pages.select(doc, "page", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.col("page").cast("int").alias("pageNumber"), page_blocks(F.col("page"), F.col("text"), F.col("tables"), mark).alias("blocks")).alias("p"))
    got = one.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "p", "text")), lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise(0)).alias("x"))
    return got.select(doc, F.transform("x", lambda x: x["p"]).cast(PAGES).alias("pages"), F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("textContent"))


def _visible(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: js_trim(F.coalesce(b["text"], F.lit(""))) != "")


def slides(docs: DataFrame, column: str = "slides") -> DataFrame:
    """``docs`` with pages from slides; error is set where nothing was read."""

    def page(s: Column) -> Column:
        n, title = s["slideNumber"], js_trim(F.coalesce(s["title"], F.lit("")))
        provider = lambda *more: F.create_map(*more, F.lit("extractionProvider"), F.lit("gemini-direct"))
        head = F.filter(F.array(_block(F.concat(F.lit("s"), _text(n), F.lit("-title")), "heading", title, n, slide=n, metadata=provider(F.lit("headingLevel"), F.lit("1")))), lambda b: b["text"] != "")
        body = F.transform(_visible(s["blocks"]), lambda b, k: _block(F.concat(F.lit("s"), _text(n), F.lit("-b"), _text(k + 1)), b["kind"], js_trim(b["text"]), n, slide=n, metadata=provider()))
        return F.struct(n.cast("int").alias("pageNumber"), F.concat(head, body).alias("blocks"))

    return _closed(docs.withColumn("pages", F.transform(F.col(column), page).cast(PAGES)))


def scans(docs: DataFrame, column: str = "ocr") -> DataFrame:
    """``docs`` with pages from character recognition; error is set where nothing was read. Boxes are filled up to four numbers."""

    def page(p: Column) -> Column:
        n = p["pageNumber"]
        box = lambda b: F.when(b["bbox"].isNotNull(), F.slice(F.concat(b["bbox"], F.array_repeat(F.lit(0.0), 4)), 1, 4))
        meta = lambda b: F.map_filter(F.create_map(F.lit("extractionProvider"), F.lit("gemini-vertex-ocr"), F.lit("ocrConfidence"), _text(b["confidence"])), lambda k, v: v.isNotNull())
        body = F.transform(_visible(p["blocks"]), lambda b, k: _block(F.concat(F.lit("p"), _text(n), F.lit("-ocr"), _text(k + 1)), b["kind"], js_trim(b["text"]), n, bbox=box(b), metadata=meta(b)))
        return F.struct(n.cast("int").alias("pageNumber"), body.alias("blocks"))

    return _closed(docs.withColumn("pages", F.transform(F.col(column), page).cast(PAGES)))


def _closed(docs: DataFrame) -> DataFrame:
    none = (F.coalesce(F.size("pages"), F.lit(0)) <= 0) | ~F.exists("pages", lambda p: F.size(p["blocks"]) > 0)
    text = F.array_join(F.transform("pages", lambda p: F.array_join(F.transform(p["blocks"], lambda b: b["text"]), "\n")), "\n")
    return docs.withColumns({"error": F.when(F.coalesce(none, F.lit(True)), "extraction gave no visible text"), "textContent": text})


def model_json(answer: Column, schema: str) -> Column:
    """A model's answer as a struct: as it is, without its code fence, or the outermost braces; null if none parses."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    parse = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull() & js_trim(c).startswith("{"), F.from_json(c, schema))
    return F.coalesce(parse(answer), parse(fenced), parse(bare))


def read_slides(docs: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``model`` is injected and adds ``answer``, its text."""
    return slides(model(docs).withColumn("slides", model_json(F.col("answer"), f"slides {SLIDES}")["slides"]))


def read_scans(docs: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return scans(model(docs).withColumn("ocr", model_json(F.col("answer"), f"pages {OCR_PAGES}")["pages"]))


def markdown_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pages from Markdown: form feeds part pages, # makes headings, pipe tables give a block for each row.

    Empty pages go, but one stays; page numbers are those before that.
    """
    lines = F.transform(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\f"), lambda p, k: F.struct((k + 1).alias("n"), F.split(p, "\n").alias("lines")))

    def page(p: Column) -> Column:
        table = lambda x: js_trim(x).rlike(r"^\|.*\|$")
        rule = lambda x: js_trim(x).rlike(r"^\|(\s*:?-+:?\s*\|)+$")
        heads = lambda x: js_trim(x).rlike(r"^#{1,6}\s+\S")
        start = F.struct(F.array().cast("array<struct<kind:string,text:string,level:int>>").alias("done"), F.array().cast("array<string>").alias("held"))
        flush = lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(_prose(a["held"])))).otherwise(a["done"])
        fresh = F.array().cast("array<string>")

        def step(a: Column, x: Column) -> Column:
            t = js_trim(x)
            cells = F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_replace(t, r"^\|", ""), r"\|$", ""), r"\|"), js_trim), "\t")
            one = F.when(heads(x), F.struct(F.lit("heading").alias("kind"), js_trim(F.regexp_replace(t, "^#+", "")).alias("text"), F.length(F.regexp_extract(t, "^(#+)", 1)).alias("level"))).when(table(x), F.struct(F.lit("table").alias("kind"), cells.alias("text"), F.lit(None).cast("int").alias("level")))
            return (
                F.when(rule(x), F.struct(flush(a).alias("done"), fresh.alias("held")))
                .when(one.isNotNull(), F.struct(F.concat(flush(a), F.array(one)).alias("done"), fresh.alias("held")))
                .when(t == "", F.struct(flush(a).alias("done"), fresh.alias("held")))
                .otherwise(F.struct(a["done"].alias("done"), F.concat(a["held"], F.array(t)).alias("held")))
            )

        return F.struct(p["n"].alias("n"), F.aggregate(p["lines"], start, step, flush).alias("segments"))

    made = F.transform(lines, page)
    full = F.filter(made, lambda p: F.size(p["segments"]) > 0)
    kept = F.when(F.size(full) > 0, full).otherwise(F.slice(made, 1, 1))

    def blocks(p: Column) -> Column:
        body = F.transform(p["segments"], lambda s, k: _block(F.concat(F.lit("p"), _text(p["n"]), F.lit("-b"), _text(k + 1)), s["kind"], s["text"], p["n"], metadata=F.when(s["level"].isNotNull(), F.create_map(F.lit("headingLevel"), _text(s["level"])))))
        return F.struct(p["n"].alias("pageNumber"), body.alias("blocks"))

    return docs.withColumn("pages", F.transform(kept, blocks).cast(PAGES))


def _prose(lines: Column) -> Column:
    level = F.when(F.size(lines) == 1, heading_level(F.element_at(lines, 1)))
    return F.struct(F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("kind"), F.array_join(lines, " ").alias("text"), level.alias("level"))
