"""Text functions as columns. White space, trimming and lengths follow ECMAScript, which the data's producers use."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import small_batches

#: White space of ECMAScript, as the inside of a Java character class.
SPACE = r"\t\n\x0B\f\r    -     　﻿"
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word boundary over ASCII words. Java's own counts letters of all scripts.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Fixed values.
HASH_PREFIX = "KNOWLEDGE_CHUNK_SOURCE_HASH_V1"
MAX_FILE_NAME, MAX_BASE_NAME, MAX_ERROR, MAX_PROMPT_BODY, MAX_SLUG = 200, 195, 8000, 1200, 30


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(js_trim(c) == "", F.lit(True))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def nfkc(c: Column) -> Column:
    """Compatibility forms unified; there is no built-in function for it."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    small_batches()
    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(c)


def semantic_key(c: Column) -> Column:
    """For matching of fields in a corpus: compatibility forms unified, all white space gone."""
    return F.regexp_replace(nfkc(c), f"[{SPACE}]+", "")


def safe_file_name(c: Column) -> Column:
    name = js_trim(F.replace(F.translate(c, "/\\", "__"), F.lit("\0"), F.lit("")))
    return F.left(F.when(name == "", "file.txt").otherwise(name), F.lit(MAX_FILE_NAME))


def workspace_file_name(c: Column, extension: str, fallback: str = "workspace-import") -> Column:
    """The name without ``extension`` (in any case) and trailing dots, shortened, with ``extension`` again."""
    base = js_trim(F.regexp_replace(safe_file_name(c), rf"(?i){extension.replace('.', chr(92) + '.')}$", ""))
    base = F.left(js_trim(F.regexp_replace(base, r"\.+$", "")), F.lit(MAX_BASE_NAME))
    return F.concat(F.when(base == "", fallback).otherwise(base), F.lit(extension))


def excel_column(n: Column) -> Column:
    """1 is A, 27 is AA."""
    letter = lambda k: F.char((F.lit(65) + k).cast("int"))
    one = F.pmod(n - 1, F.lit(26))
    up = F.floor((n - 1) / 26)
    two = F.pmod(up - 1, F.lit(26))
    top = F.floor((up - 1) / 26)
    return F.concat(F.when(top > 0, letter(F.pmod(top - 1, F.lit(26)))).otherwise(""), F.when(up > 0, letter(two)).otherwise(""), letter(one))


def a1_range(rows: Column, columns: Column) -> Column:
    """A1:<last column><last row>; at least one of each."""
    return F.concat(F.lit("A1:"), excel_column(F.greatest(columns, F.lit(1))), F.greatest(rows, F.lit(1)).cast("string"))


def column_number(letters: Column) -> Column:
    """A is 1, AA is 27."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def parsed_range(c: Column) -> Column:
    """first_column, first_row, last_column, last_row of an A1 range; null if it is none."""
    part = lambda k: F.regexp_extract(c, r"^([A-Z]+)(\d+):([A-Z]+)(\d+)$", k)
    made = F.struct(column_number(part(1)).alias("first_column"), F.try_to_number(part(2), F.lit("9999999")).cast("bigint").alias("first_row"), column_number(part(3)).alias("last_column"), F.try_to_number(part(4), F.lit("9999999")).cast("bigint").alias("last_row"))
    return F.when(c.rlike(r"^[A-Z]+\d+:[A-Z]+\d+$"), made)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r|\n", " "), F.lit("|"), F.lit("｜"))


def markdown_table(rows: Column) -> Column:
    """Array of arrays of cells: the first is the header; all are padded to the widest."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: line(F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), markdown_cell)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, 1 << 30)), "\n"))


def canonical_locator(locator: Column) -> Column:
    f = lambda n: F.coalesce(locator[n].cast("string"), F.lit(""))
    return (
        F.when(locator["kind"] == "spreadsheet", F.concat(F.lit("spreadsheet:"), f("sheetName"), F.lit(":"), f("range")))
        .when(locator["kind"] == "pdf", F.concat(F.lit("pdf:"), f("page"), F.lit(":"), f("paragraphId")))
        .when(locator["kind"] == "slide", F.concat(F.lit("slide:"), f("slide")))
        .otherwise(locator["kind"])
    )


def source_hash(locator_text: Column, extractor_input: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(HASH_PREFIX), locator_text, extractor_input).cast("binary"), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def json_bytes(row: Column) -> Column:
    """UTF-8 bytes of a struct as JSON; absent fields (nulls) take none."""
    return F.octet_length(F.to_json(row))


def purpose_normalized(c: Column) -> Column:
    return F.lower(F.regexp_replace(js_trim(c), f"[{SPACE}]+", " "))


def purpose_binding(purpose: Column, tenant: Column, timestamp: Column, version: int = 1) -> Column:
    """A digest that binds a purpose to its tenant and time without telling it."""
    said = F.to_json(F.struct(F.lit(version).alias("version"), purpose_normalized(purpose).alias("purpose"), tenant.alias("tenantId"), timestamp.alias("timestamp")))
    return F.concat(F.lit("pb_sha256_"), F.sha2(said.cast("binary"), 256))


def shortened(c: Column, most: int = MAX_ERROR, mark: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(c)


def prompt_body(text: Column, masked: Column) -> Column:
    return shortened(F.coalesce(masked, text), MAX_PROMPT_BODY, "…(truncated)")


def eval_id(doc_id: Column, revision: Column) -> Column:
    return F.concat_ws(":", doc_id, revision)


def eval_id_parts(c: Column) -> Column:
    """doc_id and revision, divided at the last colon; null if there is none."""
    return F.when(c.rlike("(?s)^.+:[^:]+$"), F.struct(F.regexp_extract(c, "(?s)^(.*):([^:]+)$", 1).alias("doc_id"), F.regexp_extract(c, "(?s)^(.*):([^:]+)$", 2).alias("revision")))


def sortable_id(millis: Column, tail: Column) -> Column:
    """Ids that sort by time: nine base-36 digits of the milliseconds, then 16 hexadecimal ones."""
    return F.concat(F.lpad(F.lower(F.conv(millis.cast("string"), 10, 36)), 9, "0"), F.lit("-"), F.left(tail, F.lit(16)))


def slug(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "_"), F.lit(MAX_SLUG))


def my_number_check_digit(digits: Column) -> Column:
    """Twelfth digit for the first eleven: weights 2 to 7 from the right, modulo 11."""
    given = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(F.reverse(given), lambda d, k: d * F.when(k < 6, k + 2).otherwise(k - 4)), F.lit(0), lambda a, x: a + x)
    rest = F.pmod(total, F.lit(11))
    return F.when(F.length(digits) == 11, F.when(rest <= 1, 0).otherwise(11 - rest))


def iso_millis(ts: Column) -> Column:
    """2024-01-01T00:00:00.000Z, in the session's time zone (UTC in this library)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def tokyo_time(ts: Column) -> Column:
    """Package timestamps: 2024/01/01 09:00 JST of an UTC time."""
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "Asia/Tokyo"), "yyyy/MM/dd HH:mm"), F.lit(" JST"))


def tenant_normalized(c: Column) -> Column:
    """Lower-case; all but letters, digits, dot and hyphen become one hyphen; one goes from each end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(js_trim(c)), r"[^a-z0-9.-]", "-"), "-+", "-"), "^-|-$", "")


def tenant_of_email(email: Column, override: Column | None = None) -> Column:
    """Null if the address has no domain that can be one."""
    own = F.nullif(tenant_normalized(js_trim(F.coalesce(F.try_element_at(F.split(email, "@"), F.lit(2)), F.lit("")))), F.lit(""))
    return own if override is None else F.when(~is_blank(override), F.nullif(tenant_normalized(override), F.lit(""))).otherwise(own)


def proxy_email(header: Column) -> Column:
    """The address in an identity proxy's header, after its last colon; null if it is none."""
    email = F.lower(js_trim(F.substring_index(js_trim(header), ":", -1)))
    return F.when(email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), email)


def client_address(forwarded: Column, real: Column) -> Column:
    first = F.nullif(js_trim(F.coalesce(F.element_at(F.split(forwarded, ","), 1), F.lit(""))), F.lit(""))
    return F.coalesce(first, F.nullif(js_trim(real), F.lit("")), F.lit("unknown"))


def utf16_index(text: Column, byte_offset: Column) -> Column:
    """Place in UTF-16 units of a byte offset in UTF-8."""

    def run(texts: pd.Series, offsets: pd.Series) -> pd.Series:
        place = lambda t, o: None if t is None or o is None else len(t.encode()[: int(o)].decode("utf-8", "ignore").encode("utf-16-le")) // 2
        return pd.Series([place(t, o) for t, o in zip(texts, offsets, strict=True)], dtype="Int64")

    small_batches()
    return F.pandas_udf(run, "bigint", F.PandasUDFType.SCALAR)(text, byte_offset)
