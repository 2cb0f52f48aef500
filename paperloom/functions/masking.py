"""Rule-based masking of personal data: finding spans, choosing among them, replacing and counting.

The search for spans needs Python (positions of all matches have no built-in), and so do choosing and replacing (as
higher-order functions their work grows with the square of a text's matches); all run on Arrow batches, in one go.
Counting is higher-order functions on the chosen spans.
"""

from __future__ import annotations

import io
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import release, small_batches
from .text import is_blank

_S = r"[\t\n\x0B\f\r    -     　﻿]"
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Fixed values, in order: rule, type, pattern, flags, group that is masked. All matches of a rule count.
RULES = (
    ("email", "EMAIL", rf"{_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_B}", 0, 0),
    ("phone_like", "PHONE", rf"{_B}[0-9]{{2,4}}-[0-9Xx]{{2,4}}-[0-9Xx]{{4}}{_B}", 0, 0),
    ("postal_hyphen", "POSTAL_CODE", rf"〒?{_S}*[0-9]{{3}}-[0-9]{{4}}{_B}", 0, 0),
    ("mynumber_12", "JP_MYNUMBER", r"(?<![0-9])[0-9]{12}(?![0-9])", 0, 0),
    ("bank_account_full", "BANK_ACCOUNT", rf"(?:普通|当座){_S}*[0-9]{{7}}(?:[ 　]+[゠-ヿー\-・]{{2,}})?|[0-9]{{7}}[ 　]+[゠-ヿー\-・]{{2,}}", 0, 0),
    ("amount_jpy", "AMOUNT_JPY", rf"(?:^|[\t\n\x0B\f\r    -     　﻿「『])(?:月額|金額|額|振込)?{_S}*([0-9,]+円(?:（[^）]*）)?)", re.M, 1),
    ("label_party", "COMPANY_NAME_HINT", rf"(?:甲|乙)[:：]{_S}*[^\n\r]+", 0, 0),
    ("label_daihyo_long", "PERSON_NAME_HINT", rf"代表取締役{_S}+[^\n\r]{{1,120}}", 0, 0),
    ("label_daihyo_short", "PERSON_NAME_HINT", rf"(?<!代表取締役{_S})(?:代表者|代表){_S}+[^\n\r]{{1,120}}", 0, 0),
    ("label_tanto_line", "PERSON_NAME_HINT", rf"(?:甲側|乙側)?担当[:：]{_S}*[^\n\r]+", 0, 0),
    ("label_shimei", "PERSON_NAME_HINT", rf"氏名[:：]{_S}*[^\n\r]+", 0, 0),
    ("label_company_name", "COMPANY_NAME_HINT", rf"会社名[:：]{_S}*[^\n\r]+", 0, 0),
)
#: What a text must hold for a rule to match at all; most texts hold none of it, and a look costs far less than a search.
NEEDS = {
    "email": "@", "phone_like": "-", "postal_hyphen": "-", "mynumber_12": re.compile("[0-9]{12}"), "bank_account_full": re.compile("[0-9]{7}"), "amount_jpy": "円", "label_party": re.compile("[甲乙][:：]"),
    "label_daihyo_long": "代表取締役", "label_daihyo_short": "代表", "label_tanto_line": "担当", "label_shimei": "氏名", "label_company_name": "会社名",
}
SPANS = "array<struct<start:int,end:int,type:string,ruleId:string,rule:int>>"
REDACTED = "struct<spans:array<struct<start:int,end:int,type:string,ruleId:string>>,masked:string>"


#: Spans in a batch of results; a text with more has a batch of its own.
MOST_SPANS = 1 << 16


def found_spans(batches: Iterator[pa.Array], rules=RULES) -> Iterator[pa.Array]:
    """All matches of each text as a list of SPANS. They are kept as numbers, not as objects, and handed on from MOST_SPANS on:
    texts may consist of nothing but matches."""
    made = [(k, re.compile(p, flags), group, NEEDS.get(rule, "")) for k, (rule, _, p, flags, group) in enumerate(rules)]
    kinds, ids = (pa.array([r[n] for r in rules], pa.string()) for n in (1, 0))
    for texts in batches:
        starts, ends, which, offsets, nulls = array("i"), array("i"), array("i"), array("i", [0]), []
        for n, text in enumerate((t.as_py() for t in texts), 1):
            for k, pattern, group, need in made if text else ():
                if not (need in text if isinstance(need, str) else need.search(text)):
                    continue
                for m in pattern.finditer(text):
                    if m.end(group) > m.start(group):
                        starts.append(m.start(group))
                        ends.append(m.end(group))
                        which.append(k)
            offsets.append(len(starts))
            nulls.append(text is None)
            if len(starts) >= MOST_SPANS or n == len(texts):
                start, end, rule, at = (pa.array(np.asarray(x, np.int32)) for x in (starts, ends, which, offsets))
                each = pa.StructArray.from_arrays([start, end, kinds.take(rule), ids.take(rule), rule], ["start", "end", "type", "ruleId", "rule"])
                yield pa.ListArray.from_arrays(at, each, mask=pa.array(nulls, pa.bool_()))
                starts, ends, which, offsets, nulls = array("i"), array("i"), array("i"), array("i", [0]), []


def finder(rules=RULES) -> Callable[[Column], Column]:
    """All matches of all rules, overlaps and all; places count code points."""

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from found_spans(batches, rules)
        release()

    def found(c: Column) -> Column:
        small_batches()
        return F.arrow_udf(spans, SPANS, F.ArrowUDFType.SCALAR_ITER)(c)

    return found


def _ranks(names: pa.Array) -> np.ndarray:
    """Numbers that sort as the names do."""
    coded = names.dictionary_encode("encode")
    return pc.rank(coded.dictionary, null_placement="at_start", tiebreaker="dense").to_numpy()[coded.indices.to_numpy()]


def chosen(row: np.ndarray, each: pa.StructArray) -> np.ndarray:
    """Places of the spans that stay, in order of ``row``. Earliest first, then longest, then by order of rules; a span that
    overlaps a chosen one goes. Touching ones stay."""
    start, end, rule = (each.field(n).to_numpy() for n in ("start", "end", "rule"))
    order = np.lexsort((_ranks(each.field("ruleId")), _ranks(each.field("type")), rule, -end, start, row))
    base = row[order].astype(np.int64) << 32
    after, kept, n = memoryview(np.searchsorted(base + start[order], base + end[order])), array("q"), 0
    while n < len(order):
        kept.append(n)
        n = max(n + 1, after[n])
    return order[np.asarray(kept)]


def settled(texts: pa.Array, found: pa.ListArray) -> pa.StructArray:
    """REDACTED of each text and what was found in it: the chosen spans, and the text with [REDACTED:TYPE] for each of them (null
    where there are none). The work grows with the texts and with the spans (but for sorting them)."""
    each = found.flatten()
    row = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    kept = chosen(row, each)
    each = each.take(pa.array(kept))
    offsets = np.searchsorted(row[kept], np.arange(len(found) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([each.field(n) for n in ("start", "end", "type", "ruleId")], ["start", "end", "type", "ruleId"])
    kinds = each.field("type").dictionary_encode()
    tokens, kind, starts, ends = [f"[REDACTED:{t}]" for t in kinds.dictionary.to_pylist()], *(memoryview(x.to_numpy()) for x in (kinds.indices, each.field("start"), each.field("end")))
    masked = [None] * len(found)
    for n in np.flatnonzero(np.diff(offsets)).tolist():
        text, out, at = texts[n].as_py(), io.StringIO(), 0
        for k in range(offsets[n], offsets[n + 1]) if text is not None else ():
            out.write(text[at : starts[k]])
            out.write(tokens[kind[k]])
            at = ends[k]
        if text is not None:
            out.write(text[at:])
            masked[n] = out.getvalue()
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), spans, mask=found.is_null()), pa.array(masked, pa.string())], ["spans", "masked"])


def redacted_texts(batches: Iterator[pa.Array], rules=RULES) -> Iterator[pa.Array]:
    """REDACTED of each text, handed on in the parts of found_spans."""
    for texts in batches:
        done = 0
        for found in found_spans(iter([texts]), rules):
            yield settled(texts.slice(done, len(found)), found)
            done += len(found)


def redactor(rules=RULES) -> Callable[[Column], Column]:
    """REDACTED of a text by all rules; one Python worker a task finds, chooses and replaces."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from redacted_texts(batches, rules)
        release()

    def made(c: Column) -> Column:
        small_batches()
        return F.arrow_udf(run, REDACTED, F.ArrowUDFType.SCALAR_ITER)(c)

    return made


def redacted(text: Column, spans: Column) -> Column:
    """REDACTED of a text by SPANS that were found elsewhere."""
    small_batches()
    return F.arrow_udf(settled, REDACTED, F.ArrowUDFType.SCALAR)(text, spans)


def non_overlapping(spans: Column) -> Column:
    """The chosen ones of SPANS."""
    return redacted(F.lit(None).cast("string"), spans)["spans"]


def masked_text(text: Column, done: Column) -> Column:
    """``text`` after REDACTED: most texts hold nothing to mask and do not come back from Python."""
    return F.coalesce(done["masked"], text)


def rule_hits(spans: Column) -> Column:
    """Map of rule to number of chosen spans."""
    ids = F.transform(spans, lambda s: s["ruleId"])
    return F.map_from_entries(F.transform(F.array_distinct(ids), lambda r: F.struct(r, F.size(F.filter(ids, lambda x: x == r)).cast("bigint"))))


def simple_rule(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with maskedContent, maskedSpans, ruleHits and provider."""
    return _with_result(df.withColumn("_done", redactor()(F.col(text))), text, "simple-rule")


def _with_result(df: DataFrame, text: str, provider: str) -> DataFrame:
    got = df.withColumn("maskedSpans", F.col("_done")["spans"]).withColumn("maskedContent", masked_text(F.col(text), F.col("_done")))
    return got.withColumns({"ruleHits": rule_hits(F.col("maskedSpans")), "provider": F.lit(provider)}).drop("_done")


def inspected(inspect: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], DataFrame]:
    """Provider around an injected inspection: it adds ``findings`` (start, end in UTF-8 bytes, infoType) to rows."""

    def provider(df: DataFrame, text: str = "text") -> DataFrame:
        #: Information type, span type.
        types = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "JAPAN_INDIVIDUAL_NUMBER": "JP_MYNUMBER", "JAPAN_BANK_ACCOUNT": "BANK_ACCOUNT", "PERSON_NAME": "PERSON_NAME_HINT"}
        kind = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
        got = inspect(df).withColumn("_found", _places(F.col(text), F.col("findings")))
        named = F.transform("_found", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.coalesce(kind[f["infoType"]], F.lit("CUSTOM_RULE")).alias("type"), F.concat(F.lit("dlp:"), f["infoType"]).alias("ruleId"), F.lit(0).alias("rule")))
        got = got.withColumn("_done", redacted(F.col(text), F.filter(named, lambda s: s["start"].isNotNull() & (s["start"] < s["end"])))).drop("_found", "findings")
        return _with_result(got, text, "cloud-dlp")

    return provider


def _places(text: Column, findings: Column) -> Column:
    """Byte ranges as ranges of code points; ones that leave the text are null."""

    def one(t, fs):
        raw = (t or "").encode()
        place = lambda o: len(raw[: int(o)].decode("utf-8", "ignore")) if o is not None and 0 <= o <= len(raw) else None
        return [{"start": place(f["start"]), "end": place(f["end"]), "infoType": f["infoType"]} for f in (fs if fs is not None else [])]

    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)])

    small_batches()
    return F.pandas_udf(run, "array<struct<start:int,end:int,infoType:string>>", F.PandasUDFType.SCALAR)(text, findings)


PROVIDERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"simple-rule": simple_rule}


def provider(name: str = "simple-rule", more: dict[str, Callable[[DataFrame, str], DataFrame]] | None = None) -> Callable[[DataFrame, str], DataFrame]:
    known = PROVIDERS | (more or {})
    if name not in known:
        raise ValueError(f"unknown masking provider: {name}")
    return known[name]


def mask_chunks(chunks: DataFrame, mask: Callable[[DataFrame, str], DataFrame] = simple_rule) -> DataFrame:
    """maskedText, maskedSpansCount and ruleHits for chunks that need masking; others pass as they are."""
    needs = F.coalesce(F.col("aiUsePolicy") == "requires_masking", F.lit(False))
    added = {"maskedText": "string", "maskedSpansCount": "int", "ruleHits": "map<string,bigint>"}
    base = chunks.withColumns({c: F.lit(None).cast(t) for c, t in added.items() if c not in chunks.columns})
    done = mask(base.where(needs).drop("ruleHits", "maskedText", "maskedSpansCount"), "text")
    done = done.withColumnRenamed("maskedContent", "maskedText").withColumn("maskedSpansCount", F.size("maskedSpans"))
    return base.where(~needs).unionByName(done.select(*base.columns))


def masking_pipeline(docs: DataFrame, risk: Callable[[DataFrame], DataFrame], mask: Callable[[DataFrame, str], DataFrame] = simple_rule) -> tuple[DataFrame, DataFrame]:
    """Masked documents with their decision, and documents that must not come here (policy is not requires_masking).

    ``risk`` is injected: it adds detected, reasons, recommendedSensitivity and rationale to rows with maskedContent.
    """
    fit = F.coalesce(F.col("aiUsePolicy") == "requires_masking", F.lit(False))
    done = risk(mask(docs.where(fit), "text"))
    decided = done.withColumn("decision", F.when(F.col("recommendedSensitivity") == "Restricted", "restricted_promoted").otherwise("ai_safe_ready"))
    return decided, docs.where(~fit).withColumn("error", F.concat(F.lit("masking pipeline requires aiUsePolicy=requires_masking; got "), F.coalesce("aiUsePolicy", F.lit("null"))))


def no_masked_body(masked: Column) -> Column:
    return is_blank(masked)
