"""Tolerant reading of stored rows and of models' answers: what does not fit is counted or listed, and stops nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim

EPOCH = "1970-01-01T00:00:00.000Z"
#: Fixed values of the data model.
SENSITIVITIES, POLICIES = ("Public", "Internal", "Confidential", "Restricted"), ("direct", "requires_masking", "blocked")
REQUIRED = ("docId", "sourceType", "structureType", "text", "sensitivity", "aiUsePolicy", "sourceHash")
CHUNK = """id string, docId string, schemaVersion int, sourceType string, structureType string, locator struct<kind:string,sheetName:string,range:string,page:int,paragraphId:string,slide:int>,
title string, text string, maskedText string, sensitivity string, aiUsePolicy string, sensitivityReason string, sensitivitySource string, extractionProvider string, extractionWarnings array<string>,
maskedSpansCount int, ruleHits map<string,bigint>, sourceHash string, createdAt string, updatedAt string"""


def _readable(said: Column) -> Column:
    """Whether a text is one JSON value; Spark's parser stops behind an object, whatever follows."""
    trimmed = js_trim(said)
    return F.coalesce(F.try_parse_json(F.nullif(trimmed, F.lit(""))).isNotNull() & (~trimmed.startswith("{") | trimmed.endswith("}")), F.lit(False))


def stored_chunks(rows: DataFrame, schema: str = CHUNK) -> DataFrame:
    """``rows`` (id, data: a stored row as JSON) with ``chunk`` and, where it does not fit, ``problem``.

    A chunk without an id has its row's; missing times are the epoch. A field of another type makes the row malformed, as
    does a missing one that is required or a label that is not known.
    """
    parsed = F.from_json("data", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    c = F.col("c")
    got = rows.withColumn("c", parsed)
    time = lambda n: F.coalesce(F.nullif(c[n], F.lit("")), F.lit(EPOCH))
    got = got.withColumn("c", c.withField("id", F.coalesce(c["id"], "id")).withField("createdAt", time("createdAt")).withField("updatedAt", time("updatedAt")))
    lacks = F.filter(F.array(*(F.when(c[n].isNull(), F.lit(n)) for n in REQUIRED)), lambda n: n.isNotNull())
    problem = (
        F.when(~_readable(F.col("data")) | ~js_trim(F.col("data")).startswith("{"), "not a JSON object")
        .when(c["_bad"].isNotNull(), "a field has another type")
        .when(F.size(lacks) > 0, F.concat(F.lit("required: "), F.array_join(lacks, ", ")))
        .when(~c["sensitivity"].isin(*SENSITIVITIES), F.concat(F.lit("unknown sensitivity "), c["sensitivity"]))
        .when(~c["aiUsePolicy"].isin(*POLICIES), F.concat(F.lit("unknown aiUsePolicy "), c["aiUsePolicy"]))
    )
    return got.withColumn("problem", problem).withColumn("chunk", F.when(F.col("problem").isNull(), c.dropFields("_bad"))).drop("c")


def listed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of stored rows, and how many were skipped by document and problem."""
    read = stored_chunks(rows)
    return read.where("problem IS NULL").select("chunk.*"), read.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("skipped"))


ATTEMPT = "struct<kind:string,error:string>"


def attempts(answers: list[tuple[str, Column, bool]], schema: str, invalid) -> Column:
    """Struct of ``value``, the first answer that is valid, and ``attempts``, why those before it were not, in order.

    ``answers`` are (kind, text, whether it is a model's free text that must be parsed, fenced or not). ``invalid`` gives for
    a parsed struct what is wrong with it, or null. A missing free text is no attempt; all answers are tried in their order
    and none after the valid one counts.
    """
    tried = []
    for kind, said, free in answers:
        trimmed = js_trim(said)
        raw = F.when(trimmed.rlike(r"(?sm)^```(?:json)?\s*(.*?)```$"), js_trim(F.regexp_extract(trimmed, r"(?sm)^```(?:json)?\s*(.*?)```$", 1))).otherwise(trimmed) if free else said
        readable = _readable(raw)
        value = F.when(readable, F.from_json(raw, schema))
        error = F.when(~readable, F.lit("not JSON" if free else "no output")).otherwise(invalid(value))
        name = F.when(~readable, F.lit(f"{kind} (JSON.parse)")).otherwise(F.lit(kind)) if free else F.lit(kind)
        skipped = F.coalesce(trimmed == "", F.lit(True)) if free else F.lit(False)
        tried.append(F.struct(skipped.alias("skipped"), name.alias("kind"), error.alias("error"), F.when(error.isNull() & ~skipped, value).alias("value")))
    made = F.filter(F.array(*tried), lambda t: ~t["skipped"])
    good = F.array_position(F.transform(made, lambda t: t["value"].isNotNull()), True)
    before = F.when(good > 0, F.slice(made, F.lit(1), F.greatest(good - 1, F.lit(0)).cast("int"))).otherwise(made)
    return F.struct(F.when(good > 0, F.try_element_at(made, good.cast("int"))["value"]).alias("value"), F.transform(before, lambda t: F.struct(t["kind"].alias("kind"), t["error"].alias("error"))).alias("attempts"))


def attempt_message(label: str, tried: Column) -> Column:
    """What is said where no answer was valid."""
    lines = F.array_join(F.transform(tried["attempts"], lambda a: F.concat(a["kind"], F.lit(": "), a["error"])), "\n")
    return F.when(tried["value"].isNull(), F.concat(F.lit(f"{label}: no valid answer\n"), lines))
