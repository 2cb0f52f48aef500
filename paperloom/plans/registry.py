"""The registered queries of the document-preparation operators, their SQL, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, packages
from . import states, stored  # noqa: F401  (they register their queries)
from .queries import QUERIES, SQL, labelled

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, labelled, chunked, masked and gated: how many chunks a package would include and hold back, by reason."""
    from ..functions.masking import mask_chunks

    chunks = mask_chunks(chunking.plain_text_chunks(labelled(spark, sf_dir)))
    return packages.gated(chunks).groupBy("aiUsePolicy", F.coalesce("gateReason", F.lit("passed")).alias("gate")).agg(F.count("*").alias("chunks"), F.sum(F.coalesce("maskedSpansCount", F.lit(0))).alias("masked_spans"))
