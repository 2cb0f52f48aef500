"""Column rules: table headers that make their chunk more sensitive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import rank_of
from ..functions.text import js_trim, nfkc

#: Exact headers, parts of headers, sensitivity, policy, reason.
RULES = (
    (("顧客名", "氏名", "担当者"), ("顧客", "氏名", "担当"), "Confidential", "requires_masking", "列ヘッダが顧客名/氏名/担当者を示すため"),
    (("メール", "Email"), ("メール", "email", "e-mail"), "Confidential", "requires_masking", "列ヘッダがメールアドレス情報を示すため"),
    (("電話番号", "Tel"), ("電話", "tel", "phone"), "Confidential", "requires_masking", "列ヘッダが電話番号情報を示すため"),
    (("住所",), ("住所", "所在地", "address"), "Confidential", "requires_masking", "列ヘッダが住所情報を示すため"),
    (("個別金額", "単価", "報酬"), ("金額", "単価", "報酬", "fee", "price"), "Confidential", "requires_masking", "列ヘッダが個別金額/単価/報酬を示すため"),
)


def _cells(line: Column) -> Column:
    """Non-empty cells of a pipe row; none if it has no pipe."""
    bare = F.regexp_replace(F.regexp_replace(js_trim(line), r"^\|", ""), r"\|$", "")
    return F.when(line.contains("|"), F.filter(F.transform(F.split(bare, r"\|"), js_trim), lambda c: c != "")).otherwise(F.array().cast("array<string>"))


def table_header(text: Column) -> Column:
    """Header cells of the first pipe table: a row followed by a rule of as many cells; empty if there is none."""
    rows = F.transform(F.split(text, r"\r?\n"), _cells)
    pairs = F.arrays_zip(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))).alias("head"), F.slice(rows, 2, 1 << 30).alias("rule"))
    fit = F.filter(pairs, lambda p: (F.size(p["head"]) > 0) & (F.size(p["head"]) == F.size(p["rule"])) & F.forall(p["rule"], lambda c: c.rlike("^:?-{3,}:?$")))
    return F.coalesce(F.try_element_at(fit, F.lit(1))["head"], F.array().cast("array<string>"))


def normalized(cells: Column) -> Column:
    """Compatibility forms unified, lower-case; joined for the one call that needs Python."""
    joined = nfkc(F.array_join(F.transform(cells, js_trim), "\u0001"))
    return F.transform(F.split(F.lower(joined), "\u0001"), js_trim)


def matched_rule(headers: Column, rules=RULES) -> Column:
    """Number (from 0) of the strictest matching rule, the first on ties; null if none matches."""
    low = lambda xs: [x.lower() for x in xs]
    ranks = {"Public": 0, "Internal": 1, "Confidential": 2, "Restricted": 3}
    at = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (ranks[rules[k][2]], -k)):
        exact, part = low(rules[k][0]), [x for x in low(rules[k][1]) if x]
        at = F.when(F.exists(headers, _matcher(exact, part)), k).otherwise(at)
    return at


def _matcher(exact: list[str], part: list[str]):
    def hit(header: Column) -> Column:
        out = header.isin(*exact)
        for x in part:
            out = out | header.contains(x)
        return out

    return hit


def promote(chunks: DataFrame, rules=RULES) -> DataFrame:
    """``chunks`` whose headers match a stricter rule take its labels; none is made less sensitive."""
    pick = lambda k: F.element_at(F.array(*(F.lit(r[k]) for r in rules)), F.col("_rule") + 1)
    marked = chunks.withColumn("_head", table_header(F.col("text"))).withColumn("_rule", F.when(F.size("_head") > 0, matched_rule(normalized(F.col("_head")), rules)))
    up = F.col("_rule").isNotNull() & (rank_of(F.col("sensitivity")) < rank_of(pick(2)))
    marked = marked.withColumn("_up", F.coalesce(up, F.lit(False)))
    new = {"sensitivity": pick(2), "aiUsePolicy": pick(3), "sensitivitySource": F.lit("columnRule"), "sensitivityReason": pick(4)}
    return marked.withColumns({c: F.when(F.col("_up"), v).otherwise(F.col(c) if c in chunks.columns else F.lit(None)) for c, v in new.items()}).drop("_head", "_rule", "_up")
