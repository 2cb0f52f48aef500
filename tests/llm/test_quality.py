import math
import random
import re

from pyspark.sql import functions as F

from paperloom.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    rep = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def test_counts():
    rng = random.Random(1)
    for seed in range(200):
        text = "".join(rng.choice(["a", "b", "cd", "é", "日本", "|", "#x", "!", " "]) + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for _ in range(rng.randrange(60)))
        assert q.counts_of(text.encode())[:5] == brute(text)
    many = " ".join(f"w{k}" for k in range(9000)) + " " + " ".join(f"w{k}" for k in range(20))
    assert q.counts_of(many.encode())[:5] == brute(many)  # too many different words to number a window in 62 bits


def test_buckets_invert(spark):
    df = spark.range(0, 100_000).withColumn("b", F.expr(q.bucket_of("id"))).withColumn("v", F.expr(q.value_of("b")))
    bad = df.where("v > id OR v < id - id / 64")
    assert bad.count() == 0 and df.agg(F.count_distinct("b")).first()[0] < 800


def test_sketches_merge(documents):
    """Sketches of parts add up to that of the whole."""
    feats = q.features(documents)
    whole = {tuple(r) for r in q.sketch(feats).collect()}
    parts = q.sketch(feats.where("doc_id % 2 = 0")).unionByName(q.sketch(feats.where("doc_id % 2 = 1")))
    assert {tuple(r) for r in parts.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n")).collect()} == whole


def test_verdicts_follow_labels(spark, documents):
    from .conftest import DATA

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = q.apply(documents).join(labels, "doc_id")
    assert got.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert got.where("quality = 0").count() > 5 and got.where("quality = 0 AND kept").count() <= 0.1 * got.where("quality = 0").count()


def test_limits_adapt_to_the_group(spark):
    plain, code = "some plain words of an ordinary text number {}", "a | b | c | d | e | f | g | h {}"
    rows = [(k, " ".join([plain.format(k)] * 1 + [f"w{k}{j}" for j in range(20)]), "en", "web") for k in range(100)] + [(1000 + k, code.format(" ".join(f"w{k}{j}" for j in range(12))), "en", "tables") for k in range(100)] + [(5000, code.format(" ".join(f"v{j}" for j in range(12))), "en", "web")]
    got = {r["doc_id"]: r["kept"] for r in q.apply(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(100)) and all(got[1000 + k] for k in range(100)) and not got[5000]


def test_limits_are_the_groups_own_quantiles(spark):
    """Fences from sorted rates by hand, drawn to the language's and to all; and a group's own data move its limit."""
    rng = random.Random(5)
    rows = [(k, " ".join(("W" if rng.random() < share else "w") + "ord" * rng.randrange(1, 4) + str(rng.random()) for _ in range(40)), lang, source) for k in range(400) for lang, source, share in [rng.choice([("en", "a", 0.1), ("en", "b", 0.6), ("de", "a", 0.3), (None, "c", 0.0)])]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    feats = q.features(df).where(~q.base_failed())
    got = {(r["lang"], r["source"]): r for r in q.thresholds(q.sketch(feats)).collect()}
    data = feats.collect()
    for rate, (top, factor, under) in q.RATES.items():
        exact = lambda v: v if v < 2**q.BITS else v >> (v.bit_length() - q.BITS) << (v.bit_length() - q.BITS)

        def fence(rs):
            v = sorted(exact(factor * r[top] // max(r[under], 1)) for r in rs)
            low, high = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
            return len(v), math.log(1 + high + q.WIDTH * (high - low))

        _, every = fence(data)
        for (lang, source), row in got.items():
            nl, fl = fence([r for r in data if r["lang"] == lang])
            n, f = fence([r for r in data if (r["lang"], r["source"]) == (lang, source)])
            assert abs(math.log(1 + row[f"limit_{rate}"]) - (n * f + q.PRIOR * (nl * fl + q.PRIOR * every) / (nl + q.PRIOR)) / (n + q.PRIOR)) < 1e-6
    assert got["en", "b"]["limit_upper"] > got["en", "a"]["limit_upper"] + 20
    shouting = q.features(df.withColumn("text", F.when(F.col("source") == "a", F.upper("text")).otherwise(F.col("text"))))
    after = {(r["lang"], r["source"]): r for r in q.thresholds(q.sketch(shouting.where(~q.base_failed()))).collect()}
    assert after["en", "a"]["limit_upper"] > 2 * got["en", "a"]["limit_upper"]


def test_odd_rows(odd, empty):
    got = q.apply(odd)
    rows = got.collect()
    assert len(rows) == 10 and got.columns.count("kept") == 1 and all(isinstance(r["kept"], bool) for r in rows)
    assert all(r["base_failed"] and not r["kept"] for r in rows if not r["text"] or len(r["text"].split()) < 10)
    assert q.apply(empty).count() == 0
