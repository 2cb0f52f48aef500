import random

import duckdb
import pandas as pd

from paperloom.llm import licenses as lic
from paperloom.llm.sql import license_sql

FILLER = [f"filler{k}" for k in range(50)]


def around(text, seed):
    rng = random.Random(seed)
    side = lambda: " ".join(rng.choice(FILLER) for _ in range(rng.randrange(40)))
    return f"{side()}\n{text} {side()}"


def test_notices_are_found_wherever_they_lie(spark):
    rows = [(k * 100 + seed, around(t, seed), name) for k, (name, ts) in enumerate(lic.TEMPLATES.items()) for t in ts for seed in range(4)]
    got = lic.scan(spark.createDataFrame([(k * 1000 + d, t) for k, (d, t, _) in enumerate(rows)], "doc_id bigint, text string"))
    found = {(r["doc_id"], r["license"]) for r in got.where("containment = 1").collect()}
    for k, (d, _, name) in enumerate(rows):
        assert (k * 1000 + d, name) in found


def test_part_of_a_notice(spark):
    words = lic.TEMPLATES["MIT"][3].split()
    cut = lambda share: " ".join(words[: int(len(words) * share)])
    got = lic.scan(spark.createDataFrame([(1, around(cut(0.9), 1)), (2, around(cut(0.7), 2)), (3, "licensed under the old")], "doc_id bigint, text string")).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "MIT")] and 0.8 <= got[0]["containment"] < 1


def test_other_versions_are_not_reported(spark):
    got = lic.scan(spark.createDataFrame([(1, lic.TEMPLATES["GPL-3.0"][0] + " " + lic.TEMPLATES["MIT"][0])], "doc_id bigint, text string")).collect()
    assert sorted(r["license"] for r in got) == ["GPL-3.0", "MIT"]


def test_no_python_in_the_plan(documents):
    plan = lic.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(spark, odd, empty):
    assert lic.scan(odd).count() == 0 and lic.scan(empty).count() == 0
    long = "x " * 50_000 + "Released under the MIT License. " * 3
    got = lic.scan(spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] is None, r["license"], r["containment"]) for r in got) == [(False, "MIT", 1.0), (True, "MIT", 1.0)]
    other = lic.scan(spark.createDataFrame([(1, "an own wording of five words")], "doc_id bigint, text string"), {"own": ("Own wording of five words!", "four words are few")}).collect()
    assert [(r["license"], r["containment"]) for r in other] == [("own", 1.0)]


def test_standard_notices_name_their_own_license(spark):
    """Each wording alone, in other text, is its license and no other that it merely resembles."""
    rows = [(k, name, f"Some words of a file before it. {text} And then the code goes on here.") for k, (name, text) in enumerate((name, text) for name, texts in lic.TEMPLATES.items() for text in texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, name string, text string")
    found = {(r["doc_id"], r["license"]) for r in lic.scan(df).collect()}
    assert {(k, name) for k, name, _ in rows} <= found
    for own, other in (("AGPL-3.0", "GPL-3.0"), ("LGPL-3.0", "GPL-3.0"), ("GPL-2.0", "GPL-3.0"), ("LGPL-2.1", "LGPL-3.0")):
        assert not [k for k, name, _ in rows if name == own and (k, other) in found]


def test_openings_of_whole_texts(spark):
    """A license's own text gives its license and none that shares its opening or differs in a word of its title."""
    bsd2, bsd3 = lic.TEMPLATES["BSD-2-Clause"][1], lic.TEMPLATES["BSD-3-Clause"][1]
    rest = ", AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."
    verbatim = ", Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble "
    cases = [
        ("BSD-2-Clause", "Copyright (c) 2020, A. Person\n" + bsd2 + rest),
        ("BSD-3-Clause", "Copyright (c) 2020, A. Person\n" + bsd3 + rest),
        ("BSD-3-Clause", ("Copyright (c) 2020\n" + bsd3 + rest).replace(" 1. ", " * ").replace(" 2. ", " * ").replace(" 3. ", " * ")),
        ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions."),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation" + verbatim + "The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works."),
        ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation" + verbatim),
        ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation" + verbatim + lic.TEMPLATES["AGPL-3.0"][-1]),
        ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation" + verbatim),
        ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright (C) 1991, 1999 Free Software Foundation" + verbatim),
        ("BSD-2-Clause", around(lic.TEMPLATES["BSD-2-Clause"][0], 9)),
    ]
    got = lic.scan(spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(k, name) for k, (name, _) in enumerate(cases)]


def test_against_brute_force(spark):
    """Notices with words lost or changed, in noise: the same licenses, shares and places as without retrieval."""
    rng = random.Random(8)
    rows = []
    for k in range(150):
        parts = []
        for text in rng.sample([t for ts in lic.TEMPLATES.values() for t in ts], rng.randrange(0, 3)):
            parts.append(" ".join(w if rng.random() > 0.02 else rng.choice(["", "other"]) for w in text.split()))
        rows.append((k, around(" ".join(parts), k)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(license_sql()).fetchall()
    got = lic.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(want) > 50 and sorted((r["doc_id"], r["license"], round(r["containment"], 6), r["first_word"]) for r in got) == sorted(want)
