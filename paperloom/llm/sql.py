"""The operators' results in DuckDB's SQL, for those that SQL can express."""

from __future__ import annotations

from . import chat, licenses, quality

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SHIFT = "(b // 64 - 1)"


def _bucket(v: str) -> str:
    return f"CASE WHEN {v} < 128 THEN {v} ELSE (length(bin({v})) - 7) * 64 + ({v} >> CAST(length(bin({v})) - 7 AS BIGINT)) END"


def _rate(name: str) -> str:
    top, factor, under = quality.RATES[name]
    return f"({factor} * {top}) // greatest({under}, 1)"


def quality_sql() -> str:
    """Counts, and the verdict by each group's own limits."""
    rates = list(quality.RATES)
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {_rate(r)} AS v FROM f WHERE NOT base_failed" for r in rates)
    value = f"CASE WHEN b < 128 THEN b ELSE (b - {_SHIFT} * 64) << CAST({_SHIFT} AS BIGINT) END"

    def limits(keys: str) -> str:
        by = keys + ", " if keys else ""
        low, high = (f"min(CASE WHEN 4 * up >= {k} * docs THEN {value} END)" for k in (1, 3))
        return f"""SELECT {by}rate, max(docs) AS docs, ln(1 + {high} + {quality.WIDTH} * ({high} - {low})) AS fence
            FROM (SELECT *, sum(n) OVER (PARTITION BY {by}rate ORDER BY b) AS up, sum(n) OVER (PARTITION BY {by}rate) AS docs FROM (SELECT {by}rate, b, sum(n) AS n FROM hist GROUP BY {by}rate, b)) GROUP BY {by}rate"""

    pick = ", ".join(f"max(CASE WHEN rate = '{r}' THEN lim END) AS limit_{r}" for r in rates)
    over, k = " OR ".join(map(quality.excess, rates)), quality.PRIOR
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT rid, unnest(grams) AS g, generate_subscripts(grams, 1) AS i FROM (SELECT rid, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) AS grams FROM w WHERE len(words) >= 5)),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
    f AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
        SELECT rid, doc_id, lang, source, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_marks
        FROM w LEFT JOIN rep USING (rid))),
    hist AS MATERIALIZED (SELECT lang, source, rate, {_bucket('v')} AS b, count(*) AS n FROM ({long}) GROUP BY ALL),
    own AS ({limits('lang, source')}), per_lang AS ({limits('lang')}), every AS ({limits('')}),
    lim AS (SELECT lang, source, {pick} FROM (SELECT own.lang, own.source, own.rate, exp((own.docs * own.fence + {k} * ((l.docs * l.fence + {k} * e.fence) / (l.docs + {k}))) / (own.docs + {k})) - 1 AS lim
        FROM own LEFT JOIN per_lang l ON l.lang IS NOT DISTINCT FROM own.lang AND l.rate = own.rate LEFT JOIN every e ON e.rate = own.rate) GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
    FROM f LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM f.lang AND lim.source IS NOT DISTINCT FROM f.source"""


WORDS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

DECONTAMINATION = rf"""WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    pat AS MATERIALIZED (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0)),
    d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
    grams AS (SELECT rid, m, list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')) AS gs FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m),
    hit AS MATERIALIZED (SELECT rid, i, m, item_id FROM (SELECT rid, m, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM grams) JOIN pat USING (m, g)),
    n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
    it AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)"""

_BITS = "".join(f"{k:04b}" for k in range(16))
_FIVE = " + ".join(f"{1 << (4 - j)} * CAST(substr(bits, CAST(5 * k + {j + 1} AS BIGINT), 1) AS INTEGER)" for j in range(5))

WARC = f"""WITH p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY page_id, url) AS rid, page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
    bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('{_BITS}', CAST(4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1 AS BIGINT), 4)), '') AS bits FROM p),
    f AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + {_FIVE} AS BIGINT), 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id, rid) AS k FROM bits)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN k = 1 OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 AND page_id IS NOT NULL THEN first END AS refers_to FROM f"""


def _escaped(c: str) -> str:
    return f"regexp_replace({c}, '{chat.ESCAPE}', '\\1\\\\\\2\\3', 'g')"


CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        CAST(sum({len(chat.START) + 1 + len(chat.END)} + length({_escaped("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""


def license_sql() -> str:
    """Containment of each wording in each window, without any retrieval."""
    rows = ", ".join("('{}', '{}', '{}')".format(lic, f"{lic}#{k}", t.replace("'", "''")) for lic, texts in licenses.TEMPLATES.items() for k, t in enumerate(texts))
    s = licenses.SHINGLE
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    grams = f"list_transform(range(1, len(w) - {s - 2}), lambda i: array_to_string(w[i:i + {s - 1}], ' '))"
    return f"""WITH t AS (SELECT *, {words} AS w FROM (VALUES {rows}) v(license, template, text)),
    ts AS MATERIALIZED (SELECT DISTINCT license, template, len(w) AS s, unnest({grams}) AS g FROM t WHERE len(w) >= {s}),
    size AS (SELECT template, count(*) AS m FROM ts GROUP BY 1),
    d AS (SELECT doc_id, {grams} AS gs FROM (SELECT doc_id, {words} AS w FROM documents) WHERE len(w) >= {s}),
    x AS (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS pos FROM d),
    hit AS (SELECT DISTINCT doc_id, license, template, s, g, k FROM (SELECT doc_id, license, template, s, x.g, pos, unnest([pos // s, pos // s - 1]) AS k FROM x JOIN ts ON x.g = ts.g) WHERE k >= 0 AND pos + {s} <= (k + 2) * s),
    per AS (SELECT doc_id, license, template, max(c) AS c, arg_max(first_word, (c, -first_word)) AS first_word, arg_max(shared, (c, -first_word)) AS shared FROM (
        SELECT doc_id, license, template, k * s AS first_word, list(g) AS shared, CAST(count(*) AS DOUBLE) / any_value(m) AS c FROM hit JOIN size USING (template) GROUP BY doc_id, license, template, s, k) WHERE c >= {licenses.LEAST} GROUP BY 1, 2, 3),
    best AS (SELECT doc_id, license, max(c) AS containment, arg_max(first_word, (c, -first_word)) AS first_word, list_distinct(flatten(list(shared))) AS shared FROM per GROUP BY 1, 2)
    SELECT doc_id, license, round(containment, 6) AS containment, CAST(first_word AS BIGINT) AS first_word FROM best a
    WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = a.doc_id AND (b.containment > a.containment OR len(b.shared) > len(a.shared)) AND list_has_all(b.shared, a.shared))"""


def interactions_sql() -> str:
    """Each document against each order of the five filters."""
    words = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)"
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
        CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > low THEN 'E' END) AS fails
        FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
    m AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
    o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT *, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone, regexp_matches(fails, concat('[', before, '_]')) AS gone FROM m, s),
    g AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (alone) AS unique_fails,
        sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost FROM r GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
        CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0),
    total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, m, g AS phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
        GROUP BY lang, m, g HAVING count(*) >= 100),
    c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
    inner_parts AS (SELECT lang, f, array_to_string(ws[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, a AS f, ws, m, s, unnest(range(1, CAST(m - s + 2 AS BIGINT))) AS i FROM c, (SELECT unnest(range(2, 5)) AS s) WHERE s < m)),
    kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 100 * c.a)),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS left_part, array_to_string(ws[k + 1:], ' ') AS right_part FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
    s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = left_part JOIN f y ON y.lang = cuts.lang AND y.phrase = right_part JOIN total ON total.lang = cuts.lang),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000"""


MINHASH = rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT rid, doc_id, list_sort(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    c AS MATERIALIZED (SELECT min(rid) AS c, min(doc_id) AS low, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
    e AS MATERIALIZED (SELECT c, n, unnest(g) AS g FROM c),
    l AS MATERIALIZED (SELECT a.c AS u, b.c AS v FROM e a JOIN e b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, a.n, b.c, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    r AS (SELECT c AS u, c AS v FROM c UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
    k AS (SELECT r.u AS c, min(x.low) AS low FROM r JOIN c x ON x.c = r.v GROUP BY r.u),
    f AS (SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN doc_id ELSE k.low END AS component_id FROM s LEFT JOIN c ON len(s.g) > 0 AND c.g = s.g LEFT JOIN k ON k.c = c.c)
    SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM f"""


SQL = {"op4_decontamination": DECONTAMINATION, "op6_license_scan": license_sql(), "op8_warc": WARC, "op9_chat_formatting": CHAT, "op10_quality_rules": quality_sql(), "op11_filter_interaction": interactions_sql(), "op12_minhash": MINHASH, "op13_collocations": COLLOCATIONS}
