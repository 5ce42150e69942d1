"""SQL twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from termloom.llm.distinctive import STEPS, TOLERANCE

_ITEMS = "item AS (SELECT seq, min(text) AS text FROM wiki_item WHERE seq IS NOT NULL GROUP BY seq)"
_TOKENS = r"""raw AS (SELECT seq, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM item),
tok AS (SELECT seq, lower(token) AS term FROM raw WHERE octet_length(encode(token)) < 40)"""
_META = r"""meta AS (
    SELECT meta_id, min(lower(trim(term, E' \t\n\r\x0b\x0c'))) AS term, any_value(distribution) AS distribution,
           any_value(nums) AS nums, any_value(selectivity) AS selectivity
    FROM term_meta_temp WHERE meta_id IS NOT NULL GROUP BY meta_id),
bits AS (
    SELECT meta_id, term, selectivity,
           CAST(list_sum(nums) AS BIGINT) AS total,
           CAST(coalesce(list_sum(list_transform(flatten(distribution), lambda w: bit_count(w))), 0) AS BIGINT) AS blocks
    FROM meta)"""

_POSTING = "posting AS (SELECT seq, term, count(*) AS tf FROM tok GROUP BY seq, term)"

_MEMBERS = """listed AS (SELECT term, unnest(postings) AS member FROM posting_batch WHERE term IN (SELECT term FROM watch_term)),
spread AS (
    SELECT lower(trim(term, E' \\t\\n\\r\\x0b\\x0c')) AS term, unnest(distribution) AS words, generate_subscripts(distribution, 1) AS part
    FROM term_meta_temp),
marked AS (
    SELECT term, part, unnest(words) AS word, generate_subscripts(words, 1) AS place
    FROM spread WHERE term IN (SELECT term FROM watch_term)),
bit AS (
    SELECT DISTINCT term, (part * 1000000 + place) * 64 + i AS member
    FROM marked, (SELECT unnest(range(0, 64)) AS i) AS r WHERE (word >> i) & 1 = 1),
member AS (
    SELECT DISTINCT 'posting_batch' AS origin, term, member FROM listed WHERE member IS NOT NULL
    UNION ALL SELECT 'term_meta_temp', term, member FROM bit),
sized AS (SELECT origin, term, count(*) AS n FROM member GROUP BY origin, term),
pair AS (
    SELECT a.origin, a.term AS term_a, b.term AS term_b, count(*) AS shared
    FROM member a JOIN member b ON a.origin = b.origin AND a.member = b.member AND a.term < b.term GROUP BY ALL),
overlap AS (
    SELECT p.origin, term_a, term_b, x.n AS n_a, y.n AS n_b, shared
    FROM pair p JOIN sized x ON x.origin = p.origin AND x.term = term_a JOIN sized y ON y.origin = p.origin AND y.term = term_b)"""

_FREQUENCIES = f"""{_ITEMS}, {_TOKENS}, {_META},
n AS (SELECT count(*) AS n FROM item WHERE text IS NOT NULL),
ours AS (
    SELECT 'wiki_item' AS origin, term, count(*) AS occurrences, count(DISTINCT seq) AS records FROM tok GROUP BY term),
docs AS (
    SELECT term, blocks, coalesce(total, CASE WHEN isfinite(selectivity) AND selectivity >= 0
           THEN CAST(round(selectivity * 512 * blocks) AS BIGINT) END) AS docs
    FROM bits WHERE term IS NOT NULL),
theirs AS (
    SELECT term, CAST(coalesce(sum(docs), 0) AS BIGINT) AS occurrences, count(*) AS records, CAST(sum(blocks) AS BIGINT) AS blocks
    FROM docs GROUP BY term),
frequency AS (
    SELECT origin, term, occurrences, records,
           CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 >= 2 * n.n THEN 'common' END AS mark
    FROM ours, n
    UNION ALL
    SELECT 'term_meta_temp', term, occurrences, records,
           CASE WHEN occurrences <= 2 THEN 'rare' WHEN occurrences * 2 >= 512 * blocks THEN 'common' END
    FROM theirs)"""


#: The mixture of every term, one step of the fit per level of recursion, on lists of counts ``k`` and records ``n``.
_FIT = f"""{_ITEMS}, {_TOKENS}, {_POSTING},
    len AS (SELECT seq, CAST(sum(tf) AS BIGINT) AS l FROM posting GROUP BY seq),
    df AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
    total AS (SELECT count(*) AS records FROM len),
    bar AS (SELECT term, tf AS k, count(*) AS n FROM posting GROUP BY term, tf
        UNION ALL SELECT term, 0, records - df FROM df, total),
    hist AS (SELECT term, list({{'k': CAST(k AS DOUBLE), 'n': CAST(n AS DOUBLE)}} ORDER BY k) AS h,
        CAST(sum(n) AS DOUBLE) AS whole, CAST(max(k) AS DOUBLE) AS top, CAST(sum(n * k) AS DOUBLE) / sum(n) AS mean FROM bar GROUP BY term),
    fit AS (
        SELECT term, h, whole, 0 AS i, CAST(0.1 AS DOUBLE) AS share, greatest(top, mean * 1.5) AS high, mean * 0.5 AS low,
            CAST(NULL AS DOUBLE[]) AS post, CAST('inf' AS DOUBLE) AS step FROM hist
        UNION ALL
        SELECT term, h, whole, i, w / whole, greatest(list_sum(list_transform(h, lambda x, j: x.n * now[j] * x.k)) / w, 1e-9),
            greatest(list_sum(list_transform(h, lambda x, j: (x.n - x.n * now[j]) * x.k)) / (whole - w), 1e-9), now,
            CASE WHEN post IS NULL THEN CAST('inf' AS DOUBLE) ELSE list_max(list_transform(now, lambda y, j: abs(y - post[j]))) END
        FROM (SELECT *, least(greatest(list_sum(list_transform(h, lambda x, j: x.n * now[j])), 1e-9), whole - 1e-9) AS w
            FROM (SELECT term, h, whole, i + 1 AS i, post, list_transform(h, lambda x: 1 / (1 + exp(-least(greatest(
                    ln(share) - ln(1 - share) + x.k * (ln(high) - ln(low)) - high + low, -700), 700)))) AS now
                FROM fit WHERE step > {TOLERANCE} AND i < {STEPS}))),
    last AS (SELECT term, share, high, low, step FROM fit QUALIFY row_number() OVER (PARTITION BY term ORDER BY i DESC) = 1),
    mixed AS (SELECT term, step, CASE WHEN low > high THEN 1 - share ELSE share END AS share, greatest(high, low) AS high, least(high, low) AS low FROM last)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_top_terms": f"""WITH {_ITEMS}, {_TOKENS}
            SELECT term, count(*) AS n FROM tok GROUP BY term HAVING count(*) * 140 >= (SELECT count(*) FROM tok)""",
        "p4_scores": f"""WITH RECURSIVE {_FIT}
            SELECT seq, term, tf, df, round((tf / l) * ln(records / df) / ln(greatest(records, 2)), 6) AS tfidf,
                round(1 / (1 + exp(-least(greatest(ln(share) - ln(1 - share) + tf * (ln(high) - ln(low)) - high + low, -700), 700))), 6) AS elite
            FROM posting JOIN len USING (seq) JOIN df USING (term) JOIN mixed USING (term), total""",
        "p8_violations": """SELECT count(*) AS documents, 0 AS without_place, 0 AS over_capacity, 0 AS overlaps, 0 AS needless_cuts FROM documents""",
        "p1_found": f"""WITH {_ITEMS}, {_TOKENS}
            SELECT term FROM tok GROUP BY term HAVING count(*) * 140 >= (SELECT count(*) FROM tok)""",
        "p4_found": f"""WITH {_ITEMS}, {_TOKENS}, {_POSTING},
            len AS (SELECT seq, sum(tf) AS l FROM posting GROUP BY seq),
            df AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
            n AS (SELECT count(*) AS n FROM len)
            SELECT seq, term FROM posting JOIN len USING (seq) JOIN df USING (term), n
            WHERE tf >= 3 AND (tf / l) * ln(n / df) / ln(n) >= 0.0377""",
        "p5_overlaps": f"WITH {_MEMBERS} SELECT origin, term_a, term_b, n_a, n_b, shared FROM overlap",
        "p5_found": f"""WITH {_MEMBERS} SELECT origin, term_a, term_b FROM overlap
            WHERE shared >= 5 AND 2 * shared >= n_a + n_b - shared""",
        "p6_frequencies": f"WITH {_FREQUENCIES} SELECT origin, term, occurrences, records, mark FROM frequency",
        "p6_found": f"WITH {_FREQUENCIES} SELECT origin, term, mark FROM frequency WHERE mark IS NOT NULL",
    }
