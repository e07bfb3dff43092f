"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from trailmark.llm.licenses import MIN_DICE, TEMPLATES, anchors, template_words

_NAMED = sorted(TEMPLATES.items())
_TEMPLATES = ", ".join(
    "('{}', '{}')".format(name, " ".join(template_words(text))) for name, text in _NAMED
)
_ANCHORS = ", ".join(
    f"('{name}', '{pair}', {offset})"
    for name, text in _NAMED
    for pair, offset in anchors(template_words(text))
)


def _bigrams(table: str, keys: str) -> str:
    """Numbered bigrams of `table` (keys, w: list of words)."""
    return f"""
    SELECT {keys}, pair || ' ' || row_number() OVER (PARTITION BY {keys}, pair ORDER BY i) AS gram
    FROM (SELECT {keys}, i, w[i] || ' ' || w[i + 1] AS pair
          FROM (SELECT *, unnest(range(1, len(w))) AS i FROM {table}))"""


LICENSES = f"""
WITH templates(license, body) AS (VALUES {_TEMPLATES}),
points(license, pair, o) AS (VALUES {_ANCHORS}),
tw AS (SELECT license, string_split(body, ' ') AS w FROM templates),
tg AS ({_bigrams("tw", "license")}),
ts AS (SELECT license, len(w) - 1 AS m FROM tw),
plain AS (
    SELECT doc_id, trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) AS body FROM documents
),
dw AS (
    SELECT doc_id, CASE WHEN coalesce(body, '') = '' THEN [] ELSE string_split(body, ' ') END AS w
    FROM plain
),
pairs AS (
    SELECT doc_id, i - 1 AS place, w[i] || ' ' || w[i + 1] AS pair
    FROM (SELECT *, unnest(range(1, len(w))) AS i FROM dw)
),
windows AS (
    SELECT DISTINCT doc_id, license, greatest(place - o, 0) AS word FROM pairs JOIN points USING (pair)
),
cut AS (
    SELECT doc_id, license, word, m, list_slice(dw.w, word + 1, word + m + 1) AS w
    FROM windows JOIN dw USING (doc_id) JOIN ts USING (license)
),
fit AS (
    SELECT *, len(w) - 1 AS n FROM cut
    WHERE len(w) > 1 AND (len(w) - 1) * (2 - {MIN_DICE}) >= m * {MIN_DICE}
      AND (len(w) - 1) * {MIN_DICE} <= m * (2 - {MIN_DICE})
),
fg AS ({_bigrams("fit", "doc_id, license, word")}),
shared AS (
    SELECT doc_id, license, word, count(*) AS alike FROM fg JOIN tg USING (license, gram) GROUP BY ALL
),
scored AS (
    SELECT doc_id, license, word, alike * 2.0::DOUBLE / (n + m) AS dice
    FROM shared JOIN fit USING (doc_id, license, word)
),
best AS (
    SELECT * FROM scored WHERE dice >= {MIN_DICE}
    QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, word) = 1
)
SELECT d.doc_id, len(dw.w) AS n_words, coalesce(c.n, 0) AS n_windows, coalesce(p.n, 0) AS n_matches,
       b.license, round(b.dice, 6) AS dice, b.word
FROM documents d JOIN dw USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM windows GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM best GROUP BY doc_id) p USING (doc_id)
LEFT JOIN (SELECT * FROM best
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license DESC) = 1) b
       USING (doc_id)
"""

_RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)"
    " || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)"
    " || 'Content-Length: ' || strlen({body}) || chr(13) || chr(10) || chr(13) || chr(10)"
    " || {body} || chr(13) || chr(10) || chr(13) || chr(10)"
)


def _tree(name: str, records: str) -> str:
    """Levels of the tree up to eight to the sixth ranges, where every file has one root."""
    levels = [f"{name}0 AS (SELECT file, \"offset\" AS pos, digest AS hash FROM {records})"]
    for level, width in enumerate([65536, 8, 8, 8, 8, 8, 8], start=1):
        levels.append(
            f"""{name}{level} AS (
    SELECT file, pos // {width} AS pos,
           sha256(string_agg(pos || ':' || hash, ';' ORDER BY pos, hash)) AS hash
    FROM {name}{level - 1} GROUP BY file, pos // {width})"""
        )
    # The root is the level where the largest file first has a single range.
    picks = " ".join(f"WHEN {8 ** n} THEN (SELECT max(hash) FROM {name}{n + 1} r WHERE r.file = f.file)" for n in range(7))
    levels.append(
        f"""{name}_root AS (
    SELECT file, CASE (SELECT span FROM height) {picks} END AS root
    FROM (SELECT DISTINCT file FROM {records}) f)"""
    )
    return ",\n".join(levels)


WARC = f"""
WITH bodies AS (
    SELECT page_id, url, coalesce(html, '') AS body,
           '~' || substr(coalesce(html, ''), 2) AS flipped FROM pages
),
hashed AS (
    SELECT page_id, url, strlen({_RECORD.format(body="body")}) AS length,
           sha256({_RECORD.format(body="body")}) AS digest,
           sha256(CASE WHEN page_id % 101 = 7 THEN {_RECORD.format(body="flipped")}
                       ELSE {_RECORD.format(body="body")} END) AS other
    FROM bodies
),
numbered AS (
    SELECT *, (row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest) - 1) AS n
    FROM hashed
),
records AS (
    SELECT *, n // 1000 AS file,
           coalesce(sum(length) OVER (PARTITION BY n // 1000 ORDER BY n
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM numbered
),
replica AS (
    SELECT file, "offset", other AS digest FROM records WHERE coalesce(page_id % 997 <> 5, true)
),
height AS (
    SELECT min(p) AS span FROM (SELECT unnest([1, 8, 64, 512, 4096, 32768, 262144]) AS p)
    WHERE p >= (SELECT coalesce(max("offset"), 0) // 65536 + 1 FROM records)
),
{_tree("a", "records")},
{_tree("b", "replica")},
damaged AS (
    SELECT r.file, r."offset", p.digest IS NULL AS missing
    FROM records r LEFT JOIN replica p ON r.file = p.file AND r."offset" = p."offset"
    WHERE p.digest IS DISTINCT FROM r.digest
),
losses AS (
    SELECT file, count(*) AS n, count(*) FILTER (missing) AS m, min("offset") AS f,
           sum("offset")::BIGINT AS s
    FROM damaged GROUP BY file
),
sizes AS (SELECT file, count(*) AS n, sum(length)::BIGINT AS b FROM records GROUP BY file)
SELECT sizes.file, sizes.n AS n_records, sizes.b AS n_bytes, a_root.root, b_root.root AS replica_root,
       a_root.root IS NOT DISTINCT FROM b_root.root AS intact, coalesce(losses.n, 0) AS n_damaged,
       coalesce(losses.m, 0) AS n_missing, losses.f AS first_damaged, losses.s AS sum_offsets
FROM sizes LEFT JOIN a_root USING (file) LEFT JOIN b_root USING (file) LEFT JOIN losses USING (file)
"""

#: Boilerplate lines of each source, and the documents without them.
LINES = """
site_lines AS (
    SELECT DISTINCT doc_id, source, trim(line, ' ') AS line
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM {docs})
    WHERE trim(line, ' ') <> ''
),
totals AS (SELECT source, count(*) AS total FROM {docs} GROUP BY source),
boiler AS (
    SELECT source, line FROM site_lines JOIN totals USING (source) GROUP BY source, line, total
    HAVING count(*) >= 3 AND count(*) > total * 0.1
),
numbered_lines AS (
    SELECT doc_id, source, generate_subscripts(s, 1) AS i, unnest(s) AS line
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM {docs})
),
stripped AS (
    SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
           coalesce(string_agg(n.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS text
    FROM numbered_lines n LEFT JOIN boiler b ON n.source = b.source AND trim(n.line, ' ') = b.line
    GROUP BY doc_id
)
"""

LINE_DEDUP = f"""
WITH {LINES.format(docs="documents")}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM stripped
"""

#: The schedule of a period of 1,000 slots, as a fold in which each slot picks a source.
MIX = """
weights AS (SELECT source, sqrt(count(*)) AS weight FROM {docs} GROUP BY source),
exact AS (SELECT source, weight / sum(weight) OVER () * 1000 AS x FROM weights),
floors AS (SELECT source, floor(x)::BIGINT AS f, round(x - floor(x), 9) AS rest FROM exact),
shares AS (
    SELECT source, f + (row_number() OVER (ORDER BY rest DESC, '=' || source)
                        <= 1000 - sum(f) OVER ())::BIGINT AS share
    FROM floors
),
present AS (
    SELECT source, share, row_number() OVER (ORDER BY '=' || source) AS i
    FROM shares WHERE share > 0
),
lists AS (SELECT list(share ORDER BY i) AS shares FROM present),
fold AS (
    SELECT -1 AS slot, [0 * x FOR x IN shares]::BIGINT[] AS given, 0::BIGINT AS pick,
           0::BIGINT AS nth
    FROM lists
    UNION ALL
    SELECT slot + 1,
           list_transform(given, lambda n, i: n + (i = chosen)::BIGINT),
           chosen, given[chosen]
    FROM (
        SELECT slot, given,
               list_min(list_filter(list_transform(given, lambda n, i:
                   CASE WHEN n * 1000 // shares[i] <= slot + 1
                        THEN (((n + 1) * 1000 + shares[i] - 1) // shares[i]) * 100000 + i END),
                   lambda x: x IS NOT NULL)) % 100000 AS chosen
        FROM fold, lists WHERE slot < 999
    )
),
plan AS (
    SELECT slot, present.source, share, nth FROM fold JOIN present ON pick = i WHERE slot >= 0
),
placed AS (
    SELECT doc_id, d.source, share,
           (row_number() OVER (PARTITION BY d.source ORDER BY md5('0:' || doc_id)) - 1) // 16
               AS mix_block
    FROM {docs} d LEFT JOIN present USING (source)
),
ends AS (
    SELECT min(full_blocks // share * 1000 + slot) AS cut
    FROM (SELECT source, count(*) // 16 AS full_blocks FROM {docs} GROUP BY source) f
    JOIN plan ON plan.source = f.source AND plan.nth = full_blocks % share
),
mixed AS (
    SELECT doc_id, placed.source,
           CASE WHEN placed.share IS NULL THEN NULL ELSE mix_block END AS mix_block,
           mix_block // placed.share * 1000 + slot AS mix_slot
    FROM placed LEFT JOIN plan
      ON plan.source = placed.source AND plan.nth = mix_block % placed.share
)
"""

SOURCE_MIX = f"""
WITH RECURSIVE {MIX.format(docs="documents")}
SELECT doc_id, source, mix_block, mix_slot::BIGINT AS mix_slot,
       coalesce(mix_slot < (SELECT cut FROM ends), false) AS mix_kept
FROM mixed
"""

COLLOCATIONS = rf"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(text, '{ascii_uppercase}', '{ascii_lowercase}') AS text
    FROM documents WHERE text IS NOT NULL
),
pieces AS (
    SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
),
worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
    FROM pieces
),
sizes(m) AS (VALUES (1), (2), (3)),
grams AS (
    SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded), sizes
    WHERE i + m - 1 <= len(w)
),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND a >= 10
),
longer AS (
    SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE m = 3
        UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE m = 3
    ) GROUP BY lang, phrase
),
kept AS (
    SELECT c.* FROM candidates c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase
    WHERE o.a IS NULL OR 100 * o.a < 50 * c.a
),
cuts AS (
    SELECT k.lang, k.phrase, k.a, cut, x.a AS l, y.a AS r,
           1000000::HUGEINT * k.a * k.a // (x.a::HUGEINT * y.a) AS score
    FROM (SELECT *, unnest(range(1, m)) AS cut FROM kept) k
    JOIN counts x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
    JOIN counts y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, k.m), ' ')
),
best AS (
    SELECT * FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM best) JOIN totals USING (lang)
WHERE rank <= 2000
"""

TOP_K = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

ORACLE = {
    "op1_license_scan": LICENSES,
    "op5_warc_fixity": WARC,
    "op6_line_dedup": LINE_DEDUP,
    "op9_source_mix": SOURCE_MIX,
    "op11_collocations": COLLOCATIONS,
    "op12_top_k": TOP_K,
}
