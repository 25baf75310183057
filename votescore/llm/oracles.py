"""SQL (DuckDB) of the corpus queries that SQL can express."""

from votescore.llm.known_licenses import NOTICES, SPELLINGS, TEXTS

#: Counts, histograms per group, quartiles and the back-off to language and everything, all in whole numbers.
QUALITY_STATS = r"""
doc AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM {documents}),
word AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT r, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM doc)),
eight AS (SELECT r, i, lead(w, 7) OVER o IS NOT NULL AS whole, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o,
    lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS g,
    lag(w) OVER o AS prior, w FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM eight WHERE whole) WHERE n > 1),
covered AS (SELECT r, sum(least(8, coalesce(i - before, 8))) AS n FROM (
    SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again) GROUP BY r),
perdoc AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
    count(*) FILTER (WHERE w = prior) AS n_stutter FROM eight GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM doc),
perline AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT doc.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_stutter, 0) AS n_stutter
    FROM doc LEFT JOIN perdoc USING (r) LEFT JOIN perline USING (r) LEFT JOIN covered USING (r)),
m AS (SELECT *, least(1000, n_symbols * 1000 // greatest(word_chars, 1)) AS m1,
    least(1000, n_dup_lines * 1000 // greatest(n_lines, 1)) AS m2,
    least(1000, n_repeat_words * 1000 // greatest(n_words, 1)) AS m3,
    least(1000, n_stutter * 1000 // greatest(n_words, 1)) AS m4,
    least(1000, word_chars * 10 // greatest(n_words, 1)) AS m5,
    n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM c),
long AS (SELECT lang, source, unnest([1, 2, 3, 4, 5]) AS k, unnest([m1, m2, m3, m4, m5]) AS v FROM m),
level AS (SELECT 1 AS l, lang, source, k, v FROM long UNION ALL SELECT 2, lang, NULL, k, v FROM long
    UNION ALL SELECT 3, NULL, NULL, k, v FROM long),
q AS (SELECT l, lang, source, k, count(*) AS total, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3
    FROM level GROUP BY ALL),
lim AS (SELECT l, lang, source, k, total,
    q3 + greatest(3 * (q3 - q1), CASE k WHEN 1 THEN 25 WHEN 2 THEN 400 WHEN 3 THEN 250 WHEN 4 THEN 100 ELSE 15 END) AS hi,
    q1 - greatest(3 * (q3 - q1), 15) AS lo FROM q),
pick AS (SELECT a.lang, a.source, a.k,
    CASE WHEN a.total >= 100 THEN a.hi WHEN b.total >= 100 THEN b.hi ELSE e.hi END AS hi,
    CASE WHEN a.total >= 100 THEN a.lo WHEN b.total >= 100 THEN b.lo ELSE e.lo END AS lo
    FROM lim a JOIN lim b ON b.l = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.k = b.k
    JOIN lim e ON e.l = 3 AND a.k = e.k WHERE a.l = 1),
t AS (SELECT lang, source, max(hi) FILTER (WHERE k = 1) AS h1, max(hi) FILTER (WHERE k = 2) AS h2,
    max(hi) FILTER (WHERE k = 3) AS h3, max(hi) FILTER (WHERE k = 4) AS h4, max(hi) FILTER (WHERE k = 5) AS h5,
    max(lo) FILTER (WHERE k = 5) AS l5 FROM pick GROUP BY lang, source),
judged AS (SELECT m.*, NOT base_failed AND m1 <= h1 AND m2 <= h2 AND m3 <= h3 AND m4 <= h4 AND m5 <= h5 AND m5 >= l5 AS kept
    FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)
"""

QUALITY_RULES = "WITH " + QUALITY_STATS.replace("{documents}", "documents") + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM judged
"""


_NAMES_HOLDER = r"""[^\p{L}\p{N}©(]*({mark}([ \t:,.]*{mark})*[ \t:,.]*[\[<{]?([0-9]{4}|(?i:yyyy)|(?i:year))[\]>}]?([ \t]*[-–,][ \t]*([0-9]{2,4}|(?i:present)))*([ \t,.]+[^ \t\r]+){0,10}|{mark}([ \t:,.]*{mark})*([ \t:]+((?i:by)|(?i:the)))?[ \t:]+{name}([ \t]+((?i:and|of|the|de|von|et|al\.|&)|{name})){0,4}([ \t]+(?i:all rights reserved)[.!]?)?|(?i:all rights reserved)[^\p{L}\p{N}]*)[ \t\r]*""".replace(
    "{mark}", r"((?i:copyright)|(?i:\(c\))|©)").replace("{name}", r"[\p{Lu}\p{Lo}<\[{][^ \t\r]*")

# Words of terms and sentences, which no line that only names a holder has.
_TERM_WORDS = """no not nor use used uses using user users commercial noncommercial may must shall will can cannot is are be been was were has have
permission permissions permitted permit permits granted grant grants required require requires forbidden prohibited license licensed
licenses licence licenced licences licensing without except unless only any notice notices holder holders owner owners hereby provided
subject under copies copy copied copying distribute distributed distribution redistribute redistributed redistribution modify modified
modification modifications sold sell sale contract contracts terms agreement restrict restricted restrictions warranty warranties liable
liability claim claims assign assigned assignment sublicense derivative reproduce reproduced consent written conditions disclaimer
infringement that which if but this""".split()
_SENTENCE = r"(?i)^[^\p{L}\p{N}]*copyright[ \t:]+(and|or|in|of|to|for|as|on|with|laws?|statements?|interests?|protection|information|treaty|treaties|rights?|doctrines?|works?|status|acts?)([^\p{L}\p{N}]|$)"


def _canonical(text: str) -> str:
    """SQL of the canonical form of a licence text: by lines, each judged as a whole and by its words."""
    words = ", ".join(f"'{w}'" for w in _TERM_WORDS)
    holder = (f"(regexp_full_match(l, '{_NAMES_HOLDER}') AND NOT list_has_any(regexp_split_to_array(lower(l), '[^\\p{{L}}\\p{{N}}]+'), [{words}])"
              f" AND NOT (regexp_matches(l, '{_SENTENCE}') AND NOT regexp_matches(l, '[0-9]{{4}}|(?i:year|yyyy)')))")
    out = (f"trim(regexp_replace(lower(array_to_string([l FOR l IN string_split({text}, chr(10)) IF NOT {holder}], chr(10))), "
           r"'[^\p{L}\p{N}]+', ' ', 'g'))")
    for other, usual in SPELLINGS.items():
        out = f"replace({out}, '{other}', '{usual}')"
    return out


def _known() -> str:
    rows = [(name, text) for table in (TEXTS, NOTICES) for name, texts in table.items() for text in texts]
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in rows)
    return f"(SELECT DISTINCT license, {_canonical('text')} AS c FROM (VALUES {quoted}) AS v(license, text))"


LICENSE_SCAN = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, 0 AS kind, [text] AS p FROM doc
    UNION ALL SELECT r, 1, regexp_split_to_array(text, '\n[ \t\r]*\n') FROM doc
    UNION ALL SELECT r, 2, string_split(text, chr(10)) FROM doc),
unit AS (SELECT r, kind, unnest(p) AS t FROM parts WHERE kind = 0 OR len(p) > 1),
looked AS (SELECT r, kind, license FROM (SELECT r, kind, {canonical} AS c FROM unit) JOIN {known} AS k USING (c)
    WHERE c <> '')
SELECT doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE kind = 0), '') AS whole,
    coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS found,
    count(license) FILTER (WHERE kind > 0) AS n_notices
FROM doc LEFT JOIN looked USING (r) GROUP BY r, doc_id
""".replace("{canonical}", _canonical("t")).replace("{known}", _known())


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL_SEARCH = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{term}') AS words FROM documents),
filled AS (SELECT r, doc_id, words, len(words) AS n FROM doc WHERE len(words) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM filled),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM filled) GROUP BY r, term),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM benchmark),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM wanted) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, corpus),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * n * docs) // total) AS m FROM filled, corpus),
scored AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM wanted JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r),
best AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scored JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10
""".replace("{lower}", _LOWER).replace("{term}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Windows of documents are made in every length that a pattern has, and joined with the patterns as lists of words.
DECONTAMINATION = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{word}') AS words FROM documents),
item AS (SELECT item_id, regexp_extract_all({lower}, '{word}') AS words FROM benchmark WHERE item_id IS NOT NULL),
pattern AS (SELECT DISTINCT item_id, words[i:i + 9] AS p FROM (
    SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM item WHERE len(words) > 0)),
size AS (SELECT DISTINCT len(p) AS size FROM pattern),
place AS (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc, size),
found AS (SELECT r, i, size, item_id FROM (SELECT r, i, size, words[i:i + size - 1] AS p FROM place) JOIN pattern USING (p)),
hit AS (SELECT r, count(DISTINCT w)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS w FROM found) GROUP BY r),
named AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""".replace("{lower}", _LOWER).replace("{word}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
