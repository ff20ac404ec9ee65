"""The queries of the operators, over whole tables with production parameters, and their SQL where there is one."""

from __future__ import annotations

from .chunking import op8_document_fingerprints
from .jaccard import op10_ngram_jaccard
from .language import op4_language_id
from .mixing import op2_mix_sources
from .packing import op9_best_fit_packing
from .personal import op3_personal_data
from .prefixes import op12_prefix_trie
from .quality import op1_quality_rules
from .secrets import op5_secret_scan
from .session import table
from .spelling import op11_spelling_variants
from .substrings import op6_substring_dedup
from .suffix_dedup import op7_suffix_array_dedup
from .tokens import op13_token_counts


def queries() -> dict:
    over = lambda f, *names: lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
    out = {f.__name__: over(f, "documents") for f in (op2_mix_sources, op3_personal_data, op4_language_id, op5_secret_scan, op6_substring_dedup, op7_suffix_array_dedup, op8_document_fingerprints, op9_best_fit_packing, op10_ngram_jaccard, op11_spelling_variants, op13_token_counts)}
    return {"op1_quality_rules": over(op1_quality_rules, "documents", "labels"), **out, "op12_prefix_trie": over(op12_prefix_trie, "conversations")}


SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
earliest AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS p FROM win JOIN earliest USING (k) WHERE d < win.doc_id),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS t
         FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN link ON a = r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON d = d.doc_id GROUP BY 1, 2
"""


#: The unsigned crc32 of a list of bytes.
CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], {bytes}), lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"

SPELLING_VARIANTS = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS c FROM r GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END)) AS bytes FROM d),
h AS (SELECT w, c, {CRC32.format(bytes="bytes")} AS h FROM b),
made AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, i, word[:i] || word[i + 2:] AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS o FROM less a JOIN less b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
         UNION SELECT less.word, v.word FROM less JOIN v ON k = v.word UNION SELECT v.word, less.word FROM less JOIN v ON k = v.word),
best AS (SELECT near.word, count(*) AS n_near, min({{'m': -n, 'o': o}}) AS b FROM near JOIN v ON v.word = o GROUP BY near.word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN b.o END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.form = f.word)
SELECT f.word, f.form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN up ON up.word = f.word AND up.form IS NULL
"""

PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(s ORDER BY p) AS s FROM t GROUP BY conv_id),
h AS (SELECT conv_id, s, conv_id - conv_id % 20 AS base, {CRC32.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 4 AS h FROM c),
b AS (SELECT h.conv_id, list_concat(coalesce(c.s, [])[:h], h.s[h + 1:]) AS s FROM h LEFT JOIN c ON c.conv_id = base),
m AS (SELECT conv_id, len(s) AS size, s[:d] AS k, d FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM b)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM m GROUP BY k, d),
kids AS (SELECT k[:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[d].t, '[^ 	-
]+')) END AS saved FROM n LEFT JOIN kids USING (k)),
up AS (SELECT k[:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM x) GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, up.n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN up ON up.k = x.k LEFT JOIN n p ON x.d > 0 AND p.d = x.d - 1 AND p.k = x.k[:x.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": SUBSTRING_DEDUP, "op10_ngram_jaccard": NGRAM_JACCARD, "op11_spelling_variants": SPELLING_VARIANTS, "op12_prefix_trie": PREFIX_TRIE}
