"""DuckDB SQL with the results of the registered corpus queries."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"

CHECKS: dict[str, str] = {}

#: Notices by which texts name a licence, and whole texts of short licences.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-clause-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

CHECKS["op1_near_dedup"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN parts USING (doc_id)
"""

CHECKS["op2_line_dedup"] = rf"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM each),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

CHECKS["op4_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""

_ITEM_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CHECKS["op6_decontaminate"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '{_ITEM_WORDS}') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED}, '{_ITEM_WORDS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS key
  FROM b, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)),
found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (size, key)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(range(0, size)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, string_agg(item_id, ',' ORDER BY item_id) AS ids, count(*) AS n_items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NOTICES = ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in NOTICES)
CHECKS["op3_license_scan"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '{_ITEM_WORDS}') AS w FROM documents),
t AS (
  SELECT template_id, regexp_extract_all({LOWERED}, '{_ITEM_WORDS}') AS w FROM (VALUES {_NOTICES}) AS v(template_id, text)),
ts AS (
  SELECT DISTINCT template_id, array_to_string(w[i : i + 4], ' ') AS s FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i)),
tn AS (SELECT template_id, count(*) AS n FROM ts GROUP BY template_id),
places AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
found AS (
  SELECT doc_id, template_id, 100 * count(*) // any_value(n) AS share FROM places JOIN ts USING (s) JOIN tn USING (template_id)
  GROUP BY doc_id, template_id HAVING 100 * count(*) >= 80 * any_value(n))
SELECT doc_id, count(template_id) AS n_licenses,
  coalesce(string_agg(template_id, ',' ORDER BY template_id), '') AS licenses,
  CAST(coalesce(max(share), 0) AS BIGINT) AS best_per_cent
FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""

CHECKS["op11_spelling"] = rf"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(0, 256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS w
  FROM documents),
each AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || w, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS h
  FROM each, tab),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
edits AS (SELECT word, i, word[1 : i - 1] AS a, word[i + 1 :] AS b FROM places),
pairs AS (
  SELECT x.word AS u, y.word AS v FROM edits x JOIN edits y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, v.word FROM edits x JOIN vocabulary v ON v.word = x.a || x.b
  UNION SELECT v.word, x.word FROM edits x JOIN vocabulary v ON v.word = x.a || x.b),
ranked AS (
  SELECT u AS word, v AS near, n AS near_n, count(*) OVER (PARTITION BY u) AS n_near,
    row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS k
  FROM pairs JOIN vocabulary ON word = v),
forms AS (
  SELECT a.word, a.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * a.n THEN near END AS form, CASE WHEN near_n >= 5 * a.n THEN near_n END AS form_n
  FROM vocabulary a LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (word)),
walk AS (
  SELECT word, form AS reached, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.reached WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN roots USING (word)
"""

CHECKS["op12_collocations"] = rf"""
WITH docs AS (SELECT coalesce(lang,'und') AS lang, translate(coalesce(text,''),'{UPPER}', '{LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i+1] AS y, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i+1] AS y, w[i+2] AS z, count(*) AS f FROM places WHERE i < len(w) - 1 GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS m FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
two AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r,
    CAST((1000000::HUGEINT * f2.f * f2.f) // (p.f::HUGEINT * q.f) AS BIGINT) AS score
  FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  LEFT JOIN longer g ON g.lang = f2.lang AND g.x = f2.x AND g.y = f2.y
  WHERE coalesce(100 * g.m, 0) < 50 * f2.f),
cuts AS (
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, k,
    CASE k WHEN 1 THEN p.f ELSE pq.f END AS l, CASE k WHEN 1 THEN qr.f ELSE r.f END AS r
  FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z
  JOIN f2 pq ON pq.lang = f3.lang AND pq.x = f3.x AND pq.y = f3.y
  JOIN f2 qr ON qr.lang = f3.lang AND qr.x = f3.y AND qr.y = f3.z, range(1, 3) AS c(k)),
three AS (
  SELECT lang, phrase, a, l, r, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best
    FROM (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts))
  WHERE best = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN n USING (lang) WHERE rank <= 2000
"""
