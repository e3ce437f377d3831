"""SQL that gives the rows of those queries which SQL can express, over the same Parquet tables."""

#: Turns as they are shown, windows by prefix sums of their tokens, and what each window repeats: see format_chats().
OP3 = r"""WITH RECURSIVE chats AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS place,
 '<|turn|>' || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || '<|text|>' || regexp_replace(said, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS shown FROM chats),
cost AS (SELECT *, CAST(greatest(ceil(strlen(shown) / 4), 1) AS BIGINT) AS cost, place = 1 AND role = 'system' AS system FROM shown),
size AS (SELECT conv_id AS c, max(cost) AS longest, greatest(2048 - coalesce(sum(cost) FILTER (system), 0) - 256, 2) AS room FROM cost GROUP BY 1),
sums AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cost JOIN size ON c = conv_id),
own AS (SELECT *, floor(before / (room - least(longest, room // 2))) AS w FROM sums),
wins AS (SELECT conv_id AS c, w, lead(start) OVER (PARTITION BY conv_id ORDER BY w) AS next_start FROM (SELECT conv_id, w, min(before) AS start FROM own GROUP BY ALL)),
laid AS (SELECT conv_id, sum(length(shown) * (1 + CASE WHEN NOT system AND next_start - before <= 256 THEN 1 ELSE 0 END + CASE WHEN system THEN (SELECT count(*) - 1 FROM wins x WHERE x.c = conv_id) ELSE 0 END)) AS chars FROM own JOIN wins ON wins.c = conv_id AND wins.w = own.w GROUP BY 1),
digest AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(said, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learned FROM shown GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM digest JOIN laid USING (conv_id)"""

#: Hex digits of the bytes; every window by its digest; runs of covered bytes from the windows' starts.
_COVERED = """hit{n} AS (SELECT doc_id, i AS first, i + {n} AS last FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS often FROM (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 2 * {n})) AS h FROM (SELECT doc_id, hx, unnest(range(0, n - {n} + 1)) AS i FROM body WHERE n >= {n}))) WHERE often > 1),
run{n} AS (SELECT doc_id, min(first) AS first, max(last) AS last FROM (SELECT *, sum(CASE WHEN first <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY first) AS island FROM (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit{n})) GROUP BY doc_id, island)"""
OP4 = f"""WITH body AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS hx, strlen(coalesce(text, '')) AS n FROM documents), {_COVERED.format(n=400)}, {_COVERED.format(n=240)},
cut AS (SELECT doc_id, first, last, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS free FROM (SELECT * FROM run400 UNION ALL SELECT doc_id, n, n FROM body)),
kept AS (SELECT doc_id, string_agg(substr(hx, 2 * free + 1, 2 * (first - free)), '' ORDER BY first, last) AS hx FROM cut JOIN body USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(last - first) AS n, count(*) AS spans FROM run400 GROUP BY 1), more AS (SELECT doc_id, sum(last - first) AS n FROM run240 GROUP BY 1)
SELECT body.doc_id, body.n AS n_bytes, CAST(coalesce(sums.n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.hx)) AS kept_sha256, CAST(coalesce(more.n, 0) AS BIGINT) AS n_repeated_240
 FROM body JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN more USING (doc_id)"""

#: Exploded n-grams of one to three words, their counts, and for each word the longest that occurs twice or more.
OP9 = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT doc_id, words[i] AS a, CASE WHEN i > 1 THEN words[i - 1] || ' ' || words[i] END AS b, CASE WHEN i > 2 THEN words[i - 2] || ' ' || words[i - 1] || ' ' || words[i] END AS c, CASE WHEN i > 1 THEN words[i - 1] END AS pa, CASE WHEN i > 2 THEN words[i - 2] || ' ' || words[i - 1] END AS pb FROM t),
ca AS (SELECT a AS k, count(*) AS n FROM g GROUP BY 1), cb AS (SELECT b AS k, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1), cc AS (SELECT c AS k, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY 1),
s AS (SELECT doc_id, CASE WHEN cc.n >= 2 THEN ln(cc.n / pb.n) WHEN cb.n >= 2 THEN ln(cb.n / pa.n) + CASE WHEN c IS NULL THEN 0 ELSE ln(0.4) END ELSE ln(ca.n / (SELECT count(*) FROM g)) + CASE WHEN c IS NOT NULL THEN 2 * ln(0.4) WHEN b IS NOT NULL THEN ln(0.4) ELSE 0 END END AS score
 FROM g JOIN ca ON ca.k = a LEFT JOIN cb ON cb.k = b LEFT JOIN cc ON cc.k = c LEFT JOIN ca pa ON pa.k = g.pa LEFT JOIN cb pb ON pb.k = g.pb),
d AS (SELECT doc_id, count(*) AS n_tokens, sum(score) AS score FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(score, 0), 4) AS score, round(score / n_tokens, 6) AS per_token FROM documents LEFT JOIN d USING (doc_id)"""

#: Sentences end behind closing punctuation or at a line's end; spans of two, or a text's only one; all but the first of each go.
OP10 = r"""WITH b AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?…。！？]+["''”’)\]]*\s+|\n\s*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents),
s AS (SELECT doc_id, text, CASE WHEN len(p) > 1 AND regexp_full_match(p[1], '\s*') THEN list_prepend(p[1] || p[2], p[3:]) ELSE p END AS parts FROM b),
k AS (SELECT doc_id, i, list_transform(parts[i:i + 1], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS span FROM (SELECT doc_id, parts, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS i FROM s WHERE len(parts) > 0)),
g AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS r FROM k WHERE array_to_string(span, '') <> '') WHERE r > 1),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS j FROM g), e AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM s),
o AS (SELECT doc_id, coalesce(string_agg(part, '' ORDER BY j) FILTER (c.j IS NULL), '') AS kept, count(c.j) AS n_removed FROM e LEFT JOIN c USING (doc_id, j) GROUP BY 1)
SELECT s.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, CAST(len(parts) AS BIGINT) AS n_sentences, coalesce(n_removed, 0) AS n_removed FROM s LEFT JOIN o USING (doc_id)"""

#: Distinct five-word shingles, every pair of texts that share one with its intersection, and what is reached over links.
OP12 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.reach = e.u),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

#: Every anchor's score with every row; positives by rank; of each positive's window of other labels the first five.
OP13 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
 WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
