"""DuckDB SQL twins of the registered queries (tables are pre-registered views).

Fixed values shared with the Spark side (rule table, word pattern, draw salts)
are imported, not repeated, so both sides always use the same constants.
"""

from __future__ import annotations

from corpusgrid.functions.text import (ACCENTED, DEFAULT_ENTITY_RULES, IDEOGRAPHS, MAX_CHARS_PER_WORD, PUNCTUATION, UNACCENTED, UNICODE_DROPPED,
                                       UNICODE_SPACE, WORD_PATTERN_POSIX)
from corpusgrid.operators.sequences import CONTINUATION, SPECIALS

SQL: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mentions_sql(keep_empty: bool = False) -> str:
    parts = []
    for etype, pattern in DEFAULT_ENTITY_RULES:
        parts.append(
            f"SELECT doc_id, {_q(etype)} AS type, CAST(pos AS INTEGER) AS pos, token FROM ("
            f"SELECT doc_id, UNNEST(m) AS token, UNNEST(generate_series(0, len(m) - 1)) AS pos FROM ("
            f"SELECT doc_id, regexp_extract_all(text, {_q(pattern)}) AS m FROM documents))")
    body = " UNION ALL ".join(parts)
    if keep_empty:
        body = (f"SELECT d.doc_id, m.type, m.pos, m.token FROM documents d "
                f"LEFT JOIN ({body}) m ON d.doc_id = m.doc_id")
    return body


_SCORES = f"""
m AS ({mentions_sql()}),
c AS (SELECT type, token, count(*) AS cnt FROM m GROUP BY type, token),
t AS (SELECT type, avg(cnt) AS mean_count FROM c GROUP BY type),
s AS (SELECT c.type, c.token, c.cnt, t.mean_count, ln(c.cnt / t.mean_count) AS score
      FROM c JOIN t USING (type)),
a AS (SELECT d.doc_id, CAST(count(m.token) AS BIGINT) AS n_mentions, round(avg(s.score), 6) AS score
      FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
      LEFT JOIN s ON m.type = s.type AND m.token = s.token GROUP BY d.doc_id)
"""

SQL["entity_mentions"] = mentions_sql()


def _gazetteer_sql() -> str:
    words = ("regexp_extract_all(translate(lower(text), " + _q(ACCENTED) + ", " + _q(UNACCENTED) + "), "
             + _q(WORD_PATTERN_POSIX) + ")")
    return f"""WITH m AS ({mentions_sql()}),
top AS (SELECT token, count(*) AS cnt FROM m WHERE type = 'CAP' GROUP BY token),
pairs AS (SELECT UNNEST(regexp_extract_all(text, '[A-Z][a-z]{{3,}} [A-Z][a-z]{{3,}}')) AS token FROM documents),
gaz AS (SELECT lower(token) AS phrase FROM top UNION SELECT lower(token) FROM pairs),
w AS (SELECT doc_id, UNNEST(ws) AS word, UNNEST(generate_series(0, len(ws) - 1)) AS start
      FROM (SELECT doc_id, {words} AS ws FROM documents)),
grams AS (SELECT doc_id, start * 2 AS pos, word AS gram FROM w
          UNION ALL
          SELECT doc_id, start * 2 + 1, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY start) FROM w)
SELECT doc_id, 'KNOWN' AS type, CAST(pos AS INTEGER) AS pos, gram AS token
FROM grams JOIN gaz ON gram = phrase"""


SQL["gazetteer_mentions"] = _gazetteer_sql()
SQL["token_counts"] = f"SELECT type, token, CAST(count(*) AS BIGINT) AS count FROM ({mentions_sql()}) GROUP BY type, token"
SQL["token_specificity"] = f"""WITH {_SCORES}
SELECT type, token, cnt AS count, round(mean_count, 6) AS mean_count, round(score, 6) AS score FROM s"""
SQL["article_specificity"] = f"WITH {_SCORES} SELECT doc_id, n_mentions, score FROM a"
SQL["top_specific_articles"] = f"""WITH {_SCORES}
SELECT a.doc_id, d.source, a.n_mentions, a.score FROM a JOIN documents d USING (doc_id)
WHERE a.score IS NOT NULL ORDER BY a.score DESC, a.doc_id LIMIT 20"""


# ---------------------------------------------------------------- W5, W16, W14, W13
_SCAN = f"""{_SCORES},
j AS (SELECT d.doc_id, d.text, d.source, a.score FROM documents d JOIN a USING (doc_id)
      WHERE a.score IS NOT NULL AND NOT isnan(a.score)),
scan AS (SELECT DISTINCT doc_id, text, source, score FROM j)
"""
SQL["scored_scan"] = f"WITH {_SCAN} SELECT doc_id, text, source, score FROM scan"
SQL["sample_rows"] = """SELECT doc_id, source, n_chars FROM documents
ORDER BY ('0x' || substr(md5('42:sample:' || CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT, doc_id LIMIT 100"""
SQL["split_random"] = """WITH r AS (
  SELECT doc_id, source,
         row_number() OVER (ORDER BY ('0x' || substr(md5('42:split:' || CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT,
                                     doc_id) - 1 AS rk,
         count(*) OVER () AS n FROM documents)
SELECT doc_id, source, CASE WHEN rk < ceil(0.25 * n) THEN 'test' ELSE 'train' END AS split FROM r"""


def _tail_sql(cutoff: float, train_tail: bool) -> str:
    top, bottom = ("test", "train") if train_tail else ("train", "test")
    return f"""WITH {_SCAN},
r AS (SELECT doc_id, source, score, row_number() OVER (ORDER BY score ASC NULLS FIRST, doc_id) - 1 AS rk,
             count(*) OVER () AS n FROM scan),
k AS (SELECT *, CAST(floor({cutoff} * n) AS BIGINT) AS cut FROM r)
SELECT doc_id, source, score, '{top}' AS split FROM k WHERE rk >= n - cut
UNION ALL SELECT doc_id, source, score, '{bottom}' AS split FROM k WHERE rk < cut"""


SQL["split_tail"] = _tail_sql(0.5, False)
SQL["split_tail_swapped"] = _tail_sql(0.5, True)
SQL["split_tail_overlap"] = _tail_sql(0.7, False)


# ---------------------------------------------------------------- W15, W17
def _draw(salt: str, seed=42) -> str:
    return f"('0x' || substr(md5('{seed}:{salt}:' || CAST(k AS VARCHAR)), 1, 12))::BIGINT"


def negatives_sql(ratio: float, draws: int, seed=42, label: str = "source") -> str:
    return f"""WITH m AS ({mentions_sql()}),
lb AS (SELECT doc_id, {label} AS label FROM documents),
inc AS (SELECT DISTINCT type, doc_id FROM m),
r AS (SELECT type, doc_id, row_number() OVER (ORDER BY type, doc_id) - 1 AS g FROM inc),
st AS (SELECT type, min(g) AS t_start, count(*) AS n_t FROM r GROUP BY type),
inc2 AS (SELECT r.g, r.doc_id, st.t_start, st.n_t FROM r JOIN st USING (type)),
tot AS (SELECT count(*) AS n_inc FROM inc),
draws AS (SELECT k, {_draw("a", seed)} AS r1, {_draw("b", seed)} AS r2 FROM range(0, {draws}) t(k)),
d1 AS (SELECT d.k, i.doc_id AS doc1,
              i.t_start + (i.g - i.t_start + 1 + d.r2 % (i.n_t - 1)) % i.n_t AS g2
       FROM draws d CROSS JOIN tot JOIN inc2 i ON i.g = d.r1 % tot.n_inc WHERE i.n_t >= 2),
d2 AS (SELECT d1.k, d1.doc1, i.doc_id AS doc2 FROM d1 JOIN inc2 i ON i.g = d1.g2),
p AS (SELECT least(doc1, doc2) AS a, greatest(doc1, doc2) AS b, min(k) AS k FROM d2 GROUP BY 1, 2),
lab AS (SELECT p.a, p.b, p.k, da.label AS label_a, db.label AS label_b
        FROM p JOIN lb da ON da.doc_id = p.a JOIN lb db ON db.doc_id = p.b
        WHERE da.label <> db.label),
pr AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS pr FROM lab),
n AS (SELECT CAST(floor({ratio} * count(*)) AS BIGINT) AS target FROM documents),
rw AS (SELECT a AS doc_id, label_b AS label, b AS source_doc_id, 2 * pr AS neg_index FROM pr
       UNION ALL SELECT b, label_a, a, 2 * pr + 1 FROM pr)
SELECT rw.doc_id, d.text AS sentence, rw.label, rw.source_doc_id, rw.neg_index
FROM rw CROSS JOIN n JOIN documents d ON d.doc_id = rw.doc_id WHERE rw.neg_index < n.target"""


SQL["type_frequencies"] = f"""WITH m AS ({mentions_sql()}),
per AS (SELECT type, count(DISTINCT doc_id) AS n_texts FROM m GROUP BY type)
SELECT type, n_texts, round(n_texts / sum(n_texts) OVER (), 6) AS frequency FROM per"""
# draws: enough that the first ceil(target/2) accepted pairs exist (draws only append)
SQL["negative_pairs"] = negatives_sql(1.0, 20000)
SQL["negative_pairs_ratio2"] = negatives_sql(2.0, 40000)
SQL["negative_pairs_skewed"] = negatives_sql(0.2, 150000, label="CASE WHEN doc_id % 400 = 0 THEN 'rare' ELSE 'common' END")
SQL["two_tower_pairs"] = f"""WITH neg AS ({negatives_sql(1.0, 20000)})
SELECT doc_id, source AS label, doc_id AS source_doc_id, 1 AS is_positive, '0,1' AS target FROM documents
UNION ALL SELECT doc_id, label, source_doc_id, 0 AS is_positive, '1,0' AS target FROM neg"""


# ---------------------------------------------------------------- W18, W12
def _words_expr(col: str = "text") -> str:
    return f"regexp_extract_all(translate(lower({col}), {_q(ACCENTED)}, {_q(UNACCENTED)}), {_q(WORD_PATTERN_POSIX)})"


def vocab_sql(size: int, words: str = "", source: str = "documents") -> str:
    words = words or _words_expr()
    specials = ", ".join(f"({_q(p)}, {i})" for p, i in SPECIALS)
    return f"""wc AS (SELECT word, count(*) AS cnt FROM (SELECT UNNEST({words}) AS word FROM {source}) GROUP BY word),
top AS (SELECT word AS piece FROM wc ORDER BY cnt DESC, word LIMIT {size}),
ch AS (SELECT DISTINCT UNNEST(string_split(word, '')) AS c FROM wc),
pc AS (SELECT piece FROM top UNION SELECT c FROM ch UNION SELECT {_q(CONTINUATION)} || c FROM ch),
sp AS (SELECT * FROM (VALUES {specials}) t(piece, id)),
vocab AS (SELECT piece, CAST(id AS INTEGER) AS id FROM sp
          UNION ALL SELECT piece, CAST({len(SPECIALS) - 1} + row_number() OVER (ORDER BY piece) AS INTEGER)
          FROM pc WHERE piece NOT IN (SELECT piece FROM sp))"""


def encode_sql(size: int, seq_len: int, words: str = "", source: str = "documents") -> str:
    # For a vocabulary that holds every character and its continuation form,
    # greedy longest-match-first = longest vocabulary prefix, then one
    # continuation piece per remaining character.
    cls = dict(SPECIALS)["[CLS]"]
    sep = dict(SPECIALS)["[SEP]"]
    unk = dict(SPECIALS)["[UNK]"]
    words = words or _words_expr()
    return f"""WITH {vocab_sql(size, words, source)},
dw AS (SELECT doc_id, UNNEST(ws) AS word, UNNEST(generate_series(1, len(ws))) AS pos
       FROM (SELECT doc_id, {words} AS ws FROM {source})),
uw AS (SELECT DISTINCT word FROM dw),
pre AS (SELECT uw.word, max(length(v.piece)) AS plen
        FROM (SELECT word, UNNEST(generate_series(1, length(word))) AS l FROM uw) uw
        JOIN vocab v ON v.piece = substr(uw.word, 1, uw.l) GROUP BY uw.word),
rest AS (SELECT p.word, UNNEST(string_split(substr(p.word, p.plen + 1), '')) AS c,
                UNNEST(generate_series(1, length(p.word) - p.plen)) AS cpos
         FROM pre p WHERE length(p.word) > p.plen),
restid AS (SELECT r.word, list(v.id ORDER BY r.cpos) AS ids FROM rest r
           JOIN vocab v ON v.piece = {_q(CONTINUATION)} || r.c GROUP BY r.word),
wp AS (SELECT p.word, CASE WHEN length(p.word) > {MAX_CHARS_PER_WORD} THEN [{unk}]
              ELSE list_concat([v.id], coalesce(restid.ids, [])) END AS ids
       FROM pre p JOIN vocab v ON v.piece = substr(p.word, 1, p.plen) LEFT JOIN restid USING (word)),
per AS (SELECT dw.doc_id, flatten(list(wp.ids ORDER BY dw.pos)) AS ids FROM dw JOIN wp USING (word) GROUP BY dw.doc_id),
full_ids AS (SELECT d.doc_id, list_concat([{cls}], coalesce(per.ids, []), [{sep}]) AS ids
             FROM documents d LEFT JOIN per USING (doc_id))
SELECT doc_id, CAST(len(ids) - 2 AS INTEGER) AS n_pieces,
       array_to_string(list_resize(ids, {seq_len}, 0), ',') AS input_ids FROM full_ids"""


SQL["vocabulary"] = f"WITH {vocab_sql(2000)} SELECT piece, id FROM vocab"
SQL["encode_sequences"] = encode_sql(2000, 128)
# the Unicode rule over code points: white space to spaces, control characters out, marks off, then one pattern
_UNICODE_WORDS = (f"regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(text, '{UNICODE_SPACE}', ' ', 'g'), '{UNICODE_DROPPED}', '', 'g'))), "
                  f"'[{IDEOGRAPHS}]|[{PUNCTUATION}]|[^ {IDEOGRAPHS}{PUNCTUATION}]+')")
_UNICODE_TEXTS = """(SELECT doc_id, concat_ws(' ', mixed, text, mixed) AS text FROM (SELECT doc_id, text,
  ['\u4e2d\u6587\u6587\u672c', 'Cafe\u0301\u00abna\u00efve\u00bb', '\u041f\u0440\u0438\u0432\u0435\u0442\u2014\u043c\u0438\u0440!', 'a\u200bb\u00adc', '\u03b5\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03ac'][doc_id % 5 + 1]
  || ['\u3000', '\u00a0', ' ', '\u2003x\u2009'][doc_id % 4 + 1] || ['\uff08\u5168\u89d2\uff09', '\u00bfqu\u00e9?', '$5+\u20ac7', '\u201cquoted\u201d'][doc_id % 4 + 1] AS mixed
  FROM documents))"""
SQL["vocabulary_unicode"] = f"WITH {vocab_sql(2000, _UNICODE_WORDS, _UNICODE_TEXTS)} SELECT piece, id FROM vocab"
SQL["encode_unicode"] = encode_sql(2000, 128, _UNICODE_WORDS, _UNICODE_TEXTS)
SQL["label_codes"] = """WITH l AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label_code
                      FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT d.doc_id, d.source, l.label_code, (SELECT CAST(count(*) AS INTEGER) FROM l) AS num_classes
FROM documents d JOIN l USING (source)"""
SQL["one_hot_labels"] = """WITH l AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code
                      FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
n AS (SELECT count(*) AS c FROM l)
SELECT d.doc_id, array_to_string(list_transform(range(0, n.c), lambda i: CAST(i = l.code AS INTEGER)), ',') AS label_onehot
FROM documents d JOIN l USING (source) CROSS JOIN n"""


# ---------------------------------------------------------------- W21, W22
_UNIT = """u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nrm AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS nv FROM u),
un AS (SELECT vec_id, label, list_transform(e, lambda x: x / nv) AS un FROM nrm WHERE nv > 0)"""
SQL["unit_vectors"] = f"""WITH {_UNIT}
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value
FROM (SELECT vec_id, UNNEST(un) AS value, UNNEST(generate_series(0, len(un) - 1)) AS dim FROM un)"""
SQL["nearest_neighbors"] = f"""WITH {_UNIT},
s AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, c.label,
             round(list_dot_product(q.un, c.un), 6) AS similarity FROM un q CROSS JOIN un c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS rank
      FROM s)
SELECT query_id, rank, neighbor_id, similarity, label FROM r WHERE rank <= 10"""


# ---------------------------------------------------------------- W25, W26
_PRED = f"""{_UNIT},
cd AS (SELECT label, dim, avg(val) AS c FROM (
         SELECT label, UNNEST(un) AS val, UNNEST(generate_series(0, len(un) - 1)) AS dim FROM un) GROUP BY label, dim),
cen AS (SELECT label, list(c ORDER BY dim) AS centroid FROM cd GROUP BY label),
sc AS (SELECT un.vec_id, un.label AS truth, cen.label AS cls, list_dot_product(un.un, cen.centroid) AS score
       FROM un CROSS JOIN cen),
pr AS (SELECT vec_id, truth, cls, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS r FROM sc),
pred AS (SELECT vec_id, truth, cls FROM pr WHERE r = 1)"""


def vmeasure_sql(source: str, a: str, b: str) -> str:
    return f"""cells AS (SELECT {a} AS a_, {b} AS b_, count(*) AS n FROM {source} GROUP BY 1, 2),
tn AS (SELECT sum(n) AS tot FROM cells),
ma AS (SELECT a_, sum(n) AS s FROM cells GROUP BY a_),
mb AS (SELECT b_, sum(n) AS s FROM cells GROUP BY b_),
hc AS (SELECT -sum(s / tot * ln(s / tot)) AS hc FROM ma CROSS JOIN tn),
hk AS (SELECT -sum(s / tot * ln(s / tot)) AS hk FROM mb CROSS JOIN tn),
hck AS (SELECT -sum(n / tot * ln(n / s)) AS hck FROM cells JOIN mb USING (b_) CROSS JOIN tn),
hkc AS (SELECT -sum(n / tot * ln(n / s)) AS hkc FROM cells JOIN ma USING (a_) CROSS JOIN tn),
hm AS (SELECT CASE WHEN hc <= 1e-15 THEN 1.0 ELSE 1 - hck / hc END AS h,
              CASE WHEN hk <= 1e-15 THEN 1.0 ELSE 1 - hkc / hk END AS c, tot
       FROM hc CROSS JOIN hk CROSS JOIN hck CROSS JOIN hkc CROSS JOIN tn)
SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness,
       round(CASE WHEN h + c = 0 THEN 0 ELSE 2 * h * c / (h + c) END, 6) AS v_measure, CAST(tot AS BIGINT) AS n FROM hm"""


SQL["accuracy"] = f"""WITH {_PRED}
SELECT round(avg(CASE WHEN cls = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pred"""
SQL["v_measure"] = f"WITH {_PRED}, {vmeasure_sql('pred', 'truth', 'cls')}"
SQL["v_measure_labels"] = f"WITH {vmeasure_sql('labels', 'quality', 'toxic')}"


# ---------------------------------------------------------------- W1 - W3, W28
_EXPECTED_ARTICLES = """SELECT 'd' || CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN lang = 'es' THEN NULL ELSE text END AS abstract,
  source || ' ' || CAST(doc_id AS VARCHAR) AS headline, source AS desk,
  strftime(day, '%Y-%m-%d') AS date,
  lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((doc_id * 7) % 60 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST((doc_id * 13) % 60 AS VARCHAR), 2, '0') AS time,
  CASE WHEN source = 'src9' THEN 'EMPTY' WHEN source = 'src11' THEN NULL ELSE lang END AS section,
  CASE WHEN lang = 'fr' THEN NULL ELSE text END AS snippet,
  CASE WHEN source = 'src13' THEN 'EMPTY' ELSE 'Archive' END AS source,
  'News' AS type,
  CASE WHEN lang = 'de' THEN 0 ELSE CAST(trunc(n_chars / 5) AS INTEGER) END AS word_count,
  day AS pub_date
FROM (SELECT *, CAST(DATE '2019-01-01' + CAST(trunc(doc_id / 3) AS INTEGER) AS DATE) AS day FROM documents)
WHERE source NOT IN ('src3', 'src5', 'src17')"""
SQL["parse_articles"] = _EXPECTED_ARTICLES
SQL["incremental_ingest"] = _EXPECTED_ARTICLES
SQL["ingest_backfill"] = _EXPECTED_ARTICLES
SQL["bulk_load"] = f"SELECT CAST(year(pub_date) AS INTEGER) AS year, CAST(month(pub_date) AS INTEGER) AS month, * FROM ({_EXPECTED_ARTICLES})"
SQL["archive_rejects"] = """SELECT 'document without _id' AS reason, count(*) AS n FROM documents WHERE source = 'src17'"""
_BOUNDS = """b AS (SELECT CAST(date_trunc('year', min(o_orderdate)) AS DATE) AS s,
                CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS e FROM orders),
cal AS (SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month
        FROM (SELECT UNNEST(generate_series(s, e, INTERVAL 1 MONTH)) AS m FROM b))"""
SQL["month_calendar"] = f"WITH {_BOUNDS} SELECT year, month FROM cal"
SQL["month_report"] = f"""WITH {_BOUNDS},
c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
             count(*) AS n FROM orders GROUP BY 1, 2)
SELECT cal.year, cal.month, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows FROM cal LEFT JOIN c USING (year, month)"""
SQL["day_interval"] = """SELECT o_orderkey,
  CAST(strftime(CAST(o_orderdate AS DATE) - 7, '%Y%m%d') AS INTEGER) AS that_day,
  CAST(strftime(CAST(o_orderdate AS DATE) - 8, '%Y%m%d') AS INTEGER) AS day_before FROM orders"""
SQL["stream_neighbors"] = f"""WITH {_UNIT},
s AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
             round(list_dot_product(q.un, c.un), 6) AS similarity FROM un q CROSS JOIN un c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS rank
      FROM s)
SELECT query_id, rank, neighbor_id, similarity FROM r WHERE rank <= 10"""

# ---------------------------------------------------------------- W7
SQL["export_tsv"] = """SELECT vec_id AS "order", label,
       array_to_string(list_transform(embedding, lambda x: printf('%.18e', x::DOUBLE)), chr(9)) AS line
FROM embeddings"""

# ---------------------------------------------------------------- W27: facts of any complete Ward tree
SQL["hierarchical_facts"] = """WITH x AS (SELECT vec_id, UNNEST(CAST(embedding AS DOUBLE[])) AS v, UNNEST(generate_series(1, len(embedding))) AS d FROM embeddings),
s AS (SELECT d, sum(v * v) - sum(v) * sum(v) / count(*) AS spread, count(*) AS n FROM x GROUP BY d)
SELECT CAST(max(n) - 1 AS BIGINT) AS n_merges, round(sum(spread), 6) AS total_cost, CAST(max(n) AS BIGINT) AS n_root, CAST(max(n) AS BIGINT) AS n_vectors FROM s"""

# ---------------------------------------------------------------- W22 through a stored index
SQL["index_neighbors_exact"] = SQL["stream_neighbors"]
SQL["index_recall"] = f"""WITH {_UNIT}, n AS (SELECT count(*) AS n FROM un)
SELECT CAST(n AS BIGINT) AS n_queries, CAST(n * least(n, 10) AS BIGINT) AS n_exact, n > 0 AS reached FROM n"""

# ---------------------------------------------------------------- W28b from texts
SQL["text_neighbors"] = f"""WITH w AS (SELECT 'd' AS side, doc_id AS id, UNNEST({_words_expr()}) AS word FROM documents
  UNION ALL SELECT 'q', item_id, UNNEST({_words_expr()}) FROM benchmark),
c AS (SELECT side, id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY 1, 2, 3),
l AS (SELECT side, id, sqrt(sum(n * n)) AS size FROM c GROUP BY 1, 2),
u AS (SELECT c.side, c.id, bucket, n / size AS v FROM c JOIN l ON c.side = l.side AND c.id = l.id),
s AS (SELECT q.id AS item_id, d.id AS neighbor_id, round(sum(q.v * d.v), 6) AS similarity
      FROM u q JOIN u d ON q.side = 'q' AND d.side = 'd' AND q.bucket = d.bucket GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, neighbor_id, similarity, text FROM r JOIN documents ON doc_id = neighbor_id WHERE rank <= 5"""
