"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from corpusgrid.llm import license_scan

SQL: dict[str, str] = {}

SQL["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT keyed.*, coalesce(first_doc < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op7_exact_dedup"] = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
groups AS (
  SELECT body, count(*)::BIGINT AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM norm GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM norm JOIN groups USING (body)
"""


def regex_of(parts: list) -> str:
    """A template as a regular expression over words with a space on both sides of each."""
    out = ""
    for part in parts:
        if isinstance(part, str):
            out += f" {part} "
        elif isinstance(part, tuple):
            out += "(?: [^ ]+ ){%d,%d}" % part
        else:
            out += f"(?:{regex_of(part)})?"
    return out


_PLACES = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + ")" for phrase, _ in license_scan.BASE)
_BASE = ", ".join(f"CASE WHEN contains(spaced, '{''.join(f' {x} ' for x in phrase.split())}') THEN '{label}' END" for phrase, label in license_scan.BASE)
_OWN = ", ".join(f"CASE WHEN regexp_matches(spaced, '{regex_of(license_scan.parsed(markup))}') THEN '{label}' END"
                 for label, markup in license_scan.TEMPLATES)
SQL["op13_license_scans"] = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (
  SELECT doc_id, w, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS spaced,
         list_filter(range(1, len(w) + 1), lambda i: {_PLACES}) AS places FROM words),
labelled AS (
  SELECT *, list_sort(list_distinct(list_filter([{_BASE}], lambda x: x IS NOT NULL))) AS base,
         list_filter([{_OWN}], lambda x: x IS NOT NULL) AS own FROM placed)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM labelled
"""
