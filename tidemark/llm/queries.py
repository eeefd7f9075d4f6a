"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import boilerplate, bpe, langid, leakage, lookalike, mojibake, sitelines, truncation
from tidemark.session import table


def queries() -> dict:
    t = table
    return {
        "p1_found": lambda s, d: truncation.p1_found(t(s, d, "articles")),
        "p1_evidence": lambda s, d: truncation.p1_evidence(t(s, d, "articles")),
        "p1_sources": lambda s, d: truncation.p1_sources(t(s, d, "articles")),
        "p3_found": lambda s, d: boilerplate.p3_found(t(s, d, "articles"), t(s, d, "collector_clocks"), t(s, d, "lang_samples")),
        "p3_body": lambda s, d: boilerplate.main_body(t(s, d, "articles"), t(s, d, "collector_clocks"), t(s, d, "lang_samples")),
        "p4_budget": lambda s, d: bpe.p4_budget(t(s, d, "articles")),
        "p4_tokens": lambda s, d: bpe.p4_tokens(t(s, d, "articles")),
        "p5_found": lambda s, d: langid.p5_found(t(s, d, "articles"), t(s, d, "lang_samples")),
        "p5_languages": lambda s, d: langid.p5_languages(t(s, d, "articles"), t(s, d, "lang_samples")),
        "p5_segments": lambda s, d: langid.p5_segments(t(s, d, "articles"), t(s, d, "lang_samples")),
        "p6_found": lambda s, d: sitelines.p6_found(t(s, d, "articles")),
        "p6_cleaned": lambda s, d: sitelines.cleaned(t(s, d, "articles"), sitelines.p6_found(t(s, d, "articles"))),
        "p7_found": lambda s, d: lookalike.p7_found(t(s, d, "articles")),
        "p7_consistent": lambda s, d: lookalike.consistent(t(s, d, "articles").select("id", "title", "content"), ["title", "content"], "_folded"),
        "p8_ids": lambda s, d: bpe.p8_ids(t(s, d, "documents")),
        "p9_found": lambda s, d: leakage.p9_found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_report": lambda s, d: leakage.p9_report(t(s, d, "documents"), t(s, d, "eval_items")),
        "p10_found": lambda s, d: mojibake.p10_found(t(s, d, "documents")),
        "p10_restored": lambda s, d: mojibake.p10_restored(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6, "p6_cleaned": P6_CLEANED, "p7_found": P7, "p9_found": P9}


# Lines by their form, as TESTDATA.md defines them; RE2's [:space:] plus the wider blanks stand for white space.
P6 = r"""
WITH lines AS (
  SELECT DISTINCT id, source_uri, generate_subscripts(string_split(content, chr(10)), 1) AS line_no, unnest(string_split(content, chr(10))) AS line
  FROM articles WHERE content IS NOT NULL AND source_uri IS NOT NULL
), forms AS (
  SELECT id, source_uri, line_no,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '', 'g'), '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ') AS form
  FROM lines
), sizes AS (SELECT source_uri, count(DISTINCT id) AS n_ids FROM articles WHERE source_uri IS NOT NULL GROUP BY source_uri),
often AS (
  SELECT f.source_uri, form FROM forms f JOIN sizes s ON f.source_uri = s.source_uri WHERE form <> ''
  GROUP BY f.source_uri, form, n_ids HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) >= 0.05 * n_ids
)
SELECT DISTINCT f.id AS id, CAST(f.line_no AS INTEGER) AS line_no FROM forms f JOIN often o ON f.source_uri = o.source_uri AND f.form = o.form
"""

P6_CLEANED = (
    "WITH gone AS (SELECT id, list(line_no) AS g FROM (" + P6 + """) GROUP BY id)
SELECT a.id, CASE WHEN g IS NULL THEN content ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT list_contains(g, CAST(i AS INTEGER))), chr(10)) END AS content
FROM articles a LEFT JOIN gone USING (id)"""
)

# Fields by classes of characters: not composed, blanks other than the usual one, characters that show nothing, forms of
# other widths and styles, hyphens that look like the usual one, letters of two scripts side by side.
P7 = r"""
WITH f AS (SELECT DISTINCT id, 'title' AS field_name, title AS x FROM articles UNION SELECT DISTINCT id, 'content', content FROM articles)
SELECT id, field_name FROM f WHERE id IS NOT NULL AND x IS NOT NULL AND (x <> nfc_normalize(x)
  OR regexp_matches(x, '[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')
  OR regexp_matches(x, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{34f}\x{61c}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]')
  OR regexp_matches(x, '[\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}\x{ff02}\x{ff07}\x{ff0e}\x{ff3b}-\x{ff40}\x{ff61}-\x{ffdc}\x{fb00}-\x{fb06}\x{1d400}-\x{1d7ff}\x{2100}-\x{2115}\x{2119}-\x{211d}\x{2124}-\x{2138}\x{2160}-\x{217f}\x{2010}\x{2011}]')
  OR regexp_matches(x, '[\p{Latin}][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{Latin}]'))
GROUP BY id, field_name
"""

# Runs of 13 words of documents and items, joined exactly.
P9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
"""
