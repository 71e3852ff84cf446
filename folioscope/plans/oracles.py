"""DuckDB SQL that gives the same rows as the queries of the same names."""

from __future__ import annotations

_TEXT = r"""
d AS (SELECT *, coalesce(full_text, '') AS raw, replace(replace(coalesce(full_text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
p AS (SELECT *, string_split(t, chr(10)) AS parts FROM d),
l AS (SELECT *, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM p)"""
_SCORES = (
    "WITH"
    + _TEXT
    + r""",
h AS (SELECT *, array_to_string(lines[1:20], chr(10) || chr(10)) AS head20, array_to_string(lines[1:10], chr(10) || chr(10)) AS head10 FROM l),
s AS (SELECT *,
 ((CASE WHEN regexp_matches(head20, '(?im)^From:\s+.+') THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(head20, '(?im)^To:\s+.+') THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(head20, '(?im)^Subject:\s+.+') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(head20, '(?im)^Sent:\s+\d{1,2}/\d{1,2}/\d{4}') THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(head20, '(?im)tracked@example\.org') THEN 1 ELSE 0 END)) / 5.0::DOUBLE AS mail_score,
 least((CASE WHEN len(lines) > 100 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(head10, '(?m)^(From|To|Subject|Sent):') THEN 0 ELSE 0.3::DOUBLE END)
  + (CASE WHEN contains(raw, '(L to R)') THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(raw, '(?i)photograph(?:ed|er)') THEN 0.2::DOUBLE ELSE 0 END), 1.0::DOUBLE) AS narrative_score,
 least((CASE WHEN regexp_matches(raw, '<https?://') THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(raw, '(?i)<!DOCTYPE|<html|<body') THEN 0.3::DOUBLE ELSE 0 END)
  + (CASE WHEN length(raw) - length(replace(raw, '<', '')) > 20 THEN 0.3::DOUBLE ELSE 0 END), 1.0::DOUBLE) AS html_score FROM h),
c AS (SELECT *, greatest(mail_score, narrative_score, html_score) AS best FROM s),
k AS (SELECT *, CASE WHEN best < 0.3 THEN 'unknown' WHEN mail_score = best THEN 'email' WHEN narrative_score = best THEN 'narrative' ELSE 'html_email' END AS kind,
 CASE WHEN length(raw) < 100 THEN 1 ELSE 0 END + CASE WHEN length(raw) - length(replace(raw, chr(65533), '')) > 5 THEN 1 ELSE 0 END + CASE WHEN len(lines) = 0 THEN 1 ELSE 0 END AS n_issues,
 (CASE WHEN regexp_matches(raw, '(?i)\bTrust\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(raw, '(?i)\bUniversity\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(raw, '(?i)\bSubcommittee\b') THEN 1 ELSE 0 END)
  + (CASE WHEN regexp_matches(raw, '(?i)\bFoundations?\b') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(raw, '(?i)\b(?:Klopowiwen\s+)?Aviation\b') THEN 1 ELSE 0 END) AS n_seeds FROM c)"""
)
_SEEDS = r"""(VALUES ('Trust', '(?i)\bTrust\b'), ('University', '(?i)\bUniversity\b'), ('Subcommittee', '(?i)\bSubcommittee\b'), ('Foundation', '(?i)\bFoundations?\b'), ('Aviation', '(?i)\b(?:Klopowiwen\s+)?Aviation\b')) AS seed(name, pattern)"""
_NAMED = "named AS (SELECT DISTINCT m.doc_id, e.text AS entity_name FROM document_entities m JOIN entities e USING (entity_id))"
_MAILS = "mails AS (SELECT doc_id, any_value(from_addr) AS from_addr, any_value(to_addrs) AS to_addrs, any_value(cc_addrs) AS cc_addrs, any_value(subject) AS subject, any_value(date) AS date, any_value(in_reply_to) AS in_reply_to, any_value(is_reply) AS is_reply, any_value(all_participants) AS all_participants, any_value(parsing_issues) AS parsing_issues FROM email_metadata GROUP BY doc_id)"
_THREADS = "threads AS (SELECT doc_id, message_index, any_value(author) AS author, any_value(date) AS date FROM thread_messages GROUP BY doc_id, message_index)"
_FOLD = "strip_accents(lower(coalesce({0}, '')))"
_TOKENS = "list_filter(regexp_split_to_array(" + _FOLD + r", '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_POSTINGS = "tok AS (SELECT doc_id, " + _TOKENS.format("full_text") + " AS ts FROM documents), pos AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM tok), sz AS (SELECT doc_id, len(ts) AS len FROM tok), corp AS (SELECT count(*) AS docs, avg(len) AS mean FROM sz)"
_BM = "(CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))"
_PAIRS = r"""
w AS (SELECT *, left(normalized_text, 3) AS prefix, length(normalized_text) AS n, list_distinct(list_filter(regexp_split_to_array(lower(normalized_text), '\s+'), lambda x: x <> '')) AS ws
      FROM entities WHERE normalized_text IS NOT NULL AND normalized_text <> '' AND occurrence_count >= 2 AND entity_id IN (SELECT entity_id FROM entity_aliases WHERE is_canonical)),
j AS (SELECT a.type, a.entity_id AS entity1_id, a.text AS entity1_text, a.occurrence_count AS entity1_count, b.entity_id AS entity2_id, b.text AS entity2_text, b.occurrence_count AS entity2_count,
      a.normalized_text AS x, b.normalized_text AS y, len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))) AS jaccard
      FROM w a JOIN w b ON a.type = b.type AND a.prefix = b.prefix AND abs(a.n - b.n) <= 3 AND (a.occurrence_count > b.occurrence_count OR (a.occurrence_count = b.occurrence_count AND a.entity_id < b.entity_id))),
v AS (SELECT *, CASE WHEN regexp_matches(x || y, '[^ -~]') THEN levenshtein(regexp_replace(translate(x, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿøæß', 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿøæß'), '[àáâãäå]', 'A', 'g').replace('ç', 'C').replace('è', 'D').replace('é', 'E').replace('ê', 'F').replace('ë', 'G').replace('í', 'I').replace('ñ', 'N').replace('ò', 'O').replace('ó', 'P').replace('ô', 'Q').replace('ö', 'R').replace('ø', 'S').replace('ü', 'U').replace('æ', 'V').replace('ß', 'W'),
      regexp_replace(y, '[àáâãäå]', 'A', 'g').replace('ç', 'C').replace('è', 'D').replace('é', 'E').replace('ê', 'F').replace('ë', 'G').replace('í', 'I').replace('ñ', 'N').replace('ò', 'O').replace('ó', 'P').replace('ô', 'Q').replace('ö', 'R').replace('ø', 'S').replace('ü', 'U').replace('æ', 'V').replace('ß', 'W')) ELSE levenshtein(x, y) END AS lev FROM j WHERE jaccard > 0),
u AS (SELECT *, least((CASE lev WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.85::DOUBLE WHEN 3 THEN 0.70::DOUBLE ELSE 0.5::DOUBLE END)
      + (CASE WHEN jaccard >= 0.8 THEN 0.10::DOUBLE WHEN jaccard >= 0.5 THEN 0.05::DOUBLE ELSE 0 END)
      + (CASE WHEN greatest(entity1_count, entity2_count) > 10 AND least(entity1_count, entity2_count)::DOUBLE / greatest(entity1_count, entity2_count) < 0.1 THEN 0.05::DOUBLE ELSE 0 END)
      - (CASE WHEN jaccard < 0.3 THEN 0.15::DOUBLE ELSE 0 END), 1.0::DOUBLE) AS conf0 FROM v WHERE lev <= 3),
c AS (SELECT *, CASE WHEN lev = 0 THEN 1.0::DOUBLE ELSE conf0 END AS conf FROM u),
cand AS (SELECT * FROM c WHERE conf >= 0.70)"""
_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY updated_at DESC, coalesce(total_mentions, -1) DESC, coalesce(canonical_text, '') DESC) AS k FROM canonical_entities WHERE canonical_id IS NOT NULL) WHERE k = 1)"
_LINKED = r"""m AS (SELECT doc_id, 'See ' || url || ' and HTTP://youtu.be/x then ' || url AS text, url FROM (SELECT doc_id, 'https://' || lower(regexp_extract(from_addr, '@([^>\s]+)', 1)) || '/m/' || doc_id || CASE WHEN is_reply = 1 THEN '.pdf' ELSE '?id=1' END AS url FROM mails WHERE from_addr LIKE '%@%')),
u AS (SELECT doc_id, url, 4 AS position FROM m UNION ALL SELECT doc_id, 'HTTP://youtu.be/x', 4 + length(url) + 5 FROM m),
k AS (SELECT doc_id, url, position, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain FROM u),
z AS (SELECT *, CASE WHEN contains(domain, 'youtube.com') OR contains(domain, 'youtu.be') THEN 'youtube' WHEN contains(lower(url), '.pdf') THEN 'pdf'
  WHEN regexp_matches(domain, 'news|times|post|reuters|cnn|bbc') THEN 'news' WHEN regexp_matches(domain, 't\.co|twitter\.com|x\.com') THEN 'social' ELSE 'other' END AS type FROM k)"""
_CLS = (
    "WITH"
    + _TEXT
    + r""",
c AS (SELECT doc_id, left(regexp_replace(t, '^\x{FEFF}', ''), 51200) AS content FROM d),
h AS (SELECT *, left(content, 2000) AS head, left(content, 3000) AS head3 FROM c),
g AS (SELECT *, (CASE WHEN regexp_matches(head, '(?i)Case\s+\d+:\d+-[a-z]+-\d+') THEN 0.4::DOUBLE ELSE 0 END)
  + (CASE WHEN regexp_matches(head, '(?i)UNITED\s+STATES\s+DISTRICT\s+COURT|UNITED\s+STATES\s+COURT\s+OF\s+APPEALS') THEN 0.3::DOUBLE ELSE 0 END)
  + (CASE WHEN regexp_matches(head, '(?i)Document\s+\d+\s+Filed\s+\d+/\d+/\d+') THEN 0.2::DOUBLE ELSE 0 END)
  + (CASE WHEN regexp_matches(head3, '(?i)DEPOSITION|EXAMINATION\s+OF') THEN 0.3::DOUBLE ELSE 0 END)
  + (CASE WHEN regexp_matches(head, '(?i)MOTION\s+(?:TO|FOR)|MEMORANDUM\s+OF\s+LAW') THEN 0.2::DOUBLE ELSE 0 END) AS legal,
  list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20) AS long FROM h),
f AS (SELECT doc_id, legal, CASE WHEN regexp_matches(head, 'From:\s+.+\nTo:\s+.+\nSubject:\s+.+\nSent:\s+\d+/\d+/\d+') THEN 'email' WHEN legal >= 0.5 THEN 'legal'
  WHEN regexp_matches(head, '(?m)^By\s+[A-Z][a-z]+\s+[A-Z][a-z]+') OR regexp_matches(head, '(?i)(?:Palm\s+Beach\s+Post|New\s+York\s+Times|Washington\s+Post|Wall\s+Street\s+Journal)') THEN 'news'
  WHEN regexp_matches(head, '(?i)CONGRESSIONAL\s+RECORD') THEN 'congressional'
  WHEN len(long) >= 10 AND regexp_matches(content, '(?i)\bI\s+(?:have|was|am|had|did|said|went|saw|thought|felt|believe|remember|knew)\b') AND len(list_filter(long, lambda x: length(x) > 200)) > 0 THEN 'narrative' ELSE 'other' END AS found_type,
  CASE WHEN regexp_matches(head, '(?i)MOTION\s+(?:TO|FOR)|MEMORANDUM\s+OF\s+LAW') THEN 'motion' WHEN regexp_matches(head3, '(?i)DEPOSITION|EXAMINATION\s+OF') THEN 'deposition' WHEN regexp_matches(head, '(?i)Case\s+\d+:\d+-[a-z]+-\d+') THEN 'court_filing' END AS sub FROM g)"""
)

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CONTENT = (
    "WITH"
    + _TEXT
    + r", c AS (SELECT doc_id, regexp_replace(t, '^\x{FEFF}', '') AS content FROM d), h AS (SELECT *, left(content, 3000) AS head, left(content, 1000) AS head1, list_transform(string_split(content, chr(10)), lambda x: "
    + _STRIP.format("x")
    + ") AS ls FROM c)"
)
_UPPER = "(x = upper(x) AND x <> lower(x))"
# The patterns of legal papers.
_VERSUS = r"'(?i)(?:Plaintiff|Petitioner)s?,?\s+v\.?\s'"
_PARTIES = r"'(?is)([A-Za-z][A-Za-z\s,.]+?),?\s+(?:et\s+al\.?)?,?\s+(?:Plaintiff|Petitioner)s?,?\s+v\.?\s+([A-Za-z][A-Za-z\s,.]+?),?\s+(?:et\s+al\.?)?,?\s+(?:Defendant|Respondent)s?'"
_COURT = r"'(?i)(UNITED\s+STATES\s+(?:DISTRICT\s+COURT|COURT\s+OF\s+APPEALS))\s+([A-Z\s]+(?:DISTRICT|CIRCUIT))'"
_FILED = r"'(?i)Document\s+(\d+)\s+Filed\s+(\d+/\d+/\d+)'"
_DAY = r"'^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})'"
_ATTORNEY = r"'(?i)([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:,\s*)?([^,\n]+?)?\s+(?:Bar\s+No\.|Attorney\s+for)'"
# The texts of the reasons.
_REASON = r"""CASE WHEN lev = 0 THEN 'Exact match (different case)' ELSE concat_ws('; ', CASE lev WHEN 1 THEN 'Edit distance=1 (likely typo)' WHEN 2 THEN 'Edit distance=2 (possible typo)' ELSE 'Edit distance=' || lev END,
 CASE WHEN jaccard >= 0.8 THEN 'High token overlap (' || round_even(jaccard * 100, 0)::INT || '%)' WHEN jaccard >= 0.5 THEN 'Good token overlap (' || round_even(jaccard * 100, 0)::INT || '%)' END,
 CASE WHEN greatest(entity1_count, entity2_count) > 10 AND least(entity1_count, entity2_count)::DOUBLE / greatest(entity1_count, entity2_count) < 0.1 THEN 'Rare variant (' || least(entity1_count, entity2_count) || ' vs ' || greatest(entity1_count, entity2_count) || ')' END,
 CASE WHEN jaccard < 0.3 THEN 'Low token overlap (' || round_even(jaccard * 100, 0)::INT || '%)' END) END"""


# The patterns of attributions, with the places of their groups: author, address, date.
_WHEN = r"([\p{L}\p{N}_]+\s+\d{1,2},\s+\d{4},?\s+at\s+[\d:]+\s+(?:AM|PM))"
_ATTRIBUTIONS = (
    (r"(?i)(?:søn|son|man|tir|ons|tor|fre|lør)\.\s+(\d{1,2}\.\s+[\p{L}\p{N}_]+\.\s+\d{4}\s+kl\.\s+[\d:]+)\s+skrev\s+(.+?)\s*<([^>]+)>:", 2, 3, 1),
    (r"(?i)On\s+" + _WHEN + r",\s*(.+?)\s*<[^>]+>\s*wrote:", 2, None, 1),
    (r"(?i)On\s+((?:Sun|Mon|Tue|Wed|Thu|Fri|Sat),\s+[\p{L}\p{N}_]+\s+\d{1,2},\s+\d{4}\s+at\s+[\d:]+\s+(?:AM|PM)),\s*([^<\n]+)", 2, None, 1),
    (r"(?i)On\s+" + _WHEN + r",\s*([^<\n]+)", 2, None, 1),
    (r"(?ms)^From:\s*(.+?)\s*(?:<([^>]+)>)?\s*$.*?^Sent:\s*(.+?)\s*$", 1, 2, 3),
)


def _attributions() -> str:
    """doc_id, k, i, name, email, date_str of the matches of each pattern in ``body``."""
    get = lambda p, g: f"unnest(regexp_extract_all(body, '{p}', {g}))"
    one = lambda k, p, name, email, date: f"SELECT doc_id, {k} AS k, generate_subscripts(regexp_extract_all(body, '{p}', 0), 1) AS i, {get(p, name)} AS name, {get(p, email) if email else chr(39) * 2} AS email, {get(p, date)} AS date_str FROM b"
    # White space of the original is that of Unicode.
    return " UNION ALL ".join(one(k, p.replace(r"\s", r"[\s\p{Z}]"), *groups) for k, (p, *groups) in enumerate(_ATTRIBUTIONS))


def _header(names: str) -> str:
    """The last value of a header in the folded block."""
    return _STRIP.replace("{0}", f"regexp_extract_all(block, '(?im)^[ \\t]*(?:{names}):[ \\t]*([^ \\t\\n].*)$', 1)[-1]")


def _side(group: int) -> str:
    """The names of one side of a case."""
    whole = _STRIP.format(f"regexp_extract(head, {_PARTIES}, {group})")
    return f"CASE WHEN regexp_matches(head, {_VERSUS}) THEN array_to_string(list_filter(list_transform(regexp_split_to_array({whole}, " + r"'(?i),\s*(?:et\s+al\.?)?')" + f", lambda x: {_STRIP.format('x')}), lambda x: x <> ''), '|') ELSE '' END"


SQL = {
    "scn_doc_id": r"SELECT doc_id, CASE WHEN regexp_extract(stem, 'HOUSE_OVERSIGHT_\d+') <> '' THEN regexp_extract(stem, 'HOUSE_OVERSIGHT_\d+') ELSE stem END AS file_id FROM (SELECT doc_id, regexp_replace(string_split(filepath, '/')[-1], '\.[^.]*$', '') AS stem FROM documents)",
    "scn_scores": _SCORES + " SELECT doc_id, round(mail_score, 9) AS mail_score, round(narrative_score, 9) AS narrative_score, round(html_score, 9) AS html_score, kind AS document_type, round(best, 9) AS score FROM k",
    "scn_seeds": "SELECT doc_id, seed.name AS seed FROM documents, " + _SEEDS + " WHERE regexp_matches(full_text, seed.pattern)",
    "scn_issues": "WITH" + _TEXT + " SELECT doc_id, 'Very short document' AS issue FROM l WHERE length(raw) < 100 UNION ALL SELECT doc_id, 'Encoding errors detected' FROM l WHERE length(raw) - length(replace(raw, chr(65533), '')) > 5 UNION ALL SELECT doc_id, 'Empty file' FROM l WHERE len(lines) = 0",
    "scn_sample_lines": "WITH" + _TEXT + r", x AS (SELECT doc_id, CASE WHEN len(lines) <= 20 THEN lines ELSE list_concat(lines[1:10], lines[len(lines) - 9:]) END AS s FROM l) SELECT doc_id, array_to_string(list_filter(list_transform(s, lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> ''), '|') AS sample FROM x",
    "scn_classify": _SCORES + " SELECT filepath, strlen(raw) AS file_size, len(lines) AS line_count, kind AS document_type, round(best, 9) AS confidence, n_seeds AS seeds, n_issues AS issues FROM k",
    "scn_types": _SCORES + " SELECT kind AS document_type, count(*) AS documents, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percentage FROM k GROUP BY kind",
    "scn_totals": _SCORES + " SELECT count(*) AS total_documents, round(sum(strlen(raw)) / (1024.0::DOUBLE * 1024.0), 6) AS total_size_mb, count(*) FILTER (best > 0.7) AS high_confidence_count, round(count(*) FILTER (best > 0.7) * 100.0::DOUBLE / count(*), 6) AS high_confidence_pct, sum(n_issues)::BIGINT AS total_issues FROM k",
    "scn_mentions": "SELECT seed.name AS entity_name, count(*) AS mentions FROM documents, " + _SEEDS + " WHERE regexp_matches(full_text, seed.pattern) GROUP BY seed.name",
    "scn_emails": _SCORES + " SELECT filepath, round(best, 9) AS confidence FROM k WHERE kind = 'email' AND best >= 0.6",
    "cls_types": _CLS + " SELECT doc_id, found_type, round(CASE found_type WHEN 'email' THEN 0.95 WHEN 'legal' THEN least(legal, 0.95::DOUBLE) WHEN 'news' THEN 0.85 WHEN 'congressional' THEN 0.9 WHEN 'narrative' THEN 0.7 ELSE 0.5 END::DOUBLE, 9) AS confidence, CASE found_type WHEN 'legal' THEN sub WHEN 'news' THEN 'article' END AS subtype FROM f",
    "cls_histogram": _CLS + " SELECT found_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percentage FROM f GROUP BY found_type",
    "ent_dates": r"SELECT DISTINCT doc_id, text FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(full_text, '\b\d{1,2}/\d{1,2}/\d{2,4}\b'), regexp_extract_all(full_text, '\b\d{4}-\d{2}-\d{2}\b'), regexp_extract_all(full_text, '(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b'), regexp_extract_all(full_text, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4}\b'))) AS text FROM documents)",
    "ent_locations": r"SELECT DISTINCT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(full_text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}(?:\s|$)'), regexp_extract_all(full_text, '\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Boulevard|Blvd\.|Way|Drive|Dr\.|Lane|Ln\.)\b'))) AS text FROM documents)",
    "ent_organizations": r"SELECT DISTINCT doc_id, text FROM (SELECT doc_id, regexp_replace(unnest(list_concat(regexp_extract_all(full_text, '\b[A-Z][A-Za-z\s&]{2,40}(?:Inc\.|LLC|Corp\.|Corporation|Company|Co\.)\b'), regexp_extract_all(full_text, '\b[A-Z][A-Za-z\s]{2,30}(?:University|College|Institute|Foundation)\b'), regexp_extract_all(full_text, '\b[A-Z][A-Za-z\s]{2,30}(?:Department|Agency|Commission|Bureau)\b'), regexp_extract_all(full_text, '\b[A-Z][A-Za-z\s]{2,30}(?:Bank|Group|Partners|Associates)\b'))), '^\s+|\s+$', '', 'g') AS text FROM documents) WHERE length(text) > 3",
    "ent_normalised": r"SELECT entity_id, CASE WHEN type IN ('person', 'organization') THEN replace(replace(n, '.', ''), ',', '') ELSE n END AS normal FROM (SELECT *, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS n FROM entities)",
    "ent_contexts": "SELECT DISTINCT mention_id, substring(full_text, greatest(position_start - 50, 0) + 1, least(position_end + 50, length(full_text)) - greatest(position_start - 50, 0)) AS around FROM document_entities JOIN documents USING (doc_id) WHERE position_start IS NOT NULL",
    "ent_merged": "SELECT doc_id, type, lower(trim(text)) AS name, max(confidence) AS confidence FROM document_entities JOIN entities USING (entity_id) GROUP BY ALL",
    "ent_validated": "WITH m AS (SELECT DISTINCT mention_id, doc_id, text, type, confidence FROM document_entities JOIN entities USING (entity_id)), o AS (SELECT text, type FROM m GROUP BY ALL HAVING count(DISTINCT doc_id) = 1) SELECT mention_id, doc_id, confidence FROM m WHERE NOT (confidence < 0.8 AND (text, type) IN (SELECT (text, type) FROM o))",
    "ent_participants": "WITH " + _MAILS + r", p AS (SELECT DISTINCT doc_id, trim(regexp_replace(x, '\s*<[^>]*>', '', 'g')) AS text FROM (SELECT doc_id, unnest(json_extract_string(all_participants, '$[*]')) AS x FROM mails WHERE all_participants IS NOT NULL)), k AS (SELECT DISTINCT doc_id, lower(text) AS t FROM document_entities JOIN entities USING (entity_id) WHERE type = 'person') SELECT p.doc_id, p.text FROM p WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = p.doc_id AND k.t = lower(p.text))",
    "url_extract": "WITH " + _MAILS + ", " + _LINKED + " SELECT doc_id, url, domain, type, position FROM z",
    "url_types": "WITH " + _MAILS + ", " + _LINKED + " SELECT type, count(*) AS n FROM z GROUP BY type",
    "eml_flags": "WITH " + _MAILS + r" SELECT doc_id, coalesce(regexp_matches(subject, '(?i)^Re:\s*'), false) OR in_reply_to IS NOT NULL AS reply, coalesce(regexp_matches(subject, '(?i)^Fwd?:\s*'), false) AS forward FROM mails",
    "eml_participants": "WITH " + _MAILS + ", a AS (SELECT doc_id, from_addr AS participant FROM mails UNION SELECT doc_id, unnest(from_json(to_addrs, '[\"VARCHAR\"]')) FROM mails UNION SELECT doc_id, unnest(from_json(cc_addrs, '[\"VARCHAR\"]')) FROM mails) SELECT DISTINCT doc_id, participant FROM a WHERE participant IS NOT NULL",
    "eml_skips": "SELECT CASE WHEN doc_type IS NULL THEN 'No classification step found' WHEN doc_type <> 'email' THEN 'Document type is ''' || doc_type || ''', not email' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "eml_addresses": "WITH " + _MAILS + r", a AS (SELECT doc_id, trim(from_addr) AS t FROM mails) SELECT doc_id, CASE WHEN t = '' OR t IS NULL THEN NULL WHEN regexp_matches(t, '([^<]+?)\s*<([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})>') THEN regexp_extract(t, '([^<]+?)\s*<([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})>', 2) WHEN regexp_matches(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN regexp_extract(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') ELSE '[REDACTED]' END AS email, CASE WHEN t = '' OR t IS NULL THEN NULL WHEN regexp_matches(t, '([^<]+?)\s*<([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})>') THEN nullif(trim(regexp_extract(t, '([^<]+?)\s*<([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})>', 1)), '') WHEN regexp_matches(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN nullif(trim(string_split(t, regexp_extract(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))[1]), '') ELSE t END AS name FROM a",
    "nws_fields": "WITH" + _TEXT + r", h AS (SELECT doc_id, left(regexp_replace(t, '^\x{FEFF}', ''), 1000) AS head FROM d) SELECT doc_id, CASE WHEN regexp_matches(head, '(?i)Palm\s+Beach\s+Post') THEN 'Palm Beach Post' WHEN regexp_matches(head, '(?i)New\s+York\s+Times') THEN 'New York Times' WHEN regexp_matches(head, '(?i)Washington\s+Post') THEN 'Washington Post' WHEN regexp_matches(head, '(?i)Wall\s+Street\s+Journal') THEN 'Wall Street Journal' WHEN regexp_matches(head, '(?i)Miami\s+Herald') THEN 'Miami Herald' END AS publication, CASE WHEN regexp_matches(head, '(?i)EDITORIAL|OPINION') THEN 'editorial' WHEN regexp_matches(head, '(?i)NEWS|LOCAL') THEN 'news' WHEN regexp_matches(head, '(?i)BUSINESS|ECONOMY') THEN 'business' END AS section, CASE WHEN regexp_matches(head, '(?i)editorial|opinion') THEN 'editorial' WHEN regexp_matches(head, '(?i)profile|about|biography') THEN 'profile' ELSE 'news' END AS article_type FROM h",
    "sim_pairs": "WITH" + _PAIRS + " SELECT type, entity1_id, entity1_text, entity1_count, entity2_id, entity2_text, entity2_count, lev AS levenshtein, round(jaccard, 9) AS jaccard, round(conf, 9) AS confidence FROM cand",
    "sim_top": "WITH" + _PAIRS + " SELECT entity1_id, entity2_id, round(conf, 9) AS confidence FROM cand WHERE type = 'person' ORDER BY conf DESC, entity1_id, entity2_id LIMIT 25",
    "sim_tiers": "WITH" + _PAIRS + ", t AS (SELECT * FROM cand ORDER BY conf DESC, entity1_id, entity2_id LIMIT 200) SELECT CASE WHEN conf >= 0.95 THEN 'auto_merge' WHEN conf >= 0.80 THEN 'llm_review' ELSE 'manual_review' END AS tier, count(*) AS pairs, round(avg(conf), 9) AS mean_confidence FROM t GROUP BY 1",
    "can_initial": "SELECT entity_id AS canonical_id, type AS entity_type, text AS canonical_text, normalized_text AS canonical_normalized, coalesce(occurrence_count, 0) AS total_mentions FROM entities",
    "can_of_entity": "WITH " + _CURRENT + " SELECT a.entity_id, a.canonical_id, cur.canonical_text FROM (SELECT DISTINCT entity_id, canonical_id FROM entity_aliases WHERE canonical_id IS NOT NULL) a JOIN cur USING (canonical_id)",
    "can_aliases": "SELECT a.canonical_id, a.entity_id, e.text, e.occurrence_count FROM (SELECT DISTINCT entity_id, canonical_id FROM entity_aliases WHERE canonical_id IS NOT NULL) a JOIN entities e USING (entity_id)",
    "can_search": "WITH " + _CURRENT + ", s AS (SELECT *, ' ' || array_to_string(" + _TOKENS.format("canonical_text") + ", ' ') AS j FROM cur) SELECT canonical_id, canonical_text, total_mentions FROM s WHERE contains(j, ' orsolina v') OR contains(j, ' patric')",
    "can_merge": "WITH " + _CURRENT + ", tg AS (SELECT min(canonical_id) AS t FROM entity_aliases WHERE entity_id = 1), mv AS (SELECT entity_id FROM entities, tg WHERE occurrence_count < 3 AND t IS NOT NULL), mg AS (SELECT DISTINCT a.entity_id, CASE WHEN a.entity_id IN (SELECT entity_id FROM mv) THEN (SELECT t FROM tg) ELSE a.canonical_id END AS canonical_id FROM entity_aliases a), n AS (SELECT mg.canonical_id, coalesce(sum(occurrence_count), 0)::BIGINT AS total_mentions FROM mg JOIN entities e USING (entity_id) WHERE mg.canonical_id IS NOT NULL GROUP BY 1) SELECT n.canonical_id, n.total_mentions FROM n JOIN cur USING (canonical_id)",
    "can_stats": "SELECT c AS total_canonical, a AS total_aliases, round(a::DOUBLE / c, 9) AS avg_aliases FROM (SELECT count(DISTINCT canonical_id) AS c FROM canonical_entities), (SELECT count(*) AS a FROM (SELECT DISTINCT entity_id, canonical_id FROM entity_aliases WHERE canonical_id IS NOT NULL))",
    "can_by_type": "SELECT entity_type, count(DISTINCT canonical_id) AS records FROM canonical_entities GROUP BY entity_type",
    "can_most_aliases": "WITH " + _CURRENT + ", n AS (SELECT canonical_id, count(DISTINCT entity_id) AS alias_count FROM entity_aliases WHERE canonical_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_id) > 1) SELECT canonical_id, alias_count, canonical_text FROM n JOIN cur USING (canonical_id) ORDER BY alias_count DESC, canonical_id LIMIT 10",
    "fts_terms": "WITH " + _POSTINGS + " SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM pos GROUP BY term",
    "fts_lengths": "WITH " + _POSTINGS + " SELECT doc_id, len FROM sz",
    "fts_word": "WITH " + _POSTINGS + ", m AS (SELECT doc_id, count(*) AS tf FROM pos WHERE term = 'donation' GROUP BY 1), n AS (SELECT *, count(*) OVER () AS n FROM m) SELECT doc_id, round(-" + _BM + ", 6) AS rank FROM n JOIN sz USING (doc_id), corp",
    "fts_boolean": "WITH " + _POSTINGS + ", m AS (SELECT term, doc_id, count(*) AS tf FROM pos WHERE term IN ('donation', 'subpoena', 'harbor') GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY term) AS n FROM m), h AS (SELECT doc_id FROM n WHERE term IN ('donation', 'subpoena') INTERSECT SELECT doc_id FROM n WHERE term = 'harbor' EXCEPT SELECT doc_id FROM pos WHERE term = 'envelope') SELECT doc_id, round(-sum(" + _BM + "), 6) AS rank FROM n JOIN h USING (doc_id) JOIN sz USING (doc_id), corp GROUP BY doc_id",
    "fts_phrase": "WITH " + _POSTINGS + ", m AS (SELECT 1 AS q, a.doc_id, count(*) AS tf FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'mining' AND b.term = 'permit' GROUP BY a.doc_id UNION ALL SELECT 2, doc_id, count(*) FROM pos WHERE term = 'voucher' GROUP BY doc_id), n AS (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM m), h AS (SELECT doc_id FROM n WHERE q = 1 INTERSECT SELECT doc_id FROM n WHERE q = 2) SELECT doc_id, round(-sum(" + _BM + "), 6) AS rank FROM n JOIN h USING (doc_id) JOIN sz USING (doc_id), corp GROUP BY doc_id",
    "fts_search": "WITH " + _POSTINGS + ", m AS (SELECT term, doc_id, count(*) AS tf FROM pos WHERE term IN ('insurance', 'adjuster') GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY term) AS n FROM m), h AS (SELECT doc_id FROM n GROUP BY doc_id HAVING count(*) = 2), r AS (SELECT doc_id, -sum(" + _BM + ") AS rank FROM n JOIN h USING (doc_id) JOIN sz USING (doc_id), corp GROUP BY doc_id) SELECT doc_id, filepath, round(rank, 6) AS rank FROM r JOIN documents USING (doc_id) ORDER BY r.rank, doc_id LIMIT 20",
    "fts_prefix": "WITH " + _POSTINGS + ", m AS (SELECT doc_id, count(*) AS tf FROM pos WHERE term LIKE 'photogr%' GROUP BY 1), n AS (SELECT *, count(*) OVER () AS n FROM m) SELECT doc_id, round(-" + _BM + ", 6) AS rank FROM n JOIN sz USING (doc_id), corp",
    "api_document": "WITH " + _NAMED + " SELECT doc_id, filepath, doc_type, coalesce((SELECT string_agg(entity_name, '|' ORDER BY entity_name) FROM named WHERE named.doc_id = d.doc_id), '') AS entities FROM documents d WHERE doc_id = 3",
    "api_by_entity": "WITH " + _NAMED + " SELECT doc_id, filepath, doc_type, confidence FROM documents WHERE doc_id IN (SELECT doc_id FROM named WHERE entity_name = 'Orsolina Vantreekel') ORDER BY confidence DESC NULLS LAST, doc_id LIMIT 50",
    "api_entities": "WITH " + _NAMED + " SELECT entity_name, count(*) AS documents FROM named GROUP BY entity_name",
    "api_stats": "WITH " + _NAMED + ", e AS (SELECT entity_name, count(*) AS n FROM named GROUP BY 1 ORDER BY n DESC, entity_name LIMIT 10) SELECT 'total' AS section, NULL AS name, count(*) AS n FROM documents UNION ALL SELECT 'type', doc_type, count(*) FROM documents GROUP BY doc_type UNION ALL SELECT 'entity', entity_name, n FROM e",
    "api_entity_mentions": "WITH e AS (SELECT * FROM (SELECT *, ' ' || array_to_string(" + _TOKENS.format("text") + ", ' ') AS a, ' ' || array_to_string(" + _TOKENS.format("normalized_text") + ", ' ') AS b FROM entities WHERE type = 'person') WHERE contains(a, ' patricia') OR contains(b, ' patricia')), m AS (SELECT DISTINCT e.entity_id, e.text, x.doc_id, x.confidence, x.mention_id FROM document_entities x JOIN e USING (entity_id) JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC NULLS LAST, doc_id, mention_id) AS place FROM m) SELECT entity_id, text, doc_id, confidence, place FROM r WHERE place <= 5",
    "api_threads": "WITH " + _MAILS + ", " + _THREADS + ", s AS (SELECT *, ' ' || array_to_string(" + _TOKENS.format("author") + ", ' ') AS j FROM threads) SELECT s.doc_id, message_index, author, s.date, subject FROM s JOIN documents USING (doc_id) LEFT JOIN mails ON mails.doc_id = s.doc_id WHERE contains(j, ' patricia') ORDER BY s.date DESC NULLS LAST, s.doc_id, message_index LIMIT 200",
    "api_dead_letters": "WITH " + _MAILS + " SELECT doc_id, filepath, array_to_string(from_json(parsing_issues, '[\"VARCHAR\"]'), '|') AS issues FROM mails JOIN documents USING (doc_id) WHERE parsing_issues IS NOT NULL AND parsing_issues <> '[]' ORDER BY doc_id LIMIT 50",
    "api_list_emails": _SCORES + r" SELECT filepath, round(best, 9) AS confidence FROM k WHERE kind = 'email' AND best >= 0.6 AND regexp_matches(raw, '(?i)\bTrust\b')",
    "rel_point": "SELECT doc_id, doc_type, line_count FROM documents WHERE doc_id = 5",
    "rel_in_list": "SELECT doc_id, doc_type FROM documents WHERE doc_id IN (1, 7, 42, 99)",
    "rel_range": "SELECT DISTINCT entity_id, canonical_id, merge_confidence FROM entity_aliases WHERE merge_confidence BETWEEN 0.8 AND 0.95",
    "rel_conjunction": "SELECT entity_id, text FROM entities WHERE type = 'person' AND occurrence_count >= 5 AND entity_id IN (SELECT entity_id FROM entity_aliases WHERE is_canonical)",
    "rel_join_mentions": "SELECT doc_type, count(*) AS mentions, count(DISTINCT entity_id) AS entities FROM (SELECT DISTINCT mention_id, doc_id, entity_id FROM document_entities) JOIN documents USING (doc_id) GROUP BY doc_type",
    "rel_left_join": "WITH " + _MAILS + ", " + _THREADS + " SELECT doc_type, count(*) AS messages, count(subject) AS with_subject FROM threads JOIN documents USING (doc_id) LEFT JOIN mails USING (doc_id) GROUP BY doc_type",
    "rel_semi_join": "SELECT method, count(DISTINCT mention_id) AS mentions FROM document_entities WHERE entity_id IN (SELECT entity_id FROM entities WHERE type = 'organization') GROUP BY method",
    "rel_anti_join": "SELECT entity_id, text FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM entity_aliases WHERE entity_id IS NOT NULL)",
    "rel_counts": "SELECT doc_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, sum(line_count)::BIGINT AS line_total FROM documents GROUP BY doc_type",
    "rel_batch_counters": "SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT mention_id) AS mentions, count(*) FILTER (context IS NULL) AS without_context, count(*) FILTER (method = 'llm') AS by_model FROM document_entities",
    "rel_lists": "SELECT doc_id, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM (SELECT DISTINCT doc_id, entity_id FROM document_entities) GROUP BY doc_id",
    "rel_top_per_group": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, doc_id, mention_id) AS place FROM (SELECT DISTINCT mention_id, entity_id, doc_id, confidence FROM document_entities)) WHERE place <= 3",
    "rel_one_context": "SELECT entity_id, min_by(context, mention_id) AS context FROM document_entities WHERE context IS NOT NULL GROUP BY entity_id",
    "rel_latest": "WITH " + _MAILS + " SELECT doc_id, from_addr, subject, date FROM mails",
    "rel_token_sets": "WITH t AS (SELECT entity_id, list_distinct(" + _TOKENS.format("text") + ") AS a, list_distinct(" + _TOKENS.format("normalized_text") + ") AS b FROM entities WHERE type = 'organization') SELECT entity_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS either FROM t",
    "snk_upsert": "WITH o AS (SELECT canonical_id, min(total_mentions) AS total_mentions FROM canonical_entities GROUP BY 1), n AS (SELECT canonical_id, max(total_mentions) + 1000 AS total_mentions FROM canonical_entities WHERE entity_type = 'person' AND total_mentions IS NOT NULL GROUP BY 1) SELECT o.canonical_id, coalesce(n.total_mentions, o.total_mentions) AS total_mentions FROM o LEFT JOIN n USING (canonical_id)",
    "snk_ignore": "SELECT entity_id, count(*) AS documents FROM (SELECT DISTINCT doc_id, entity_id FROM document_entities) GROUP BY entity_id",
    "snk_load": "WITH f AS (SELECT filepath, max(full_text) AS t FROM documents WHERE full_text <> '' GROUP BY 1), c AS (SELECT DISTINCT filepath FROM documents) SELECT count(*) FILTER (c.filepath IS NOT NULL AND c.filepath <> '' AND t IS NOT NULL) AS loaded, count(*) FILTER (c.filepath IS NULL OR c.filepath = '') AS skipped, count(*) FILTER (c.filepath <> '' AND t IS NULL) AS error FROM c LEFT JOIN f USING (filepath)",
    "pip_assembled": "WITH " + _MAILS + ", m AS (SELECT doc_id, type, text, max(confidence) AS c FROM document_entities JOIN entities USING (entity_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY c DESC, text) AS p FROM m), l AS (SELECT doc_id, string_agg(text, '|' ORDER BY p) FILTER (type = 'person' AND p <= 20) AS people, string_agg(text, '|' ORDER BY p) FILTER (type = 'organization' AND p <= 10) AS organizations, string_agg(text, '|' ORDER BY p) FILTER (type = 'location' AND p <= 10) AS locations FROM r GROUP BY 1), n AS (SELECT doc_id, count(*) AS mentions FROM m GROUP BY 1) SELECT d.doc_id, d.doc_type, '' AS urls, coalesce(people, '') AS people, coalesce(organizations, '') AS organizations, coalesce(locations, '') AS locations, coalesce(mentions, 0) AS mentions, subject FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN mails USING (doc_id)",
}
SQL["fts_indexed"] = SQL["fts_boolean"]
_EDGES = """chr(39) || '"[]()<>'"""
_HEADS = _CONTENT + r", x AS (SELECT doc_id, string_split(content, chr(10)) AS raw, ls FROM h WHERE doc_id IN (SELECT doc_id FROM email_metadata)), y AS (SELECT *, list_filter(range(1, len(raw) + 1), lambda i: ls[i] = '' OR (i > 1 AND left(raw[i], 1) NOT IN (' ', chr(9)) AND NOT (instr(ls[i], ':') BETWEEN 1 AND 21)))[1] AS stop FROM x)"
SQL |= {
    "eml_clean": "WITH q AS (" + SQL["eml_addresses"] + "), n AS (SELECT *, trim(trim(trim(name), " + _EDGES + ")) AS n1 FROM q WHERE email IS NOT NULL), m AS (SELECT *, CASE WHEN lower(n1) LIKE 'mailto:%' THEN trim(substr(n1, 8)) ELSE n1 END AS n2 FROM n) SELECT doc_id, CASE WHEN email = '[REDACTED]' THEN 'redacted' ELSE trim(regexp_replace(lower(trim(email)), '^mailto:', ''), " + _EDGES + r") END AS email, nullif(trim(regexp_replace(regexp_replace(regexp_replace(n2, '\s*\[\s*\]\s*', ' ', 'g'), '\s*\(\s*\)\s*', ' ', 'g'), '\s+', ' ', 'g')), '') AS name FROM m",
    "eml_headers": _HEADS
    + r", z AS (SELECT doc_id, regexp_replace(array_to_string(raw[1:coalesce(stop - 1, len(raw))], chr(10)), '[ \t]*\n[ \t]+', ' ', 'g') AS block FROM y) SELECT doc_id, "
    + f"{_header('subject')} AS subject, {_header('message-id')} AS message_id, {_header('in-reply-to')} AS in_reply_to, {_header('sent|date')} AS date_str FROM z",
    "eml_attributions": _HEADS
    + r", w AS (SELECT doc_id, CASE WHEN stop IS NULL THEN '' ELSE array_to_string(raw[CASE WHEN ls[stop] = '' THEN stop + 1 ELSE stop END:], chr(10)) END AS body FROM y), b AS (SELECT * FROM w WHERE "
    + _STRIP.replace("{0}", r"regexp_split_to_array(body, '(?m)^--\s*$')[1]")
    + " <> ''), m AS ("
    + _attributions()
    + ") SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::INT AS message_index, rtrim("
    + _STRIP.format("name")
    + ", ',<> ' || chr(9)) || CASE WHEN trim(email) <> '' THEN ' <' || trim(email) || '>' ELSE '' END AS author, nullif("
    + _STRIP.format("date_str")
    + ", '') AS date_str FROM m",
    "cls_hybrid": _CLS + ", r AS (SELECT f.doc_id, found_type, CASE found_type WHEN 'email' THEN 0.95 WHEN 'legal' THEN least(legal, 0.95::DOUBLE) WHEN 'news' THEN 0.85 WHEN 'congressional' THEN 0.9 WHEN 'narrative' THEN 0.7 ELSE 0.5 END::DOUBLE AS conf, left(documents.full_text, 1000) AS t FROM f JOIN documents USING (doc_id)), a AS (SELECT *, NOT (found_type <> 'other' AND conf >= 0.85) AND coalesce(contains(t, ' I ') OR contains(t, 'Memoir'), false) AS asked FROM r) SELECT doc_id, CASE WHEN asked THEN 'memoir' ELSE found_type END AS doc_type, CASE WHEN asked THEN 0.8::DOUBLE ELSE conf END AS confidence, CASE WHEN asked THEN 'llm' ELSE 'regex' END AS method, CASE WHEN asked THEN 'first person' END AS reasoning FROM a",
    "scn_report": "WITH a AS (" + SQL["scn_types"] + "), b AS (" + SQL["scn_mentions"] + "), t AS (SELECT count(*) AS n FROM documents) SELECT 'type' AS section, document_type AS name, documents AS n FROM a UNION ALL SELECT 'seed', entity_name, mentions FROM b UNION ALL SELECT 'total', 'documents', n FROM t",
    "sim_reasons": "WITH" + _PAIRS + " SELECT entity1_id, entity2_id, " + _REASON + " AS reason FROM cand WHERE type = 'person'",
    "sim_report": "WITH" + _PAIRS + ", t AS (SELECT *, CASE WHEN conf >= 0.95 THEN 'auto_merge' WHEN conf >= 0.80 THEN 'llm_review' ELSE 'manual_review' END AS tier FROM (SELECT * FROM cand ORDER BY conf DESC, entity1_id, entity2_id LIMIT 200)) SELECT tier, (row_number() OVER (PARTITION BY tier ORDER BY conf DESC, entity1_id, entity2_id) - 1)::INT AS place, entity1_id, entity2_id, round(conf, 9) AS confidence FROM t",
    "can_review": "WITH" + _PAIRS + r", t AS (SELECT * FROM cand ORDER BY conf DESC, entity1_id, entity2_id LIMIT 200) SELECT entity1_id, entity2_id, regexp_split_to_array(trim(entity1_text), '\s+')[-1] = regexp_split_to_array(trim(entity2_text), '\s+')[-1] AS should_merge, 'last words' AS note FROM t WHERE conf >= 0.80 AND conf < 0.95",
    "leg_fields": _CONTENT
    + f", x AS (SELECT *, nullif(regexp_extract(head, {_FILED}, 2), '') AS fs FROM h), y AS (SELECT *, regexp_extract(fs, {_DAY}, 1) AS m, regexp_extract(fs, {_DAY}, 2) AS dd, regexp_extract(fs, {_DAY}, 3) AS yy FROM x)"
    + r" SELECT doc_id, nullif(regexp_extract(head, '(?i)Case\s+(\d+:\d+-[a-z]+-\d+)', 1), '') AS case_number, "
    + f"nullif(regexp_extract(head, {_FILED}, 1), '') AS document_number, fs AS filing_date_str, "
    + "CAST(CAST(try_strptime(CASE WHEN length(yy) = 4 THEN yy WHEN yy < '50' THEN '20' || yy ELSE '19' || yy END || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0'), '%Y-%m-%d') AS DATE) AS VARCHAR) AS filing_date, "
    + _STRIP.format(f"nullif(regexp_extract(head, {_COURT}, 1), '')") + " AS court, " + _STRIP.format(f"nullif(regexp_extract(head, {_COURT}, 2), '')") + " AS district, " + _side(1) + " AS plaintiffs, " + _side(2)
    + r" AS defendants, CASE WHEN regexp_matches(head, '(?i)MOTION\s+(?:TO|FOR)') THEN 'motion' WHEN regexp_matches(head, '(?i)MEMORANDUM\s+(?:OF\s+LAW|IN\s+SUPPORT)') THEN 'memorandum' WHEN regexp_matches(head, '(?i)DEPOSITION|EXAMINATION\s+OF') THEN 'deposition' WHEN regexp_matches(head, '(?i)ORDER(?:\s+AND|\s+GRANTING|\s+DENYING)') THEN 'order' WHEN regexp_matches(head, '(?i)COMPLAINT') THEN 'complaint' WHEN regexp_matches(head, '(?i)ANSWER\s+TO') THEN 'answer' WHEN regexp_matches(head, '(?i)BRIEF\s+IN\s+SUPPORT') THEN 'brief' END AS document_type, "
    + _STRIP.replace("{0}", r"nullif(regexp_extract(head, '(?m)^([A-Z][A-Z\s]{10,100})$', 1), '')") + " AS title FROM y",
    "leg_body": _CONTENT + r", x AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: length(x) > 50 AND NOT " + _UPPER + r" AND NOT regexp_matches(x, '^Case\s+\d+:') AND NOT regexp_matches(x, '^Document\s+\d+')), true) AS k FROM h) SELECT doc_id, array_to_string(list_filter(ls[coalesce(nullif(k, 0), 1):], lambda x: length(x) >= 10 AND NOT regexp_matches(x, '^\d+$') AND NOT regexp_matches(x, '^Case\s+\d+:'))[1:1000], chr(10)) AS body FROM x",
    "leg_attorneys": "WITH " + _MAILS + r", n AS (SELECT doc_id, trim(regexp_replace(from_addr, '\s*<[^>]*>', '', 'g')) AS name FROM mails WHERE from_addr IS NOT NULL), t AS (SELECT doc_id, concat_ws(chr(10), 'Attorneys for Plaintiff:', name || ' Example Law LLP Bar No. ' || doc_id, '', 'Attorney for Defendants', 'Ann Sample Attorney for the firm of ' || name, name || ' , Other Firm Bar No. 7') AS t FROM n), s AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?is)Attorneys?\s+for\s+(?:Plaintiff|Defendant)s?:?\s*\n(.+?)(?:\n\n|\z)', 1)) AS s FROM t), a AS (SELECT doc_id, unnest(regexp_extract_all(s, " + _ATTORNEY + ", 1)) AS name, unnest(regexp_extract_all(s, " + _ATTORNEY + ", 2)) AS firm FROM s) SELECT doc_id, trim(name) AS name, nullif(trim(firm), '') AS firm, 'attorney' AS role FROM a",
    "nws_body": _CONTENT + r", x AS (SELECT *, list_position(list_transform(ls[1:50], lambda x: length(x) > 50 AND NOT " + _UPPER + r"), true) AS k FROM h), y AS (SELECT *, array_to_string(list_filter(ls[coalesce(nullif(k, 0), 1):], lambda x: length(x) >= 20 AND NOT regexp_matches(x, '(?i)^Page\s+\d+'))[1:1000], chr(10) || chr(10)) AS body FROM x) SELECT doc_id, trim(coalesce(nullif(regexp_extract(head1, '(?m)^By\s+([A-Z][A-Za-z.'' -]+?)(?:,|$)', 1), ''), nullif(regexp_extract(head1, '(?m)^([A-Z][A-Za-z.'' -]+?)(?:,|$)\s+(?:Staff\s+Writer|Correspondent)', 1), ''))) AS author, "
    + _STRIP.replace("{0}", r"nullif(regexp_extract(head1, '(?m)^([A-Z][a-z]+\s+[A-Za-z].*|[A-Z\s]{10,100})$', 1), '')") + r" AS headline, coalesce(nullif(regexp_extract(head1, '([A-Z][a-z]+)\s+(\d{1,2}),\s+(\d{4})'), ''), nullif(regexp_extract(head1, '(\d{1,2})/(\d{1,2})/(\d{4})'), '')) AS publication_date_str, body, nullif(split_part(body, chr(10) || chr(10), 1), '') AS summary FROM y",
    "ent_by_model": r"WITH m AS (SELECT doc_id, full_text, unnest(regexp_extract_all(left(full_text, 3000), '[\p{L}\p{N}_]+ University')) AS text, generate_subscripts(regexp_extract_all(left(full_text, 3000), '[\p{L}\p{N}_]+ University'), 1)::INT AS ordinal FROM documents) SELECT doc_id, 'organization' AS type, ordinal, text, (instr(lower(full_text), lower(text)) - 1)::INT AS position_start, (instr(lower(full_text), lower(text)) - 1 + length(text))::INT AS position_end, 0.9::DOUBLE AS confidence, 'llm' AS method FROM m",
    "snk_entities": "WITH e AS (SELECT normalized_text, type, min_by(coalesce(occurrence_count, 0), entity_id) AS n FROM entities WHERE normalized_text IS NOT NULL GROUP BY ALL), s AS (SELECT normalized_text, type, n FROM e UNION ALL SELECT normalized_text || ' x', type, 0 FROM e), g AS (SELECT normalized_text, type, sum(n) + count(*) AS n FROM s GROUP BY ALL) SELECT type, count(*) AS entities, sum(n)::BIGINT AS occurrences, count(*) AS ids FROM g GROUP BY type",
    "pip_steps": _CLS + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'pending' AS status, 2 AS steps_before, 1 AS steps, 3 AS version, found_type FROM f",
}
