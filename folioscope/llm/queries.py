"""The pN_ queries of the operators in this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from folioscope.llm import abuse, groups, mail, mixing, names, neardup, scans, survivors, tokens
from folioscope.tables import table


def p1_found(spark, d):
    return scans.found(table(spark, d, "documents"))


def p1_repaired(spark, d):
    return scans.repaired(table(spark, d, "documents"))


def p2_found(spark, d):
    return neardup.found(table(spark, d, "documents"))


def p2_groups(spark, d):
    return neardup.grouped(table(spark, d, "documents"))


def p3_found(spark, d):
    return groups.groups(table(spark, d, "entity_aliases"))


def p4_found(spark, d):
    return mail.found(table(spark, d, "documents"), table(spark, d, "email_metadata"), table(spark, d, "thread_messages"))


def p4_new_text(spark, d):
    return mail.new_text(table(spark, d, "documents"), table(spark, d, "email_metadata"), table(spark, d, "thread_messages"))


def p6_found(spark, d):
    return names.found(table(spark, d, "entities"), table(spark, d, "canonical_entities"))


def p6_linked(spark, d):
    return names.linked(table(spark, d, "entities"), table(spark, d, "canonical_entities"))


def p7_found(spark, d):
    aliases = table(spark, d, "entity_aliases")
    return survivors.canonical_survivors(table(spark, d, "canonical_entities"), aliases, table(spark, d, "entities"), groups.groups(aliases))


def p7_trusted(spark, d):
    aliases = table(spark, d, "entity_aliases")
    return survivors.trusted_survivors(table(spark, d, "canonical_entities"), aliases, groups.groups(aliases))


def p8_ids(spark, d):
    return tokens.document_ids(table(spark, d, "documents"))


def p9_mix(spark, d):
    return mixing.select(mixing.sizes_of(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.select(mixing.sizes_of(table(spark, d, "documents")), targets), targets)


def p10_found(spark, d):
    return abuse.found(table(spark, d, "documents"))


def p10_scores(spark, d):
    return abuse.scores(table(spark, d, "documents"))


def p10_rates(spark, d):
    return abuse.rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_groups, p3_found, p4_found, p4_new_text, p6_found, p6_linked, p7_found, p7_trusted, p8_ids, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}

_GROUPS = """
WITH RECURSIVE link AS (SELECT DISTINCT entity_id AS e, canonical_id AS c FROM entity_aliases WHERE entity_id IS NOT NULL AND canonical_id IS NOT NULL),
step AS (SELECT DISTINCT x.e AS e, y.e AS f FROM link x JOIN link y USING (c)),
reach AS (SELECT DISTINCT entity_id AS e, entity_id AS f FROM entity_aliases WHERE entity_id IS NOT NULL
          UNION SELECT reach.e, step.f FROM reach JOIN step ON reach.f = step.e),
grp AS (SELECT e AS entity_id, min(f) AS group_id FROM reach GROUP BY e)
"""

SQL = {
    "p2_found": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(full_text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 30)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k * 1000 >= 700 * (p.n + q.n - k)
""",
    "p3_found": _GROUPS + "SELECT entity_id, group_id FROM grp",
    "p7_found": _GROUPS
    + """,
rec AS (SELECT c.*, g.group_id FROM canonical_entities c JOIN (SELECT DISTINCT c AS canonical_id, group_id FROM link JOIN grp ON link.e = grp.entity_id) g USING (canonical_id)),
newest AS (SELECT group_id, canonical_id, coalesce(total_mentions, 0) AS t, row_number() OVER (PARTITION BY canonical_id ORDER BY updated_at DESC, coalesce(total_mentions, 0) DESC) AS k FROM rec),
pick AS (SELECT group_id, canonical_id, row_number() OVER (PARTITION BY group_id ORDER BY t DESC, canonical_id) AS k, count(*) OVER (PARTITION BY group_id) AS n FROM newest WHERE k = 1),
named AS (SELECT DISTINCT group_id, canonical_text AS s,
  len(list_filter(list_transform(string_split(canonical_text, ' '), lambda x: regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')), lambda x: regexp_full_match(x, '[\\p{L}\\p{M}''’‐-]{2,}'))) AS w
  FROM rec WHERE canonical_text IS NOT NULL),
name AS (SELECT group_id, s, row_number() OVER (PARTITION BY group_id ORDER BY w DESC, length(s) DESC, s) AS k FROM named),
total AS (SELECT group_id, CAST(sum(coalesce(occurrence_count, 0)) AS BIGINT) AS t FROM grp LEFT JOIN entities USING (entity_id) GROUP BY group_id)
SELECT pick.group_id, canonical_id, name.s AS canonical_text, coalesce(total.t, 0) AS total_mentions
FROM pick LEFT JOIN name ON name.group_id = pick.group_id AND name.k = 1 JOIN total ON total.group_id = pick.group_id WHERE pick.k = 1 AND pick.n >= 2
""",
}
