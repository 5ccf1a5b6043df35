"""Sections and links of the files that all documents stand for, and the ontology that all customers stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import ontology, repository
from .analytics import Tables, extra

# An AsciiDoc file for each document, its whole text within a block of code; markers
# of other blocks stand in each block, so counting them does not tell what is code.
FILES = """
    SELECT concat('docs/doc-', doc_id, '.adoc') AS path, concat(
        '= Document ', doc_id, '\\n:lang: x\\n\\nAbout [[entity-', doc_id % 9, ']].\\n~~~\\n----\\n== hidden\\n~~~\\n== Whole text\\n----\\n| ', regexp_replace(coalesce(text, ''), '\\n', '\\n| '), '.\\n~~~\\n----\\n',
        '==== Part\\nSee xref:doc-', doc_id + 1, '.adoc#part[x], xref:mod:page.adoc[y] and `src/p', doc_id % 7, '/a.py`.\\n=== Part\\nlast') AS text
    FROM {documents} WHERE doc_id IS NOT NULL"""

_ROWS = "WITH d AS (SELECT doc_id AS k, 'docs/doc-' || doc_id || '.adoc' AS path, replace(coalesce(text, ''), chr(10), chr(10) || '| ') AS body FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT *, length(body) - length(replace(body, chr(10), '')) AS breaks FROM d)"


def adoc_files(t: Tables) -> DataFrame:
    docs = t["documents"]
    return docs.sparkSession.sql(FILES, documents=docs)


@extra(
    "derive_doc_sections",
    _ROWS
    + """, s AS (SELECT path, 'Document ' || k AS heading, 'document-' || k AS anchor, 1 AS level, 1 AS line, ':lang: x' || chr(10) || chr(10) || 'About [[entity-' || k % 9 || ']].' || chr(10) || '~~~' || chr(10) || '----' || chr(10) || '== hidden' || chr(10) || '~~~' AS text FROM n
        UNION ALL SELECT path, 'Whole text', 'whole-text', 2, 9, '----' || chr(10) || '| ' || replace(body, chr(13) || chr(10), chr(10)) || '.' || chr(10) || '~~~' || chr(10) || '----' FROM n
        UNION ALL SELECT path, 'Part', 'part', 4, 14 + breaks, 'See xref:doc-' || (k + 1) || '.adoc#part[x], xref:mod:page.adoc[y] and `src/p' || k % 7 || '/a.py`.' FROM n
        UNION ALL SELECT path, 'Part', 'part-1', 3, 16 + breaks, 'last' FROM n)
    SELECT path, heading, anchor, level, line, length(text) AS n_chars, md5(text) AS text_md5 FROM s""",
)
def derive_doc_sections(t: Tables) -> DataFrame:
    """All sections, each with the length and a digest of its text."""
    return repository.sections(adoc_files(t)).selectExpr("path", "heading", "anchor", "level", "line", "length(text) AS n_chars", "md5(CAST(text AS BINARY)) AS text_md5")


@extra(
    "derive_doc_links",
    _ROWS
    + """ SELECT path, 'wikilink' AS kind, 'entity-' || k % 9 AS target, 4 AS line FROM n
    UNION ALL SELECT path, 'xref', 'doc-' || (k + 1) || '.adoc', 15 + breaks FROM n
    UNION ALL SELECT path, 'inline_path', 'src/p' || k % 7 || '/a.py', 15 + breaks FROM n""",
)
def derive_doc_links(t: Tables) -> DataFrame:
    """All links outside code."""
    return repository.links(adoc_files(t))


ENTITY_FILES = """
    SELECT concat('ontology/customer-', c_custkey, '.md') AS path, concat('---\\nrole: ontology-entity\\ntitle: "Entity: ', c_name, '"\\nvalue_id: customer-', c_custkey, '\\ndisplay: \\'It\\'\\'s ', c_name, '\\'  # shown\\ndescription: >-\\n  Buys in\\n  ', c_mktsegment, '\\nstatus: ', CASE WHEN c_custkey % 9 = 4 THEN 'candidate' ELSE 'current' END,
        '\\nsynonyms: [client-', c_custkey, ', "', lower(c_mktsegment), ' buyer"]\\ncode_terms:\\n  - get-c', c_custkey, '\\nrelates_to:\\n  - target: nation-', c_nationkey, '\\n    type: lives_in\\n  - {{target: segment-', lower(c_mktsegment), ', type: buys_in}}\\n  - target: dropped\\nattributes:\\n  nation: ', c_nationkey, '\\n  open: true\\n---\\n# ', c_name) AS text
    FROM {customer} WHERE c_custkey IS NOT NULL
    UNION ALL SELECT concat('ontology/z-', c_custkey, '.md'), concat('---\\nrole: ontology-entity\\nvalue_id: customer-', c_custkey, '\\ndisplay: Later\\n---\\n') FROM {customer} WHERE c_custkey IS NOT NULL"""


@extra(
    "derive_ontology_entities",
    """WITH c AS (SELECT DISTINCT * FROM customer WHERE c_custkey IS NOT NULL)
    SELECT 'customer-' || c_custkey AS id, 'It''s ' || c_name AS display, 'Buys in ' || c_mktsegment AS description, CASE WHEN c_custkey % 9 = 4 THEN 'candidate' ELSE 'current' END AS status, 'client-' || c_custkey || '|' || lower(c_mktsegment) || ' buyer' AS synonyms, 'get-c' || c_custkey AS code_terms,
        'lives_in>nation-' || c_nationkey || '|buys_in>segment-' || lower(c_mktsegment) AS relations, 'nation=' || c_nationkey || '|open=true' AS attributes, 'ontology/customer-' || c_custkey || '.md' AS path FROM c""",
)
def derive_ontology_entities(t: Tables) -> DataFrame:
    """All entities; each is declared twice, and the file with the lesser path counts."""
    customer = t["customer"]
    found = ontology.entities(customer.sparkSession.sql(ENTITY_FILES, customer=customer))
    return found.selectExpr("id", "display", "description", "status", "array_join(synonyms, '|') AS synonyms", "array_join(code_terms, '|') AS code_terms", "array_join(transform(relates_to, r -> concat(r.type, '>', r.target)), '|') AS relations", "array_join(attributes, '|') AS attributes", "path")
