"""The knowledge graph as a projection of star-schema and text tables.

Each graph table is one SELECT in SQL that Spark and other engines share, over
raw tables or earlier graph tables.  Functions are customers, suppliers and
parts; calls are their order lines; files, coupling, entities, documents, tags
and links follow from keys by integer arithmetic alone, so every engine agrees.  Each order
line is two calls (customer to supplier, supplier to part), the first line of an
order, if returned, also one by dispatch (part to customer), and a customer with
urgent orders calls the next one; each part is a type with a field, used by its suppliers; files are coupled
by the days on which their nations' suppliers got orders.  No row of a raw table is
left out of the tables it stands for; where only some rows have an edge of a kind
(tags, links, mentions), what tells them apart is a class that the row carries.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from . import call_edges
from .store import new_version, publish

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "embeddings")

# Tags the catalogue asks for, with the documents that have them (id modulo m is r).
TAGS = (
    ("research", 3, 0), ("paper", 10, 3), ("index", 37, 0), ("design", 14, 1), ("tool", 12, 9), ("framework", 16, 6), ("survey", 18, 3),
    ("graph-similarity", 9, 3), ("graph-kernel", 18, 3), ("graph-embedding", 27, 12), ("cross-attention", 36, 21), ("query-expansion", 9, 6),
    ("aqe-local", 18, 6), ("aqe-global", 27, 15), ("llm-era-query-rewriting", 15, 6), ("chunking", 15, 9), ("deployment-model", 21, 12),
    ("reranking", 21, 3), ("rag-evaluation", 24, 18), ("code-rag", 12, 3), ("static-analysis", 30, 9), ("cross-corpus-validation", 22, 5),
    ("absence-as-signal", 26, 7), ("test-co-location", 34, 11), ("vocabulary-mismatch", 20, 0), ("negation-failure", 28, 4),
    ("vocabulary-mismatch-mitigation", 33, 8), ("audit-as-surface", 35, 2), ("query-reformulation", 38, 13), ("review-workflow", 23, 6),
    ("refactor-workflow", 29, 17), ("ingest-pass-storyline", 13, 10), ("iter-1", 17, 2), ("iter-2", 17, 5), ("audit", 11, 4), ("user-probe", 11, 3),
)

_KEY = "CAST({} AS STRING)"
_DAY = "lpad(CAST(1 + {} % 28 AS STRING), 2, '0')"


def _ends(kind: str) -> str:
    return f"SELECT symbol, fkey FROM Function WHERE fkind = '{kind}'"


PROJECTION: dict[str, str] = {
    "Function": """
        SELECT symbol, file, language, fkind, fkey, 1 + CAST(fkey % 400 AS INT) AS line,
          CASE WHEN fkey % 3 = 0 THEN NULL WHEN fkey % 3 = 1 THEN '' ELSE concat('Does step ', CAST(fkey AS STRING), CASE fkey % 4 WHEN 0 THEN ' for Africa' WHEN 1 THEN ' in the Middle East' WHEN 2 THEN ' across Europes' ELSE '' END) END AS doc_comment,
          CASE WHEN fkey % 4 = 0 THEN NULL WHEN fkey % 4 = 1 THEN '' ELSE concat('fn(', CAST(fkey % 9 AS STRING), ')') END AS signature,
          CASE WHEN fkey % 23 = 0 THEN 1 ELSE 0 END AS generated
        FROM (
          SELECT CASE c_custkey % 7 WHEN 0 THEN concat('backend/tests/test_n', CAST(c_nationkey AS STRING), '.py') WHEN 1 THEN concat('backend/app/routes/n', CAST(c_nationkey AS STRING), '.py')
              WHEN 2 THEN concat('backend/app/cli/n', CAST(c_nationkey AS STRING), '.py') ELSE concat('backend/app/core/n', CAST(c_nationkey AS STRING), '.py') END AS file,
            CASE c_custkey % 7
              WHEN 0 THEN concat('backend/tests/test_n', CAST(c_nationkey AS STRING), CASE c_custkey % 3 WHEN 0 THEN '/_helper' WHEN 1 THEN '/Case#__made' ELSE '/test_c' END, CAST(c_custkey AS STRING), '().')
              WHEN 2 THEN concat('app/cli/n', CAST(c_nationkey AS STRING), '/c', CAST(c_custkey AS STRING), '().')
              ELSE concat('app/n', CAST(c_nationkey AS STRING), CASE c_custkey % 5 WHEN 0 THEN '/_c' WHEN 1 THEN '/Base#_c' WHEN 2 THEN '/Base#c' WHEN 3 THEN '/__init__c' ELSE '/c' END, CAST(c_custkey AS STRING), '().') END AS symbol,
            'python' AS language, 'c' AS fkind, c_custkey AS fkey FROM customer
          UNION ALL
          SELECT concat('src/supply/n', CAST(s_nationkey AS STRING), CASE WHEN s_suppkey % 9 = 0 THEN '_tests.rs' WHEN s_suppkey % 11 = 0 THEN '/mod.rs' ELSE '.rs' END),
            concat('supply/n', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING), '().'), 'rust', 's', s_suppkey FROM supplier
          UNION ALL
          SELECT CASE WHEN p_partkey % 17 = 0 THEN concat('lib/', lower(replace(p_brand, '#', '')), CASE WHEN p_partkey % 2 = 0 THEN '.pyx' ELSE '.pxd' END)
              WHEN p_partkey % 19 = 0 THEN concat('lib/', lower(replace(p_brand, '#', '')), '.pyi')
              ELSE concat('frontend/src/', CASE p_partkey % 4 WHEN 0 THEN 'routes/' WHEN 1 THEN 'components/' WHEN 2 THEN 'client/' ELSE 'lib/' END, lower(replace(p_brand, '#', '')),
                CASE WHEN p_partkey % 13 = 0 THEN '.gen.ts' WHEN p_partkey % 29 = 0 THEN '.spec.tsx' ELSE '.tsx' END) END,
            concat('web/', replace(p_brand, '#', ''), CASE WHEN p_partkey % 3 = 0 THEN '/View#p' ELSE '/p' END, CAST(p_partkey AS STRING), '().'),
            CASE WHEN p_partkey % 17 = 0 THEN 'cython' WHEN p_partkey % 19 = 0 THEN 'python' ELSE 'typescript' END, 'p', p_partkey FROM part
        ) f""",
    "CALLS": """
        SELECT DISTINCT a.symbol AS src, b.symbol AS dst, a.file AS source_file, x.line AS source_line, x.dispatch AS dispatch FROM (
          SELECT 'c' AS ka, o_custkey AS a, 's' AS kb, l_suppkey AS b, l_linenumber AS line, 0 AS dispatch FROM orders JOIN lineitem ON l_orderkey = o_orderkey
          UNION ALL SELECT 's', l_suppkey, 'p', l_partkey, l_linenumber, 0 FROM lineitem
          UNION ALL SELECT 'p', l_partkey, 'c', o_custkey, l_linenumber, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_returnflag = 'R'
          UNION ALL SELECT 'c', o_custkey, 'c', o_custkey + 1, 1, 0 FROM orders WHERE o_orderpriority = '1-URGENT'
        ) x JOIN Function a ON a.fkind = x.ka AND a.fkey = x.a JOIN Function b ON b.fkind = x.kb AND b.fkey = x.b""",
    "File": """
        SELECT file AS path, min(language) AS language, 20 + 7 * count(*) + length(file) AS loc,
          CASE WHEN count(*) % 11 = 0 THEN NULL ELSE concat('2024-', lpad(CAST(1 + count(*) % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + length(file) % 28 AS STRING), 2, '0'), 'T00:00:00Z') END AS last_touched
        FROM Function GROUP BY file
        UNION ALL SELECT concat('docs/', r_name, '.md'), NULL, 0, NULL FROM region
        UNION ALL SELECT concat('backend/app/', lower(r_name), '/', x.base), 'python', 40 + r_regionkey, '2024-03-01T00:00:00Z' FROM region CROSS JOIN (VALUES ('models.py'), ('crud.py'), ('main.py'), ('__init__.py')) AS x(base)
        UNION ALL SELECT concat('tests/', lower(r_name), '_test.rs'), 'rust', 30 + r_regionkey, '2024-03-02T00:00:00Z' FROM region""",
    "DEFINED_IN_FILE": "SELECT symbol AS src, file AS dst FROM Function",
    "COUPLED_WITH": """
        SELECT a.f AS src, b.f AS dst, count(*) AS commits, max(a.d) AS last_co_change_at, CAST(count(*) AS DOUBLE) / (max(na.n) + max(nb.n) - count(*)) AS jaccard
        FROM (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, concat('backend/app/core/n', CAST(s_nationkey AS STRING), '.py') AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) a
        JOIN (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, concat('backend/app/core/n', CAST(s_nationkey AS STRING), '.py') AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) b ON a.d = b.d AND a.f < b.f
        JOIN (SELECT f, count(DISTINCT d) AS n FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, concat('backend/app/core/n', CAST(s_nationkey AS STRING), '.py') AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) q GROUP BY f) na ON na.f = a.f
        JOIN (SELECT f, count(DISTINCT d) AS n FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, concat('backend/app/core/n', CAST(s_nationkey AS STRING), '.py') AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) q GROUP BY f) nb ON nb.f = b.f
        GROUP BY a.f, b.f HAVING count(*) >= 2""",
    "entity_seed": """
        SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS id, p_brand AS display, CAST(substr(p_brand, 7) AS INT) AS n, 'brand' AS entity_class FROM part
        UNION ALL SELECT DISTINCT concat(CASE length(p_type) % 3 WHEN 0 THEN 'run-' WHEN 1 THEN 'build-' ELSE 'list-' END, lower(replace(p_type, ' ', '-'))), p_type, length(p_type), 'type' FROM part
        UNION ALL SELECT concat(CASE n_nationkey % 5 WHEN 0 THEN 'test-' WHEN 1 THEN 'debug-' ELSE '' END, lower(replace(n_name, ' ', '-'))), n_name, n_nationkey, 'nation' FROM nation
        UNION ALL SELECT lower(replace(r_name, ' ', '-')), r_name, r_regionkey, 'region' FROM region
        UNION ALL SELECT concat(lower(replace(r_name, ' ', '-')), 's'), concat(r_name, 's'), r_regionkey + 1, 'region' FROM region""",
    "FUNCTION_MENTIONS": """
        SELECT f.symbol AS src, lower(replace(p_brand, '#', '-')) AS dst, 'high' AS confidence FROM Function f JOIN part ON p_partkey = f.fkey WHERE f.fkind = 'p'
        UNION ALL SELECT f.symbol, s.id, 'high' FROM Function f JOIN part ON p_partkey = f.fkey JOIN entity_seed s ON s.display = p_type AND s.entity_class = 'type' WHERE f.fkind = 'p' AND f.fkey % 2 = 0
        UNION ALL SELECT f.symbol, s.id, 'low' FROM Function f JOIN customer ON c_custkey = f.fkey JOIN nation ON n_nationkey = c_nationkey JOIN entity_seed s ON s.display = n_name AND s.entity_class = 'nation' WHERE f.fkind = 'c'
        UNION ALL SELECT f.symbol, lower(replace(r_name, ' ', '-')), 'low' FROM Function f JOIN customer ON c_custkey = f.fkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE f.fkind = 'c' AND f.fkey % 2 = 0
        UNION ALL SELECT f.symbol, concat(lower(replace(r_name, ' ', '-')), 's'), 'low' FROM Function f JOIN customer ON c_custkey = f.fkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE f.fkind = 'c' AND f.fkey % 6 = 0""",
    "FUNCTION_BELONGS_TO": """
        SELECT f.symbol AS src, lower(replace(r_name, ' ', '-')) AS dst FROM Function f JOIN supplier ON s_suppkey = f.fkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE f.fkind = 's'
        UNION ALL SELECT f.symbol, s.id FROM Function f JOIN part ON p_partkey = f.fkey JOIN entity_seed s ON s.display = p_type AND s.entity_class = 'type' WHERE f.fkind = 'p' AND f.fkey % 3 = 0
        UNION ALL SELECT f.symbol, lower(replace(p_brand, '#', '-')) FROM Function f JOIN part ON p_partkey = f.fkey WHERE f.fkind = 'p' AND p_size % 25 = 0""",
    "Entity": """
        SELECT s.id, s.display, s.entity_class, coalesce(m.n, 0) AS mention_count, CASE WHEN coalesce(m.n, 0) >= 100 OR s.n = 11 THEN 1 ELSE 0 END AS is_god_node,
          CASE WHEN s.n % 3 = 0 THEN concat('Cluster anchored on ', s.display, ' density 0.', CAST(s.n % 2 AS STRING), CAST(s.n % 10 AS STRING), ' across ', CAST(1 + s.n % 5 AS STRING), ' file(s)')
            WHEN s.n % 3 = 1 THEN concat('See `', s.id, '` for details') WHEN s.n % 2 = 0 THEN '' ELSE concat('The idea of ', s.display) END AS description
        FROM entity_seed s LEFT JOIN (SELECT dst, count(*) AS n FROM FUNCTION_MENTIONS GROUP BY dst) m ON m.dst = s.id""",
    "entity_attributes": "SELECT id AS entity_id, concat('class=', entity_class) AS value FROM entity_seed WHERE n % 4 = 0 UNION ALL SELECT id, concat('size=', CAST(n AS STRING)) FROM entity_seed WHERE n % 8 = 0",
    "Type": """
        SELECT concat('web/', replace(p_brand, '#', ''), '/T', CAST(p_partkey AS STRING), CASE p_partkey % 7 WHEN 0 THEN 'Error#' WHEN 1 THEN 'Exception#' WHEN 2 THEN 'Failure#' WHEN 3 THEN 'Record#' WHEN 4 THEN 'SignalDetector#' ELSE '#' END) AS symbol,
          CASE p_partkey % 4 WHEN 0 THEN 'struct' WHEN 1 THEN 'enum' WHEN 2 THEN 'trait' ELSE 'type_alias' END AS kind,
          concat('frontend/src/', CASE p_partkey % 3 WHEN 0 THEN 'tests/' ELSE 'types/' END, lower(replace(p_brand, '#', '')), '.ts') AS file, CAST(p_partkey % 300 AS INT) AS line,
          CASE WHEN p_partkey % 2 = 0 THEN concat('Holds ', p_name) END AS doc_comment, concat('type T', CAST(p_partkey AS STRING)) AS signature, substr(p_name, 1, 30) AS body_excerpt, p_partkey AS tkey
        FROM part""",
    "TYPE_MENTIONS": "SELECT t.symbol AS src, lower(replace(p_brand, '#', '-')) AS dst, 'high' AS confidence FROM Type t JOIN part ON p_partkey = t.tkey UNION ALL SELECT t.symbol, s.id, 'low' FROM Type t JOIN part ON p_partkey = t.tkey JOIN entity_seed s ON s.display = p_type AND s.entity_class = 'type'",
    "USES_TYPE": "SELECT DISTINCT f.symbol AS src, t.symbol AS dst, l_linenumber AS source_line FROM lineitem JOIN Type t ON t.tkey = l_partkey JOIN Function f ON f.fkind = 's' AND f.fkey = l_suppkey",
    "Field": "SELECT concat(symbol, 'f', CAST(tkey AS STRING), '.') AS symbol, CASE tkey % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'owner_id' ELSE 'name' END AS name, symbol AS owner, file, line + 1 AS line FROM Type",
    "REFERENCES": "SELECT u.src, f.symbol AS dst, 'src/use.rs' AS source_file, u.source_line FROM USES_TYPE u JOIN Field f ON f.owner = u.dst",
    "METHOD_OF": "SELECT f.symbol AS src, t.symbol AS dst FROM Function f JOIN Type t ON f.fkind = 'p' AND t.tkey = f.fkey",
    "TEST_FOR": f"SELECT a.symbol AS src, b.symbol AS dst, 'high' AS confidence FROM ({_ends('c')}) a JOIN ({_ends('c')}) b ON b.fkey = a.fkey + 3 UNION ALL SELECT a.symbol, s.symbol, 'low' FROM ({_ends('c')}) a JOIN ({_ends('s')}) s ON s.fkey = a.fkey",
    "IMPORTS": "SELECT a.path AS src, b.path AS dst, 1 AS import_count FROM (SELECT n_nationkey AS n, concat('backend/app/core/n', CAST(n_nationkey AS STRING), '.py') AS path FROM nation) a JOIN (SELECT n_nationkey AS n, concat('backend/app/', CASE WHEN n_nationkey % 2 = 0 THEN 'core' ELSE 'routes' END, '/n', CAST(n_nationkey AS STRING), '.py') AS path FROM nation) b ON b.n = a.n % 7 OR b.n = a.n % 3",
    "Endpoint": """
        SELECT concat(kind, ':GET:/p/', CAST(page_id AS STRING)) AS id, kind, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('/p/', CAST(page_id AS STRING)) AS path, concat('handle_', CAST(page_id AS STRING)) AS handler_symbol,
          concat('backend/app/routes/n', CAST(page_id % 25 AS STRING), '.py') AS source_file, page_id % 200 AS source_line, page_id
        FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'fastapi' WHEN 1 THEN 'flask' WHEN 2 THEN 'express' WHEN 3 THEN 'jaxrs' WHEN 4 THEN 'mcp' WHEN 5 THEN 'clap' ELSE 'axum' END AS kind FROM pages) p""",
    "ENDPOINT_HANDLED_BY": f"SELECT e.id AS src, f.symbol AS dst FROM Endpoint e JOIN ({_ends('c')}) f ON f.fkey = e.page_id + 1",
    "ENDPOINT_TOUCHES_ENTITY": "SELECT DISTINCT h.src, m.dst FROM ENDPOINT_HANDLED_BY h JOIN FUNCTION_MENTIONS m ON m.src = h.dst JOIN Endpoint e ON e.id = h.src WHERE e.kind NOT IN ('mcp', 'express')",
    "Doc": """
        SELECT concat(CASE doc_id % 11 WHEN 0 THEN 'research-' WHEN 1 THEN 'research-' WHEN 2 THEN 'interrogation-' WHEN 3 THEN 'user-probe-' WHEN 4 THEN 'audit-run-' WHEN 5 THEN 'feature-' WHEN 6 THEN 'entity-' WHEN 7 THEN 'gap-' WHEN 8 THEN 'session-' WHEN 9 THEN 'prior-art-' ELSE 'ontology-' END, CAST(doc_id AS STRING)) AS id,
          concat(CASE WHEN doc_id % 8 = 0 THEN 'docs/design/' ELSE 'docs/' END, CAST(doc_id AS STRING), '.md') AS path,
          CASE doc_id % 11 WHEN 5 THEN 'feature' WHEN 6 THEN CASE doc_id % 4 WHEN 0 THEN 'ontology-entity' WHEN 1 THEN 'ontology-value' WHEN 2 THEN 'ontology-axis' ELSE 'ontology-migration' END WHEN 10 THEN 'index' ELSE 'doc' END AS role,
          CASE doc_id % 7 WHEN 0 THEN 'explanation' WHEN 1 THEN 'how-to' WHEN 2 THEN 'tutorial' WHEN 3 THEN 'reference' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'note' END AS kind,
          CASE WHEN doc_id % 39 = 13 THEN 'superseded' WHEN doc_id % 47 = 5 THEN 'archived' ELSE CASE doc_id % 5 WHEN 0 THEN 'planning' WHEN 1 THEN 'implementing' WHEN 2 THEN 'stable' WHEN 3 THEN '' ELSE NULL END END AS lifecycle,
          source AS bounded_context, substr(text, 1, 40) AS title,
          CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 11 IN (2, 3) THEN concat('On ', CASE doc_id % 4 WHEN 0 THEN 'graph-similarity' WHEN 1 THEN 'query-expansion' WHEN 2 THEN 'chunking' ELSE 'code-rag and reranking' END) ELSE substr(text, 1, 120) END AS summary,
          CASE WHEN doc_id % 6 = 0 THEN 'draft' WHEN doc_id % 13 = 0 THEN 'superseded' ELSE 'current' END AS status,
          CASE WHEN doc_id % 23 = 0 THEN NULL ELSE concat('2024-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) END AS updated,
          CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('phase-', CAST(doc_id % 4 AS STRING)) END AS phase, doc_id AS dkey
        FROM documents""",
    "doc_tags": f"SELECT d.id AS doc_id, t.value FROM Doc d JOIN (VALUES {', '.join(f'({v!r}, {m}, {r})' for v, m, r in TAGS)}) AS t(value, m, r) ON d.dkey % t.m = t.r UNION ALL SELECT id, 'only-here' FROM Doc WHERE dkey = 33 UNION ALL SELECT id, 'lone-topic' FROM Doc WHERE dkey = 198",
    "WIKILINK": "SELECT a.id AS src, b.id AS dst, CAST(1 + a.dkey % 40 AS INT) AS line FROM Doc a JOIN (SELECT id, dkey FROM Doc) b ON b.dkey = a.dkey div_ 2 UNION ALL SELECT a.id, b.id, 7 FROM Doc a JOIN (SELECT id, dkey FROM Doc) b ON b.dkey = a.dkey % 12 + 3 WHERE a.dkey % 2 = 0 UNION ALL SELECT a.id, b.id, 9 FROM Doc a JOIN (SELECT id, dkey FROM Doc) b ON b.dkey = a.dkey + 33 WHERE a.dkey % 3 = 0",
    "MD_LINK": "SELECT a.id AS src, b.id AS dst, 3 AS line FROM Doc a JOIN (SELECT id, dkey FROM Doc) b ON b.dkey = a.dkey + 5 WHERE a.dkey % 4 = 0",
    "INFORMED_BY": "SELECT a.id AS src, b.id AS dst, 5 AS line FROM Doc a JOIN (SELECT id, dkey FROM Doc) b ON b.dkey = a.dkey + 9 WHERE a.dkey % 6 = 0",
    "DEPENDS_ON": "SELECT a.id AS src, b.id AS dst, 2 AS line FROM Doc a JOIN (SELECT id, dkey FROM Doc) b ON b.dkey = a.dkey + 11 WHERE a.dkey % 3 <> 1",
    "SUPERSEDES": "SELECT a.id AS src, b.id AS dst, 1 AS line FROM Doc a JOIN (SELECT id, dkey FROM Doc) b ON b.dkey = a.dkey + 13 WHERE a.dkey % 26 = 0",
    "entity_rank": "SELECT id, row_number() OVER (ORDER BY id) AS k FROM entity_seed",
    "COVERS": """
        SELECT d.id AS src, e.id AS dst, CAST(d.dkey % 30 AS INT) AS line, 0 AS inferred FROM Doc d JOIN entity_rank e ON d.dkey % 41 = e.k WHERE d.dkey % 2 = 0
        UNION ALL SELECT d.id, e.id, 31, 1 FROM Doc d JOIN entity_rank e ON d.dkey % 5 + 42 = e.k WHERE d.dkey % 4 = 0
        UNION ALL SELECT d.id, e.id, 32, 1 FROM Doc d JOIN entity_rank e ON d.dkey % 13 + 47 = e.k WHERE d.dkey % 9 = 2
        UNION ALL SELECT d.id, e.id, 33, 1 FROM Doc d JOIN entity_rank e ON d.dkey % 4 + 61 = e.k WHERE d.dkey < 25""",
    "FUNCTION_DEFINED_IN": "SELECT f.symbol AS src, d.id AS dst FROM Function f JOIN Doc d ON f.fkind = 's' AND d.dkey = f.fkey",
    "RELATES_TO": "SELECT a.id AS src, b.id AS dst, 'part-of' AS type, 1 AS frequency FROM entity_seed a JOIN entity_seed b ON a.entity_class = 'nation' AND b.entity_class = 'region' AND a.n % 6 = b.n",
    "ENTITY_CALLS": "SELECT a.dst AS src, b.dst AS dst, count(*) AS frequency FROM CALLS c JOIN FUNCTION_BELONGS_TO a ON a.src = c.src JOIN FUNCTION_MENTIONS b ON b.src = c.dst WHERE a.dst <> b.dst GROUP BY a.dst, b.dst",
    "Finding": """
        SELECT concat('f', CAST(event_id AS STRING)) AS id, CASE event_id % 4 WHEN 0 THEN 'unstubbed-concept' WHEN 1 THEN 'todo' WHEN 2 THEN 'fixme' ELSE 'hack' END AS kind,
          CASE WHEN event_id % 4 = 0 THEN concat('doc-', CAST(user_id % 15 AS STRING)) ELSE concat('backend/app/core/n', CAST(user_id % 25 AS STRING), '.py') END AS file,
          CAST(event_id % 500 AS INT) AS line, CASE WHEN event_id % 4 = 0 THEN concat('term', CAST(user_id % 12 AS STRING)) ELSE concat('note ', CAST(event_id AS STRING)) END AS message, 'info' AS severity
        FROM events WHERE event_type = 'error'""",
    # What the checks read: front matter as authored, links and paths as written, declared vocabularies.
    "doc_front": """
        SELECT id, CASE WHEN dkey % 83 = 2 THEN 'docs/renamed.md' ELSE path END AS path, CASE WHEN dkey % 61 = 9 THEN NULL WHEN dkey % 73 = 2 THEN 'memo' ELSE role END AS role, CASE WHEN dkey % 61 = 9 THEN 'guide' END AS legacy_type, CASE WHEN dkey % 71 = 4 THEN 'guess' ELSE kind END AS kind, lifecycle, title, summary, updated, dkey,
          CASE WHEN dkey % 37 = 11 THEN 'auto' WHEN dkey % 41 = 3 THEN 'wip' ELSE status END AS status, CASE WHEN dkey % 17 = 3 THEN NULL ELSE bounded_context END AS bounded_context, CASE dkey % 31 WHEN 3 THEN 'secret' WHEN 4 THEN 'internal' WHEN 5 THEN 'public' END AS visibility,
          CASE WHEN dkey % 53 = 7 THEN 0 ELSE 1 END AS has_frontmatter, CASE WHEN dkey % 59 = 8 THEN 'mapping values are not allowed here' END AS parse_error, CASE WHEN dkey % 67 IN (6, 17) THEN 1 ELSE 0 END AS has_context_list,
          CASE WHEN dkey % 12 = 4 THEN 'example' ELSE concat('value-', CAST(dkey AS STRING)) END AS value_id, CASE WHEN dkey % 3 = 1 THEN 'Placeholder domain entity. Replace it.' ELSE 'A real one' END AS description
        FROM Doc""",
    "doc_front_line": "SELECT id AS doc_id, 6 AS line, concat('summary: ', CASE dkey % 43 WHEN 7 THEN 'fixes #12' WHEN 8 THEN '\"fixes #12\"' WHEN 9 THEN 'note: this' ELSE 'fixes it' END) AS text FROM Doc",
    "doc_target": """
        SELECT id AS src, 'md' AS kind, concat('docs/', CAST(dkey + CASE WHEN dkey % 29 = 4 THEN 1000000000 ELSE 0 END AS STRING), '.md') AS target, 3 AS line FROM Doc WHERE dkey % 8 <> 0
        UNION ALL SELECT id, 'md', concat('backend/app/core/n', CAST(dkey % 30 AS STRING), '.py'), 4 FROM Doc WHERE dkey % 6 = 1
        UNION ALL SELECT id, 'path', concat(CASE WHEN dkey % 2 = 0 THEN 'target/' ELSE 'src/' END, CAST(dkey % 9 AS STRING), '.rs'), 8 FROM Doc WHERE dkey % 14 = 3 OR dkey % 14 = 6
        UNION ALL SELECT id, 'wikilink', CASE WHEN dkey % 3 = 0 THEN id WHEN dkey % 3 = 1 THEN CAST(dkey AS STRING) ELSE concat('gone-', CAST(dkey AS STRING)) END, 9 FROM Doc WHERE dkey % 5 = 2
        UNION ALL SELECT src, 'wikilink', concat('entity-', dst), line FROM COVERS WHERE inferred = 0 AND line % 3 <> 1
        UNION ALL SELECT id, CASE WHEN dkey % 2 = 0 THEN 'depends-on' ELSE 'supersedes' END, CASE WHEN dkey % 4 = 3 THEN concat('nowhere-', CAST(dkey AS STRING)) ELSE id END, 2 FROM Doc WHERE dkey % 19 = 7""",
    "doc_covers": "SELECT src, dst FROM COVERS UNION ALL SELECT id, concat('no-entity-', CAST(dkey % 7 AS STRING)) FROM Doc WHERE dkey % 45 = 1",
    "known_path": "SELECT path FROM Doc UNION SELECT path FROM File",
    "bounded_context": "SELECT DISTINCT source AS id FROM documents WHERE source <> (SELECT max(source) FROM documents) UNION ALL SELECT concat('spare-', lower(r_name)) FROM region WHERE r_regionkey < 2",
    "entity_context": "SELECT e.id AS entity, b.id AS context FROM entity_seed e JOIN (SELECT id, row_number() OVER (ORDER BY id) AS k FROM bounded_context) b ON e.n % 7 = b.k UNION ALL SELECT id, 'elsewhere' FROM entity_seed WHERE n % 11 = 8",
    "doc_term": "SELECT d.id AS doc_id, e.display AS term, 5 AS line FROM Doc d JOIN (SELECT display, row_number() OVER (ORDER BY id) AS k FROM entity_seed) e ON d.dkey % 29 = e.k WHERE d.dkey % 3 = 1",
    "code_comment": "SELECT symbol, file, line, doc_comment AS text, CASE fkey % 4 WHEN 0 THEN 'Africa' WHEN 1 THEN 'Middle' WHEN 2 THEN 'Europes' ELSE 'Json' END AS term FROM Function WHERE doc_comment <> ''",
    "homepage": "SELECT concat('docs/home-', lower(replace(r_name, ' ', '-')), '.md') AS path, CASE r_regionkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('# ', r_name) ELSE '# Old' END AS text, concat('# ', r_name) AS expected FROM region",
    # What a decoded code index holds.
    "index_definition": "SELECT file, symbol, 'function' AS kind, line AS begin_line, line + 4 + CAST(fkey % 90 AS INT) AS end_line FROM Function UNION ALL SELECT file, symbol, kind, line, line + 40 FROM Type",
    "index_occurrence": """
        SELECT f.file, c.dst AS symbol, f.line + 1 + c.source_line AS line, 'reference' AS role FROM CALLS c JOIN Function f ON f.symbol = c.src
        UNION ALL SELECT f.file, u.dst, f.line + u.source_line, 'reference' FROM USES_TYPE u JOIN Function f ON f.symbol = u.src
        UNION ALL SELECT f.file, r.dst, f.line + r.source_line, 'reference' FROM REFERENCES r JOIN Function f ON f.symbol = r.src
        UNION ALL SELECT a.file, b.symbol, 1, 'import' FROM Function a JOIN Function b ON b.fkind = a.fkind AND b.fkey = a.fkey + 2 WHERE a.file <> b.file""",
    "index_relation": "SELECT a.symbol AS src, b.symbol AS dst FROM Function a JOIN Function b ON b.fkind = 'p' AND a.fkind = 'p' AND b.fkey = a.fkey + 1 UNION ALL SELECT a.symbol, b.symbol FROM Type a JOIN Type b ON b.tkey = a.tkey + 20 UNION ALL SELECT symbol, symbol FROM Type WHERE tkey % 15 = 0",
    "Migration": "SELECT concat('migration-', CAST(r_regionkey AS STRING)) AS id, CAST(r_regionkey AS INT) AS from_version, CAST(r_regionkey + 1 AS INT) AS to_version, r_name AS about FROM region",
    "Repo": "SELECT source AS id, concat('/', source) AS root, count(*) AS docs FROM documents WHERE source IS NOT NULL GROUP BY source",
    "HAS_FINDING": "SELECT file AS src, id AS dst FROM Finding WHERE kind <> 'unstubbed-concept'",
}


#: Tables that Spark makes by keys; the SQL above says the same.
BY_KEY = {
    "CALLS": call_edges.calls,
    # suppliers and parts belong to entities, parts and customers mention them
    "ENTITY_CALLS": lambda t: call_edges.between(t, t["FUNCTION_BELONGS_TO"], t["FUNCTION_MENTIONS"], ("sp", "pc")),
    "index_occurrence": lambda t: call_edges.references(t).unionByName(t.from_sql(PROJECTION["index_occurrence"].rsplit("UNION ALL ", 1)[1].replace("1, 'import'", "1 AS line, 'import' AS role").replace("b.symbol, 1", "b.symbol AS symbol, 1"))),
    # steps of queries
    "call_ends": call_edges.call_ends,
    **{f"call_ends_{k}": lambda t, k=k: call_edges.call_ends(t, tuple(x for x in call_edges.KINDS if x[0] == k)) for k in "csp"},
    "callers": lambda t: call_edges.degree(t, "dst", "src"),
    "callees": lambda t: call_edges.degree(t, "src", "dst"),
    "belongs_calls": lambda t: call_edges.between(t, t["FUNCTION_BELONGS_TO"], t["FUNCTION_BELONGS_TO"], ("sp",)),
}


def _needs(text: str) -> list[str]:
    return [n for n in PROJECTION if re.search(rf"\b{n}\b", text)]


def graph_order(names: set[str]) -> list[str]:
    """The tables named and those they are made from, in an order that can be built."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in _needs(PROJECTION[name]):
            if n != name and n not in out:
                add(n)
        if name not in out:
            out.append(name)

    for n in sorted(names):
        add(n)
    return out


def ctes(names: set[str]) -> str:
    """WITH clause for another engine, over its raw tables."""
    body = ",\n".join(f'"{n}" AS ({_quoted(PROJECTION[n].replace(" div_ ", " // "))})' for n in graph_order(names))
    return f"WITH {body}\n" if body else ""


def _quoted(text: str) -> str:
    # graph names as identifiers: some are keywords elsewhere
    return re.sub(rf"(?<!')\b({'|'.join(PROJECTION)})\b(?!')", r'"\1"', text)


class GraphTables(Mapping):
    """Graph tables as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}
        self.stored: str | None = None

    #: Stored graphs by the folder of the raw tables: root, version and tables read so far; :func:`store_graph` puts them here.
    STORED: dict[str, tuple[str, str, GraphTables]] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> GraphTables:
        """The graph of a folder of raw tables: as it was stored, if it was, else as a projection."""
        if sf_dir not in cls.STORED:
            return cls(spark, sf_dir)
        root, version, tables = cls.STORED[sf_dir]
        if tables.spark is not spark:  # another session reads anew
            tables = cls(spark, sf_dir)
            tables.stored = f"{root}/{version}"
            cls.STORED[sf_dir] = (root, version, tables)
        return tables

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in PROJECTION and self.stored:
                self.made[name] = self.spark.read.parquet(f"{self.stored}/{name}")
            elif name in BY_KEY and not self.stored:
                self.made[name] = BY_KEY[name](self)
            elif name in PROJECTION:
                self.made[name] = self.from_sql(PROJECTION[name], name)
            elif name in RAW:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise KeyError(name)
        return self.made[name]

    def from_sql(self, text: str, name: str = "") -> DataFrame:
        text = text.replace(" div_ ", " div ")
        names = [n for n in (*RAW, *PROJECTION) if n != name and re.search(rf"(FROM|JOIN) {n}\b", text)]
        for n in names:
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: self[n] for n in names})

    def __iter__(self):
        return iter(PROJECTION)

    def __len__(self) -> int:
        return len(PROJECTION)


def store_graph(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Write the whole projection of some raw tables as a new version under root; later reads of that folder's graph take it.

    Tables are written in the order of their needs, and each is read back for those made from it.
    """
    version = new_version()
    tables = GraphTables(spark, sf_dir)
    for name in graph_order(set(PROJECTION)):
        path = f"{root}/{version}/{name}"
        tables[name].write.parquet(path)
        tables.made[name] = spark.read.parquet(path)
    publish(spark, root, version)
    tables.stored = f"{root}/{version}"
    GraphTables.STORED[sf_dir] = (root, version, tables)
    return version
