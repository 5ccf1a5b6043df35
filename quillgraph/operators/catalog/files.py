"""Files by path, language, size and layer."""

from __future__ import annotations

from ...plans.relation import rel
from .base import all_of, any_of, cols, count_if, counted, define, ends, has, ladder, lacks, starts

LAYOUT = "file-layout"
GENERATED = (".gen.", "/generated/", "/__generated__/", ".pb.")
CYTHON = (".pyx", ".pxd")


def listing(name: str, about: str, where, shown: str, order: list[str], limit: int | None, category: str = LAYOUT, **params: str) -> None:
    define(category, name, about, lambda p: rel("File f", where=where(p), out=cols("f", shown), order=order, limit=limit), **params)


listing("files-by-path-substring", "files whose path contains a text", lambda p: has("f.path", p.pattern), "path language loc", ["path"], None, pattern="core")
listing("generated-files", "generated files", lambda p: has("f.path", *GENERATED), "path language loc", ["path"], None)
listing("hand-written-source-files", "files written by hand", lambda p: all_of("f.language IS NOT NULL", lacks("f.path", *GENERATED)), "path language loc", ["path"], 200)
listing("files-containing-entity-id-in-path", "files whose path names an entity", lambda p: all_of(has("f.path", p.entity_id), lacks("f.path", "test")), "path loc language", ["path", "-loc"], 30, entity_id="brand8")
listing("files-under-folder-path", "files of a folder by size", lambda p: all_of(has("f.path", p.folder_path), lacks("f.path", "test")), "file_path=path loc", ["-loc", "file_path"], 30, folder_path="frontend/src")
listing("files-by-recency-desc", "files touched last", lambda p: "f.last_touched IS NOT NULL", "path last_touched loc", ["-last_touched", "path"], 10)
listing("files-by-recency-asc", "files untouched for longest", lambda p: "f.last_touched IS NOT NULL", "path last_touched loc", ["last_touched", "path"], 10)
listing("file-language-by-path", "language of a file", lambda p: f"f.path = {p.file_path}", "file_path=path language", ["file_path"], None, file_path="src/supply/n0.rs")
listing("rust-production-source-files", "rust sources that are no tests", lambda p: all_of("f.language = 'rust'", starts("f.path", "src/"), ends("f.path", ".rs"), f"NOT {ends('f.path', '_tests.rs', '_test.rs', '/mod.rs')}"), "path loc", ["path"], 100)
listing("test-files-for-domain", "test files of a domain", lambda p: all_of(has("f.path", p.domain), has("f.path", "test")), "file_path=path loc", ["-loc", "file_path"], 30, "test-surface", domain="n1")
listing("test-files-by-stem", "test files of a stem", lambda p: all_of(has("f.path", "test_"), has("f.path", p.stem)), "file_path=path loc", ["-loc", "file_path"], 30, "test-surface", stem="n1")


def labelled(name: str, about: str, where, label: str, value: str, shown: str, limit: int | None, category: str = LAYOUT, order: list[str] | None = None, **params: str) -> None:
    define(category, name, about, lambda p: rel("File f", where=where(p), out={**cols("f", shown), label: value}, order=order or [label, "path"], limit=limit), **params)


# Shared files and layers by a part of the path; the first that fits counts.
SHARED = (("/models.py", "models-shared"), ("/schema.py", "schema-shared"), ("/crud.py", "crud-shared"), ("/main.py", "app-entry"), ("/router.py", "router-aggregator"), ("/routes.py", "router-aggregator"), ("/index.tsx", "frontend-index"), ("/index.ts", "frontend-index"), ("/layout.tsx", "frontend-layout"), ("/__init__.py", "python-package-init"))
RESOURCE = (("/test", "test"), ("/routes/", "route"), ("/api/", "backend-api"), ("/components/", "frontend-component"), (".spec.", "frontend-spec"), (".tsx", "frontend-tsx"), (".ts", "frontend-ts"), (".py", "backend-py"))
LAYERS = (("/routes/", "frontend-route"), ("/components/", "frontend-component"), ("/client/", "frontend-client"), ("/api/", "backend-api"), ("/core/", "backend-core"), ("/crud", "backend-crud"), ("/alembic/", "backend-migrations"), ("/scripts/", "scripts"))


def by_part(parts) -> str:
    return ladder(*((has("f.path", a), b) for a, b in parts), default="other")


labelled("shared-layer-source-files", "well-known shared files", lambda p: all_of("f.language IS NOT NULL", lacks("f.path", "/test", ".gen.", "/generated/"), has("f.path", *(a for a, _ in SHARED))), "layer_role", by_part(SHARED), "path language loc", 50)
labelled("resource-file-cluster", "files of a resource by layer", lambda p: all_of(has("f.path", p.resource_stem), "f.language IS NOT NULL"), "layer", by_part(RESOURCE), "path language loc", 30, resource_stem="n1")
labelled("app-route-files", "route files of both ends", lambda p: all_of("f.language IS NOT NULL", any_of(all_of(has("f.path", "backend/"), has("f.path", "/routes/"), lacks("f.path", "/__init__", "/test")), all_of(has("f.path", "frontend/src/routes/"), lacks("f.path", "_layout.tsx", "__root.tsx")))), "layer", ladder((has("f.path", "backend/"), "backend-route"), default="frontend-route"), "path loc", 50)
labelled("cython-files-by-pattern", "cython files", lambda p: all_of(has("f.path", p.pattern), ends("f.path", *CYTHON)), "cython_kind", ladder((ends("f.path", ".pyx"), "cython-source"), (ends("f.path", ".pxd"), "cython-header"), default="unknown"), "path loc", None, order=["path"], pattern="lib")
labelled("rust-test-files-by-pattern", "rust tests by kind", lambda p: all_of("f.language = 'rust'", any_of(ends("f.path", "_tests.rs", "_test.rs"), starts("f.path", "tests/"), has("f.path", "/tests/"))), "test_kind", ladder((has("f.path", "tests/common"), "helper"), (any_of(starts("f.path", "tests/"), has("f.path", "/tests/")), "integration"), default="sibling"), "path loc", 50, "test-surface")
define(LAYOUT, "architectural-layers-by-path", "files and lines by layer", lambda p: rel("File f", where=all_of("f.language IS NOT NULL", lacks("f.path", "test", ".gen.", "/generated/")), by={"architectural_layer": by_part(LAYERS)}, agg={"file_count": "count(*)", "total_loc": "CAST(sum(f.loc) AS BIGINT)"}, order=["-total_loc", "architectural_layer"]))


def impl(name: str, about: str, where, order: list[str], limit: int, **params: str) -> None:
    define(LAYOUT if "basename" not in params and "impl" not in name else "symbol-lookup", name, about, lambda p: rel("File f", ("left", "Function t", f"t.file = f.path AND {lacks('t.symbol', 'tests/')}"), where=all_of(where(p), lacks("f.path", "tests/")), by={"file_path": "f.path"}, agg={"impl_count": "count(t.symbol)"}, order=order, limit=limit), **params)


impl("files-by-path-prefix", "files under a path with their functions", lambda p: starts("f.path", p.path_prefix), ["file_path"], 50, path_prefix="backend/")
impl("files-by-path-prefix-impl-count-desc", "files under a path, most functions first", lambda p: starts("f.path", p.path_prefix), ["-impl_count", "file_path"], 30, path_prefix="backend/")
impl("files-by-path-prefix-impl-count-asc", "files under a path, fewest functions first", lambda p: starts("f.path", p.path_prefix), ["impl_count", "file_path"], 30, path_prefix="backend/")
impl("files-by-basename", "files by the end of their path", lambda p: ends("f.path", p.basename), ["file_path"], 50, basename="n1.py")
impl("files-by-basename-and-path-prefix", "files by both ends of their path", lambda p: all_of(ends("f.path", p.basename), starts("f.path", p.path_prefix)), ["file_path"], 50, basename=".py", path_prefix="backend/app/core")
define(LAYOUT, "files-by-basename-count", "number of files by the end of their path", lambda p: counted("File f", where=all_of(ends("f.path", p.basename), lacks("f.path", "tests/")), name="file_count"), basename=".py")
define(LAYOUT, "files-by-basename-and-path-prefix-count", "number of files by both ends of their path", lambda p: counted("File f", where=all_of(ends("f.path", p.basename), starts("f.path", p.path_prefix), lacks("f.path", "tests/")), name="file_count"), basename=".py", path_prefix="backend/")
define(LAYOUT, "cython-file-count", "number of cython files", lambda p: counted("File f", where=all_of(ends("f.path", *CYTHON), lacks("f.path", "tests/")), name="cython_file_count"))
define(LAYOUT, "cython-presence-by-pattern", "whether a path has cython files", lambda p: rel(counted("File f", where=all_of(has("f.path", p.pattern), ends("f.path", *CYTHON)), name="n"), out={"cython_file_count": "n", "has_cython": ladder(("n >= 1", "yes"), default="no")}), pattern="lib")
define(LAYOUT, "files-by-pattern-language-split", "files of a path by language", lambda p: rel("File f", where=all_of(has("f.path", p.pattern), "f.loc IS NOT NULL AND f.loc > 0"), by={"language": "f.language"}, agg={"file_count": "count(f.path)", "total_loc": "CAST(sum(f.loc) AS BIGINT)", "max_loc": "max(f.loc)"}, order=["-total_loc", "language"]), pattern="lib")
define(LAYOUT, "entity-organizational-shape", "how many files an entity's name spans", lambda p: rel(counted("File f", where=all_of(has("f.path", p.entity_id), lacks("f.path", "test")), name="n"), out={"total_file_matches": "n", "organizational_shape": ladder(("n = 0", "absent"), ("n = 1", "single-file"), default="multi-file-or-folder")}), entity_id="brand8")
BACK_TEST, FRONT_TEST = has("f.path", "/test", "/tests/"), has("f.path", "/test", ".spec.", "/tests/")
define(LAYOUT, "resource-shape-classifier", "sources and tests of a resource on both ends", lambda p: rel(
    "File f", where=all_of(has("f.path", p.resource_stem), "f.language IS NOT NULL", lacks("f.path", "/__init__", ".gen.")),
    agg={"bs": count_if(f"{has('f.path', 'backend/')} AND NOT {BACK_TEST}"), "bt": count_if(f"{has('f.path', 'backend/')} AND {BACK_TEST}"), "fs": count_if(f"{has('f.path', 'frontend/')} AND NOT {FRONT_TEST}"), "ft": count_if(f"{has('f.path', 'frontend/')} AND {FRONT_TEST}")},
    out={"backend_src": "CAST(bs AS BIGINT)", "backend_test": "CAST(bt AS BIGINT)", "frontend_src": "CAST(fs AS BIGINT)", "frontend_test": "CAST(ft AS BIGINT)", "shape_label": ladder(("bs >= 1 AND fs >= 1", "symmetric"), ("bs >= 1", "backend-only"), ("fs >= 1", "frontend-only"), default="empty")},
), resource_stem="n1")

SOURCES = all_of("f.language IS NOT NULL", lacks("f.path", ".gen.", "/generated/", "/__generated__/", "test"))
# Files within 20 lines share a band of 20 lines or lie in neighbouring ones: an equality to join on.
BANDED = rel("File f", where=all_of(SOURCES, lacks("f.path", ".pb."), "f.loc >= 100"), out={**cols("f", "path loc language"), "band": "f.loc div 20"})
define(LAYOUT, "loc-pair-clone-candidates", "files of one language and nearly one size", lambda p: rel(
    BANDED, (rel(BANDED, alias="f", out={**cols("f", "path loc language"), "near": "f.band - 1"}, union=[rel(BANDED, alias="f", out={**cols("f", "path loc language"), "near": f"f.band + {k}"}) for k in (0, 1)]), "b.language = a.language AND b.near = a.band", "b"),
    alias="a", where="a.path < b.path AND a.loc <= b.loc + 20 AND b.loc <= a.loc + 20", out={"path_a": "a.path", "path_b": "b.path", "loc_a": "a.loc", "loc_b": "b.loc", "language": "a.language"}, order=["-loc_a", "path_a", "path_b"], limit=25,
))
NAMED = rel("File f", where=SOURCES, out={**cols("f", "path loc language"), "basename": "BASENAME(f.path)"})
define(LAYOUT, "same-name-cross-dir-clones", "files of one name in several folders", lambda p: rel(NAMED, (NAMED, "b.language = a.language AND b.basename = a.basename", "b"), alias="a", where="a.path < b.path", out={"path_a": "a.path", "path_b": "b.path", "basename": "a.basename", "language": "a.language", "loc_a": "a.loc", "loc_b": "b.loc"}, order=["basename", "path_a", "path_b"], limit=25))
PROD = rel("File f", where=lacks("f.path", "/tests/"), out={**cols("f", "path loc language"), "test_name": "concat('test_', BASENAME(f.path))"})
TEST = rel("File f", where=has("f.path", "/tests/"), out={**cols("f", "path loc"), "name": "BASENAME(f.path)"})
define("test-surface", "pytest-prod-test-pairs", "sources with their test files", lambda p: rel(PROD, (TEST, "t.name = a.test_name", "t"), alias="a", where="a.path < t.path", out={"production": "a.path", "test": "t.path", "prod_loc": "a.loc", "test_loc": "t.loc"}, order=["-prod_loc", "production", "test"], limit=25))
define("test-surface", "python-untested-files", "python sources without a test file", lambda p: rel(PROD, ("anti", TEST, "t.name = a.test_name", "t"), alias="a", where=all_of("a.language = 'python'", "a.loc >= 20", lacks("a.path", "/__pycache__/")), out={"path": "a.path", "loc": "a.loc"}, order=["-loc", "path"], limit=25))
define("test-surface", "test-writing-card", "test functions and files of a stem", lambda p: rel(counted("Function f", where=all_of(has("f.symbol", p.stem), has("f.symbol", "test_")), name="n", what="count(DISTINCT f.symbol)"), ("cross", counted("File f", where=all_of(has("f.path", "test_"), has("f.path", p.stem)), name="n", what="count(DISTINCT f.path)"), None, "b"), alias="a", out={"test_function_count": "a.n", "test_file_count": "b.n"}), stem="n1")
define("other-nodes", "findings-by-attachment-mode", "findings in documents against sources", lambda p: rel("Finding f", by={"attachment_mode": ladder(("f.kind = 'unstubbed-concept'", "doc-unstubbed-concept"), default="source-code-marker")}, agg={"finding_count": "count(*)"}, order=["-finding_count", "attachment_mode"]))
define("other-nodes", "unstubbed-concepts-by-doc", "unstubbed concepts by document", lambda p: rel("Finding f", where="f.kind = 'unstubbed-concept'", by={"doc_id": "f.file"}, agg={"finding_count": "count(f.id)"}, order=["-finding_count", "doc_id"], limit=20))
define("other-nodes", "unstubbed-concepts", "unstubbed concepts with their documents", lambda p: rel("Finding f", where="f.kind = 'unstubbed-concept'", by={"term": "f.message"}, agg={"mentions": "count(f.id)", "source_docs": "SET(f.file)"}, order=["-mentions", "term"]))
define("other-nodes", "findings-by-file", "findings by file", lambda p: rel("File f", ("HAS_FINDING h", "h.src = f.path"), ("Finding g", "g.id = h.dst"), by={"file.path": "f.path"}, agg={"findings": "count(g.id)", "sample_kinds": "SET(g.kind)"}, order=["-findings", "file.path"]))
define("file-coupling", "import-fan-out", "files by how many import them", lambda p: rel("IMPORTS r", ("File i", "i.path = r.dst"), ("semi", "File s", "s.path = r.src"), by={"imported.path": "i.path", "imported.language": "i.language"}, agg={"importers": "count(DISTINCT r.src)"}, order=["-importers", "imported.path"], limit=50))
