"""Functions, types, fields, endpoints and calls."""

from __future__ import annotations

from ...plans.relation import lit, rel
from ...sources.call_edges import ends_under
from .base import all_of, any_of, cols, count_if, counted, define, dotted, ends, has, ladder, lacks, no_test_symbol, not_stub, outside_tests, ratio, records, side_by_side, starts

CALLS, SYMBOLS = "call-graph", "symbol-lookup"
TESTS = "test-surface"


# ------------------------------------------------------------ symbol lists
def symbols(name: str, about: str, where, limit: int, category: str = SYMBOLS, **params: str) -> None:
    define(category, name, about, lambda p: rel("Function f", where=where(p), out={"function_symbol": "f.symbol"}, order=["function_symbol"], limit=limit), **params)


symbols("mirrored-private-functions-by-suffix", "module-level functions whose symbol contains a text", lambda p: all_of(has("f.symbol", p.suffix), lacks("f.symbol", "#")), 40, suffix="/_c")
symbols("protocol-module-functions", "functions of a module", lambda p: has("f.symbol", p.protocol_module_substring), 40, protocol_module_substring="app/n1")
symbols("protocol-module-class-methods", "methods of a module", lambda p: all_of(has("f.symbol", p.protocol_module_substring), has("f.symbol", "#")), 60, protocol_module_substring="app/n1")
symbols("abstract-base-private-hooks", "private methods of a class", lambda p: all_of(has("f.symbol", p.class_path_substring), has("f.symbol", "#_")), 30, class_path_substring="Base")
symbols("abstract-base-private-hooks-non-test", "private methods of a class, without tests", lambda p: all_of(has("f.symbol", p.class_path_substring), has("f.symbol", "#_"), no_test_symbol("f")), 30, TESTS, class_path_substring="Base")
symbols("function-axis-symbol-search", "functions whose symbol contains a term", lambda p: all_of(has("f.symbol", p.term), no_test_symbol("f")), 40, term="n2/")
symbols("functions-in-cli-module", "functions of the command line", lambda p: all_of(has("f.symbol", ".cli.", "/cli/"), no_test_symbol("f")), 60)
symbols("methods-on-class-by-substring", "methods of classes whose name contains a text", lambda p: all_of(has("f.symbol", p.class_name), has("f.symbol", "#"), no_test_symbol("f")), 40, class_name="View")
symbols("test-functions-by-stem", "test functions that contain a stem", lambda p: all_of(has("f.symbol", p.stem), has("f.symbol", "test_")), 30, TESTS, stem="n1")
symbols("test-fixture-helpers-by-stem", "private helpers of tests", lambda p: all_of(has("f.symbol", p.stem), has("f.symbol", "test_"), has("f.symbol", "/_", "#_")), 20, TESTS, stem="n1")
symbols("test-private-function-helpers-by-stem", "module-level private helpers of tests", lambda p: all_of(has("f.symbol", p.stem), has("f.symbol", "test_"), has("f.symbol", "/_"), lacks("f.symbol", "#__")), 20, TESTS, stem="n1")
symbols("test-inner-class-helpers-by-stem", "inner-class helpers of tests", lambda p: all_of(has("f.symbol", p.stem), has("f.symbol", "test_"), has("f.symbol", "#__"), lacks("f.symbol", "tests.test_")), 20, TESTS, stem="n1")
define(TESTS, "functions-mentioning-test-entity", "functions that mention an entity about tests", lambda p: rel("FUNCTION_MENTIONS m", ("semi", "Function f", "f.symbol = m.src"), ("semi", "Entity e", "e.id = m.dst"), where=f"m.dst = {p.test_entity_id}", out={"function_symbol": "m.src"}, order=["function_symbol"], limit=30), test_entity_id="test-nation_10")

TYPE_CARD = "type_symbol=symbol file_path=file line body_excerpt"


def types(name: str, about: str, where, shown: str = TYPE_CARD, order=("type_symbol",), limit: int = 30, **params: str) -> None:
    define(SYMBOLS, name, about, lambda p: rel("Type t", where=where(p), out=cols("t", shown), order=list(order), limit=limit), **params)


types("types-by-symbol-pattern", "types whose symbol contains a text", lambda p: all_of(has("t.symbol", p.pattern), outside_tests("t")), "symbol kind file line", ("file", "line", "symbol"), 50, pattern="Error")
types("types-by-file-pattern", "types whose file contains a text", lambda p: all_of(has("t.file", p.pattern), outside_tests("t")), "file symbol kind line", ("file", "line", "symbol"), 50, pattern="types/")
types("types-by-name-substring", "types with their signature", lambda p: all_of(has("t.symbol", p.term), no_test_symbol("t")), "type_symbol=symbol file_path=file line kind signature body_excerpt", term="Record")
types("error-type-catalog", "types of errors", lambda p: all_of(ends("t.symbol", "Error#", "Exception#"), no_test_symbol("t")))
types("failure-mode-class-catalog", "types of failures", lambda p: all_of(ends("t.symbol", "Error#", "Exception#", "Failure#", "Issue#", "Fault#", "Diagnosis#"), no_test_symbol("t")))
types("signal-class-by-substring", "types of signals", lambda p: all_of(has("t.symbol", p.term), has("t.symbol", "Signal", "Signature", "Detector", "Record", "Observation"), no_test_symbol("t")), term="T1")

define(SYMBOLS, "functions-by-symbol-pattern", "functions whose symbol contains a text", lambda p: rel("Function f", where=all_of(has("f.symbol", p.pattern), outside_tests("f")), out=cols("f", "symbol file line language"), order=["file", "line", "symbol"], limit=50), pattern="supply/n4/s")
define(SYMBOLS, "functions-in-directory", "functions under a path", lambda p: rel("Function f", where=starts("f.file", p.prefix), out=cols("f", "symbol file line signature"), order=["file", "line", "symbol"]), prefix="src/supply/")
define(SYMBOLS, "functions-in-file", "functions of a file", lambda p: rel("Function f", where=f"f.file = {p.path}", out=cols("f", "symbol line doc_comment signature"), order=["line", "symbol"]), path="backend/app/core/n1.py")
define(SYMBOLS, "types-in-file", "types of a file", lambda p: rel("Type t", where=f"t.file = {p.path}", out=cols("t", "symbol kind line doc_comment signature"), order=["line", "symbol"]), path="frontend/src/types/brand8.ts")
define(TESTS, "tests-in-file", "tests of a file", lambda p: rel("Function f", where=all_of(f"f.file = {p.path}", has("f.symbol", "tests/")), out=cols("f", "symbol line doc_comment"), order=["line", "symbol"]), path="backend/tests/test_n1.py")
define(SYMBOLS, "function-files-by-pattern", "functions by file", lambda p: rel("Function f", where=has("f.file", p.pattern), by={"file": "f.file"}, agg={"fn_count": "count(f.symbol)"}, order=["-fn_count", "file"]), pattern="core")
define(SYMBOLS, "public-api-functions", "public functions by file", lambda p: rel("Function f", where=all_of(lacks("f.file", "/tests/", "/test_"), lacks("f.symbol", "__init__", "/_")), by={"file": "f.file"}, agg={"public_fn_count": "count(f.symbol)"}, order=["-public_fn_count", "file"], limit=25))
define(SYMBOLS, "function-axis-token-distribution-for-stem", "methods, private functions and tests of a stem", lambda p: rel("Function f", where=has("f.symbol", p.stem), agg={
    "class_method_count": f"count(DISTINCT CASE WHEN {has('f.symbol', '#')} AND {no_test_symbol('f')} THEN f.symbol END)", "private_count": f"count(DISTINCT CASE WHEN {has('f.symbol', '/_')} AND {no_test_symbol('f')} THEN f.symbol END)", "test_count": f"count(DISTINCT CASE WHEN {has('f.symbol', 'test_')} THEN f.symbol END)"}), stem="n1")
define(SYMBOLS, "mcp-handlers", "handlers of mcp endpoints", lambda p: rel("Endpoint e", ("ENDPOINT_HANDLED_BY h", "h.src = e.id"), ("Function f", "f.symbol = h.dst"), where="e.kind = 'mcp'", out={"tool_name": "e.path", "handler_symbol": "e.handler_symbol", "function_symbol": "f.symbol", "file": "f.file", "line": "f.line"}, order=["tool_name", "function_symbol"]))
define(SYMBOLS, "field-references", "where fields of a name are read", lambda p: rel("Field f", ("left", "REFERENCES r", "r.dst = f.symbol"), ("left", "Function g", "g.symbol = r.src"), where=has("f.name", p.name), out={"field": "f.symbol", "owner": "f.owner", "defined_in": "f.file", "defined_line": "f.line", "function": "g.symbol", "file": "r.source_file", "line": "r.source_line"}, order=["field", "file", "line", "function"], limit=50), name="own")

AXES = (("File f", "f.path", "count(DISTINCT f.path)"), ("Function f", "f.file", "count(DISTINCT f.file)"), ("Function f", "f.file", "count(*)"))


def _axes(p, *more):
    made = [counted(s, where=has(c, p.pattern), name="n", what=w) for s, c, w in AXES] + list(more)
    return made


RICH = (("c0.n >= 4 AND c1.n >= 4", "both-rich"), ("c0.n >= 4", "file-rich-fn-sparse"), ("c1.n >= 4", "file-sparse-fn-rich"))
AXES_OUT = {"file_axis_count": "c0.n", "fn_axis_distinct_files": "c1.n", "fn_total_count": "c2.n"}
define(SYMBOLS, "path-axis-completeness-fingerprint", "files against functions of a path", lambda p: side_by_side(*_axes(p), out={**AXES_OUT, "axis_completeness_label": ladder(*RICH, default="both-sparse")}), pattern="core")
define(SYMBOLS, "path-axis-fingerprint-cython-aware", "the same, aware of cython", lambda p: side_by_side(
    *_axes(p, counted("File f", where=all_of(has("f.path", p.pattern), ends("f.path", ".pyx", ".pxd")), name="n")), out={**AXES_OUT, "cython_file_count": "c3.n", "cython_aware_label": ladder(("c3.n >= 1", "cython-implementation-detected"), *RICH, default="both-sparse")},
), pattern="lib")

# ------------------------------------------------------------------- calls
ONE = "supply/n4/s77()."


def slices(name: str, about: str, mine: str, other: str, alias: str, by_file: str | None) -> None:
    """Callers or callees of one function, listed or counted by file."""

    def build(p):
        base = dict(where=all_of(f"c.{mine} = {p.symbol}", f"o.symbol <> {p.symbol}"))
        joins = ("CALLS c", ("semi", "Function me", f"me.symbol = c.{mine}"), ("Function o", f"o.symbol = c.{other}"))
        if by_file:
            return rel(*joins, **base, by={f"{alias}_file": "o.file"}, agg={by_file: "count(DISTINCT o.symbol)"}, order=[f"-{by_file}", f"{alias}_file"], limit=25)
        return rel(*joins, **base, out={f"{alias}_symbol": "o.symbol", f"{alias}_file": "o.file"}, distinct=True, order=[f"{alias}_symbol"])

    define(CALLS, name, about, build, symbol=ONE)


slices("function-backward-slice", "direct callers of a function", "dst", "src", "caller", None)
slices("function-forward-slice", "direct callees of a function", "src", "dst", "callee", None)
slices("function-blast-radius-by-file", "callers of a function by file", "dst", "src", "caller", "distinct_callers")
slices("function-callees-by-file", "callees of a function by file", "src", "dst", "callee", "distinct_callees")

SHAPES = (
    ("{c} >= 5 AND {cf} = 1 AND {e} = 0", "pure-leaf-factory"), ("{c} >= 5 AND {cf} >= 2 AND {e} = 0", "wide-leaf-utility"), ("{c} >= 5 AND {cf} >= 3 AND {e} BETWEEN 1 AND 2", "thin-entry-point"),
    ("{c} >= 5 AND {cf} = 1 AND {e} >= 1", "subsystem-hub"), ("{c} >= 5 AND {cf} >= 2 AND {e} >= 5", "extension-point"),
)


def shape(c: str, cf: str, e: str) -> str:
    return ladder(*((t.format(c=c, cf=cf, e=e), name) for t, name in SHAPES), default="peripheral")


def degree(mine: str, other: str, where: str | None = None):
    """Distinct functions on the other end of a function's calls, and their files."""
    fast = rel({"dst": "callers d", "src": "callees d"}[mine], out=cols("d", "k n files")) if where is None else None
    return rel("CALLS r", ("Function o", f"o.symbol = r.{other} AND r.src <> r.dst"), where=where, by={"k": f"r.{mine}"}, agg={"n": "count(DISTINCT o.symbol)", "files": "count(DISTINCT o.file)"}, fast=fast)


SHAPED = rel(
    "Function f", (degree("dst", "src"), "i.k = f.symbol AND i.n >= 5", "i"), ("left", degree("src", "dst"), "o.k = f.symbol", "o"), where=outside_tests("f"),
    out={"file": "f.file", "symbol": "f.symbol", "caller_count": "i.n", "caller_file_count": "i.files", "callee_count": "coalesce(o.n, 0)", "shape": shape("i.n", "i.files", "coalesce(o.n, 0)")},
)
define(CALLS, "function-shape-distribution", "functions by call shape", lambda p: rel(SHAPED, by={"shape": "shape"}, agg={"function_count": "count(symbol)"}, order=["-function_count", "shape"]))
define(CALLS, "function-shape-by-file", "functions by file and call shape", lambda p: rel(SHAPED, by={"file": "file", "shape": "shape"}, agg={"function_count": "count(symbol)"}, order=["file", "-function_count", "shape"]))
define(CALLS, "functions-of-shape", "functions of a call shape", lambda p: rel(SHAPED, where=f"shape = {p.shape_label}", out={k: k for k in ("symbol", "file", "caller_count", "caller_file_count", "callee_count")}, order=["-caller_count", "symbol"], limit=25), shape_label="extension-point")
define(CALLS, "file-shape-profile", "functions of a file with their shape", lambda p: rel(SHAPED, where=has("file", p.file_path), order=["file", "-caller_count", "symbol"], limit=50), file_path="supply")


def _ends(p, mine: str, other: str):
    return counted("CALLS r", ("Function o", f"o.symbol = r.{other}"), ("semi", "Function me", f"me.symbol = r.{mine}"), where=f"r.{mine} = {p.symbol} AND o.symbol <> {p.symbol}", name="n", what="count(DISTINCT o.symbol)"), counted(
        "CALLS r", ("Function o", f"o.symbol = r.{other}"), ("semi", "Function me", f"me.symbol = r.{mine}"), where=f"r.{mine} = {p.symbol} AND o.symbol <> {p.symbol}", name="n", what="count(DISTINCT o.file)")


define(CALLS, "function-shape-summary", "call shape of a function", lambda p: side_by_side(*_ends(p, "dst", "src"), *_ends(p, "src", "dst"), out={"caller_count": "c0.n", "caller_file_count": "c1.n", "callee_count": "c2.n", "callee_file_count": "c3.n", "shape": shape("c0.n", "c1.n", "c2.n")}), symbol="supply/n4/s77().")
define(CALLS, "function-direct-callers-count", "distinct callers of a function", lambda p: rel("Function f", ("left", rel("CALLS r", ("semi", "Function c", "c.symbol = r.src"), by={"k": "r.dst"}, agg={"n": "count(DISTINCT r.src)"}), "i.k = f.symbol", "i"), where=f"f.symbol = {p.function_symbol}", out={"function_symbol": "f.symbol", "direct_caller_count": "coalesce(i.n, 0)"}), function_symbol="supply/n4/s77().")
define(CALLS, "callgraph-roots", "functions that nothing calls", lambda p: rel("Function f", ("anti", "CALLS c", "c.dst = f.symbol"), out=dotted("f", "symbol file line language"), order=["f.file", "f.line", "f.symbol"]))
define(CALLS, "dead-files", "files none of whose functions is called or handles an endpoint", lambda p: rel(
    "File f", ("semi", "DEFINED_IN_FILE d", "d.dst = f.path"), ("anti", rel("DEFINED_IN_FILE d", ("semi", rel("CALLS c", out={"s": "c.dst"}, union=[rel("ENDPOINT_HANDLED_BY h", out={"s": "h.dst"})]), "u.s = d.src", "u"), out={"path": "d.dst"}), "g.path = f.path", "g"), out=dotted("f", "path language loc"), order=["-f.loc", "f.path"],
))


def _ends_under(prefix: str) -> str:
    """By a parameter, which is a literal."""
    return ends_under(prefix[1:-1].replace("''", "'"))


def _cohesion(i: str, e: str, k: str) -> str:
    share = f"({e} * 100) div ({i} + {e})"
    return ladder((f"{k} = 0", "empty"), (f"{i} + {e} = 0", "stub-only-cython"), (f"{e} = 0", "cohesive"), (f"{k} <= 2 AND {i} = 0", "leaf-with-deps"), (f"{share} <= 10", "mostly-cohesive"), (f"{share} <= 67", "balanced-dependent"), default="heavily-dependent")


def file_calls(where: str, ends: str = "call_ends"):
    """(file_path, impl_count, internal_count, external_count) of files of functions that meet a condition on f; ``ends`` has the calls of all of these."""
    mine = rel("Function f", where=all_of(where, outside_tests("f")), out=cols("f", "symbol file"))
    per = rel(mine, by={"file_path": "file"}, agg={"impl_count": "count(*)"})
    calls = rel(mine, ("CALLS r", "r.src = m.symbol"), ("Function c", "c.symbol = r.dst"), alias="m", by={"fp": "m.file"}, agg={"i": "sum(CASE WHEN c.file = m.file THEN 1 ELSE 0 END)", "e": "sum(CASE WHEN c.file <> m.file THEN 1 ELSE 0 END)"},
        fast=rel(f"{ends} f", where=all_of(where, outside_tests("f")), by={"fp": "f.file"}, agg={"i": "sum(CASE WHEN f.dst_file = f.file THEN f.n ELSE 0 END)", "e": "sum(CASE WHEN f.dst_file <> f.file THEN f.n ELSE 0 END)"}))
    return rel(per, ("left", calls, "k.fp = p.file_path", "k"), alias="p", out={"file_path": "p.file_path", "impl_count": "p.impl_count", "internal_count": "CAST(coalesce(k.i, 0) AS BIGINT)", "external_count": "CAST(coalesce(k.e, 0) AS BIGINT)"})


COHESION = {**{k: k for k in ("file_path", "impl_count", "internal_count", "external_count")}, "external_pct": ratio("external_count", "(internal_count + external_count)", "100"), "cohesion_label": _cohesion("internal_count", "external_count", "impl_count")}
for _suffix, _first in (("", "-external_pct"), ("-asc", "external_pct")):
    define(CALLS, f"per-file-cohesion-by-path-prefix{_suffix}", "cohesion of the files under a path", lambda p, o=_first: rel(file_calls(starts("f.file", p.path_prefix), _ends_under(p.path_prefix)), out=COHESION, order=[o, "file_path"], limit=30), path_prefix="frontend/")
define(CALLS, "module-cohesion-classifier", "cohesion of the functions that match a text", lambda p: rel(
    rel(rel("Function f", where=all_of(has("f.symbol", p.pattern), outside_tests("f")), out=cols("f", "symbol file")), ("left", rel("CALLS r", ("Function c", "c.symbol = r.dst"), out={"src": "r.src", "cf": "c.file"}), "k.src = b.symbol", "k"), alias="b",
        agg={"impl_count": "count(DISTINCT b.symbol)", "i": count_if("k.cf = b.file"), "e": count_if("k.cf <> b.file")}),
    out={"impl_count": "impl_count", "internal_count": "CAST(i AS BIGINT)", "external_count": "CAST(e AS BIGINT)", "external_pct": ratio("e", "(i + e)", "100"), "cohesion_label": _cohesion("i", "e", "impl_count")},
), pattern="web/Brand1")


def leaves(where: str, ends: str = "call_ends"):
    return rel(file_calls(where, ends), where="impl_count <= 2 AND internal_count = 0 AND external_count > 0")


ANY = "1 = 1"
define(CALLS, "leaf-with-deps-files", "small files that only call others", lambda p: rel(leaves(ANY), order=["-external_count", "impl_count", "file_path"], limit=50))
define(CALLS, "leaf-with-deps-files-by-basename", "such files by the end of their path", lambda p: rel(leaves(ends("f.file", p.basename)), order=["-external_count", "file_path"], limit=50), basename=".spec.tsx")
define(CALLS, "leaf-with-deps-files-by-path-prefix", "such files by the beginning of their path", lambda p: rel(leaves(starts("f.file", p.path_prefix), _ends_under(p.path_prefix)), order=["-external_count", "file_path"], limit=50), path_prefix="frontend/")
define(CALLS, "leaf-with-deps-count-by-basename", "number of such files", lambda p: rel(leaves(ends("f.file", p.basename)), agg={"template_instance_count": "count(file_path)"}), basename=".tsx")
define(CALLS, "template-directory-survey", "files under a path with a label of their calls", lambda p: rel(
    rel("File f", ("left", "Function t", f"t.file = f.path AND {lacks('t.symbol', 'tests/')}"), where=all_of(starts("f.path", p.path_prefix), lacks("f.path", "tests/")), by={"file_path": "f.path"}, agg={"impl_count": "count(t.symbol)"}),
    ("left", rel("Function t", ("CALLS r", "r.src = t.symbol"), ("Function c", "c.symbol = r.dst"), where=all_of(lacks("t.symbol", "tests/"), "c.file <> t.file"), by={"fp": "t.file"}, agg={"k": "count(*)"},
        fast=rel(f"{_ends_under(p.path_prefix)} t", where=all_of(starts("t.file", p.path_prefix), lacks("t.symbol", "tests/"), "t.dst_file <> t.file"), by={"fp": "t.file"}, agg={"k": "sum(t.n)"})), "x.fp = i.file_path", "x"), alias="i",
    out={"file_path": "i.file_path", "impl_count": "i.impl_count", "external_count": "coalesce(x.k, 0)", "sub_shape": ladder(("i.impl_count <= 2 AND coalesce(x.k, 0) > 0", "leaf-with-deps"), ("i.impl_count = 0", "data-only"), ("coalesce(x.k, 0) = 0", "no-call-or-self-contained"), default="other")}, order=["file_path"], limit=100,
), path_prefix="backend/")
define(CALLS, "function-call-count-between-files", "calls from one file to another", lambda p: counted("CALLS r", ("Function c", "c.symbol = r.src"), ("Function t", "t.symbol = r.dst"), where=all_of(f"c.file = {p.caller_file}", f"t.file = {p.callee_file}", lacks("c.file", "tests/"), lacks("t.symbol", "tests/")), name="call_count"), caller_file="backend/app/core/n1.py", callee_file="backend/app/core/n3.py")


def pattern_calls(name: str, about: str, mine: str, other: str, alias: str, more: str = "1 = 1") -> None:
    define(CALLS, name, about, lambda p: rel("CALLS r", ("Function t", f"t.symbol = r.{mine}"), ("Function o", f"o.symbol = r.{other}"), where=all_of(has("t.symbol", p.pattern), outside_tests("t"), more), out={"target_symbol": "t.symbol", f"{alias}_symbol": "o.symbol", f"{alias}_file": "o.file"}, order=["target_symbol", f"{alias}_file", f"{alias}_symbol"], limit=100), pattern="supply/n4/s")


pattern_calls("function-callers-of-symbol-pattern", "callers of functions that match a text", "dst", "src", "caller")
pattern_calls("function-callees-of-symbol-pattern", "callees of functions that match a text", "src", "dst", "callee")
pattern_calls("module-external-callees-by-pattern", "callees in other files", "src", "dst", "callee", "o.file <> t.file")


def spread(files: str, what: str) -> str:
    return ladder((f"{files} >= 5", f"api-tier-{what}"), (f"{files} >= 2", f"mid-tier-{what}"), default=f"internal-cluster-{what}")


_HUB = rel("callers d", where=all_of(lacks("d.file", "tests/"), lacks("d.k", "tests/"), not_stub("d"), "d.n >= 5"), out={"symbol": "d.k", "file": "d.file", "distinct_callers": "d.n", "caller_files": "d.files"})
HUBS = rel(rel("Function f", ("CALLS r", "r.dst = f.symbol"), ("Function c", "c.symbol = r.src"), where=all_of(outside_tests("f"), not_stub("f")), by=cols("f", "symbol file"), agg={"distinct_callers": "count(DISTINCT c.symbol)", "caller_files": "count(DISTINCT c.file)"}, having="distinct_callers >= 5", fast=_HUB),
           out={**{k: k for k in ("symbol", "file", "distinct_callers", "caller_files")}, "spread_label": spread("caller_files", "hub")})
TYPE_HUBS = rel(rel("Type t", ("USES_TYPE r", "r.dst = t.symbol"), ("Function c", "c.symbol = r.src"), where=all_of(outside_tests("t"), outside_tests("c")), by=cols("t", "symbol kind file"), agg={"distinct_users": "count(DISTINCT c.symbol)", "user_files": "count(DISTINCT c.file)"}, having="distinct_users >= 5"),
                out={**{k: k for k in ("symbol", "kind", "file", "distinct_users", "user_files")}, "spread_label": spread("user_files", "type")})
define(CALLS, "hub-functions-by-caller-breadth", "functions with five callers or more", lambda p: rel(HUBS, order=["-distinct_callers", "-caller_files", "symbol"], limit=25))
define(CALLS, "hub-spread-distribution", "such functions by spread", lambda p: rel(HUBS, by={"spread_label": "spread_label"}, agg={"hub_count": "count(*)"}, order=["-hub_count", "spread_label"]))
define(CALLS, "function-hub-files", "files of functions called from five files or more", lambda p: rel(HUBS, where="caller_files >= 5", out={"file": "file"}, distinct=True, order=["file"], limit=25))
define(CALLS, "hub-types-by-caller-breadth", "types with five users or more", lambda p: rel(TYPE_HUBS, order=["-distinct_users", "-user_files", "symbol"], limit=25))
define(CALLS, "type-spread-distribution", "such types by spread", lambda p: rel(TYPE_HUBS, by={"spread_label": "spread_label"}, agg={"hub_count": "count(*)"}, order=["-hub_count", "spread_label"]))
define(CALLS, "type-hub-files", "files of types used from five files or more", lambda p: rel(TYPE_HUBS, where="user_files >= 5", out={"file": "file"}, distinct=True, order=["file"], limit=25))

# --------------------------------------------------------------- endpoints
define("other-nodes", "endpoint-by-kind", "endpoints by kind", lambda p: rel("Endpoint e", by={"e.kind": "e.kind"}, agg={"count": "count(e.id)"}, order=["-count", "e.kind"]))
define("other-nodes", "endpoint-darkness", "endpoints that touch no entity", lambda p: rel("Endpoint e", ("anti", "ENDPOINT_TOUCHES_ENTITY t", "t.src = e.id"), out=dotted("e", "id kind method path source_file source_line"), order=["e.id"]))

# ---------------------------------------------------------------- contexts
CONTEXT = "context-envelope"


def neighbours(edge: str, mine: str, other: str, table: str, key: str, node: str, *shown: str, kind: str | None = None, edge_fields: tuple[str, ...] = ()):
    """Neighbours of a node over one edge, each once, as records."""
    out = {**({"kind": lit(kind)} if kind else {}), **cols("o", " ".join(shown)), **cols("r", " ".join(edge_fields))}
    return records(rel(f"{edge} r", (f"{table} o", f"o.{key} = r.{other}"), where=f"r.{mine} = {node}", out=out, distinct=True), *out)


EDGES = ("WIKILINK", "INFORMED_BY", "MD_LINK", "DEPENDS_ON", "SUPERSEDES")
DOC_FIELDS = ("id", "title", "summary", "path", "kind")


def doc_links(mine: str, other: str, node: str):
    made = [rel(f"{e} r", ("Doc o", f"o.id = r.{other}"), where=f"r.{mine} = {node}", out={**cols("o", " ".join(DOC_FIELDS)), "line": "r.line", "edge_type": lit(e)}, distinct=True) for e in EDGES]
    made[0].union = made[1:]
    return records(made[0], *DOC_FIELDS, "line", "edge_type")


define(CONTEXT, "node-context-doc", "a document with its tags and links", lambda p: side_by_side(
    rel("Doc d", where=f"d.id = {p.doc}", out=cols("d", "id title summary path kind role")), records(rel("doc_tags t", where=f"t.doc_id = {p.doc}", out={"value": "t.value"}), "value"), doc_links("dst", "src", p.doc), doc_links("src", "dst", p.doc),
    out={**cols("c0", "id title summary path kind role"), "tags": "c1.list", "inbound": "c2.list", "outbound": "c3.list"},
), doc="research-33")
define(CONTEXT, "node-context-entity", "an entity with the documents that cover it", lambda p: side_by_side(
    rel("Entity e", where=f"e.id = {p.entity}", out=cols("e", "id display description")), records(rel("COVERS r", ("Doc o", "o.id = r.src"), where=f"r.dst = {p.entity}", out={**cols("o", " ".join(DOC_FIELDS)), "line": "r.line"}), *DOC_FIELDS, "line"),
    out={**cols("c0", "id display description"), "neighbors": "c1.list"},
), entity="build-economy")
define(CONTEXT, "node-context-function", "a function with its documents, entities, type and calls", lambda p: side_by_side(
    rel("Function f", where=f"f.symbol = {p.symbol}", out=cols("f", "symbol file line doc_comment signature")),
    neighbours("FUNCTION_DEFINED_IN", "src", "dst", "Doc", "id", p.symbol, "id", "title", "summary", "path", kind="doc"),
    neighbours("FUNCTION_BELONGS_TO", "src", "dst", "Entity", "id", p.symbol, "id", "display", "description", kind="entity"),
    neighbours("FUNCTION_MENTIONS", "src", "dst", "Entity", "id", p.symbol, "id", "display", "description", kind="entity", edge_fields=("confidence",)),
    neighbours("METHOD_OF", "src", "dst", "Type", "symbol", p.symbol, "symbol", "doc_comment", kind="type"),
    neighbours("CALLS", "src", "dst", "Function", "symbol", p.symbol, "symbol", "file", "line", "doc_comment"),
    neighbours("CALLS", "dst", "src", "Function", "symbol", p.symbol, "symbol", "file", "line"),
    out={**cols("c0", "symbol file line doc_comment signature"), **{k: f"c{i}.list" for i, k in enumerate(("docs", "entities_belongs", "entities_mentions", "method_of", "calls_out", "calls_in"), 1)}},
), symbol="supply/n4/s77().")
