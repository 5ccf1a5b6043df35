"""Sections and links of Markdown and AsciiDoc against a plain reading, made front matter, markers, skipped folders."""

from __future__ import annotations

import random
import re

from quillgraph.operators import java_routes, terms
from quillgraph.sources import code_index, ontology, repository


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def plain_sections(path, text):
    """One line after another."""
    adoc = path.endswith(".adoc")
    marks = ("```", "~~~") + (("----", "....") if adoc else ())
    out, seen, fence = [], {}, None
    rows = text.split("\n")
    for k, row in enumerate(rows[:-1] if rows[-1] == "" else rows):
        mark = next((m for m in marks if row.lstrip(" \t").startswith(m)), None)
        head = None
        if fence is None and mark is None:
            head = re.fullmatch(r"(={1,6}) (.*)", row) if adoc else re.fullmatch(r" {0,3}(#{1,6})(?:[ \t](.*))?", row)
        fence = mark if fence is None else None if mark == fence else fence
        title = (head.group(2) or "").strip() if head else ""
        if head and not adoc:
            title = re.sub(r"[ \t]*#*[ \t]*$", "", title)
        if title:
            slug = "".join("-" if c == " " else c for c in title.lower() if c == " " or c.isalnum() or c in "-_")
            n = seen.get(slug, 0)
            seen[slug] = n + 1
            out.append([title, f"{slug}-{n}" if n else slug, len(head.group(1)), k + 1, ""])
        elif out:
            out[-1][4] += row + "\n"
    return [(*x[:4], x[4].strip()) for x in out]


LINES = ["# One", "## Two ##", "   ### C# é_x", "    # far", "#no", "# ", "= One", "== Tŵo thing", "=no", "======= seven", "```", "~~~", "----", "....", "  ```md", "text [[a]]", "", "| x", "-----"]


def test_sections_of_random_files(spark):
    rng = random.Random(7)
    files = [(f"f{k}.{'adoc' if k % 2 else 'md'}", "\n".join(rng.choice(LINES) for _ in range(rng.randrange(25)))) for k in range(300)]
    got = {}
    for r in repository.sections(table(spark, [*files, ("null.md", None), ("empty.adoc", "")])).collect():
        got.setdefault(r.path, []).append((r.heading, r.anchor, r.level, r.line, r.text))
    for path, text in files:
        assert sorted(got.get(path, []), key=lambda x: x[3]) == plain_sections(path, text), text
    assert not {"null.md", "empty.adoc"} & set(got)


def test_long_blocks(spark):
    text = "# A\n```\n" + "# no `x` [[y]] " + "z" * 200_000 + "\n" + "# no\n" * 100_000 + "```\n# B\r\nend\r\n- " + "`" * 5 + "[[w]]" + "x`" * 20_000
    assert [(r.heading, r.line, len(r.text)) for r in repository.sections(table(spark, [("a.md", text)])).orderBy("line").collect()] == [("A", 1, 4 + 15 + 200_000 + 1 + 500_000 + 3), ("B", 100_005, 4 + 12 + 40_000)]
    assert [(r.kind, r.target, r.line) for r in repository.links(table(spark, [("a.md", text)])).collect()] == [("wikilink", "w", 100_007)]


def test_links(spark):
    md = """[[one#part|label]] and [[two-
words]] `[[no]]` ``a ` [[no]]`` ![i](no.png)
[x](docs/three.md#s "title") [u](https://no.example) [h](#no) [`./label.md`](four.adoc)
`src/a.py` `src/b.rs:42` `./run` `../up/x` `a.py` `/abs/x.md` `~/x/y.md` `src/*.py` `cd x/y.md` `src/x.unknown` `c/Main.JAVA#L3` `https://no.example/x.md`
~~~
[[no]] ```
[no](no.md)
~~~
    xref:no.adoc[x]
open ` tick

[[five]] `
"""
    adoc = "xref:a.adoc#p[A] xref:mod:b.adoc[] xref:https://x[]\n----\nxref:no.adoc[]\n~~~\n----\n[[w]]\n....\n`src/no.py`\n"
    got = {(r.path, r.kind, r.target, r.line) for r in repository.links(table(spark, [("m.md", md), ("n.adoc", adoc), ("e.md", ""), ("z.md", None)])).collect()}
    assert {x[1:] for x in got if x[0] == "m.md"} == {
        ("wikilink", "one", 1), ("wikilink", "two-words", 1), ("md_link", "docs/three.md", 3), ("md_link", "four.adoc", 3), ("inline_path", "src/a.py", 4), ("inline_path", "src/b.rs:42", 4),
        ("inline_path", "./run", 4), ("inline_path", "../up/x", 4), ("inline_path", "c/Main.JAVA#L3", 4), ("wikilink", "five", 12),
    }
    assert {x[1:] for x in got if x[0] == "n.adoc"} == {("xref", "a.adoc", 1), ("wikilink", "w", 6)}


def test_made_front_matter(spark):
    files = [("docs/Guide/index.adoc", "= The guide\n:toc:\n\n[abstract]\nFirst line\n  goes on.\n\nSecond."), ("docs/b.md", "# B\n\n" + "é" * 400), ("docs/c.md", ""), ("docs/d.md", "---\nid: d\nrole: x\n---\nbody")]
    rows = {r.path: r for r in repository.documents(table(spark, files), by_path=True).collect()}
    a, b, c, d = (rows[p] for p, _ in files)
    assert (a.id, a.title, a.summary, a.role, a.status) == ("docs-guide-index", "The guide", "First line goes on.", "doc", "stable")
    assert (b.id, b.title, b.summary) == ("docs-b", "B", "é" * 300 + "…")
    assert (c.id, c.title, c.summary, c.role) == ("docs-c", "c", None, "doc")
    assert (d.id, d.role, d.summary, d.status) == ("d", "x", None, None)


def test_findings(spark):
    rows = [("a.rs", "// TODO fix: this — FIXME later\nlet x = 1; // TODO no\n  /// HACK:x\n//XTODO no\n// FIXME\n"), ("b.py", "# XXX: " + "é" * 150 + "\n// TODO no\n#todo no"), ("c.md", "# TODO no"), ("d.java", None)]
    got = sorted((r.id, r.kind, r.line, r.message, r.severity) for r in repository.findings(table(spark, rows)).collect())
    assert got == [("a.rs:1:todo", "todo", 1, "fix: this — FIXME later", "info"), ("a.rs:3:hack", "hack", 3, "x", "warning"), ("a.rs:5:fixme", "fixme", 5, "", "warning"), ("b.py:1:xxx", "xxx", 1, "é" * 100 + "…", "info")]


def test_authored(spark):
    paths = ["a.py", "x/node_modules/b.js", "target/c.rs", "x/target", "app/build.gradle", "app/build/d.java", "app/src/build/e.java", "lib/build/f.go", "build/g.java", "app/build/sub/build/h.java"]
    keep = ["a.py", "app/build.gradle", "app/src/build/e.java", "build/g.java", "lib/build/f.go", "x/target"]
    df = table(spark, [(p, "t") for p in paths] + [("a.py", "again")])
    assert sorted(r.path for r in repository.authored(df).collect()) == ["a.py", *keep]
    root = repository.authored(table(spark, [("build.gradle.kts", ""), ("build/x", ""), ("y", "")]))
    assert sorted(r.path for r in root.collect()) == ["build.gradle.kts", "y"]


def test_innermost_keeps_repeated_rows(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 300), ("f", "inner", 100, 200)], "file string, symbol string, begin int, `end` int")
    got = repository.innermost(spark.createDataFrame([("f", 150, "a")] * 3 + [("f", 150, "b"), ("g", 1, "c")], "file string, line int, tag string"), spans)
    assert sorted((r.tag, r.enclosing) for r in got.collect()) == [("a", "inner")] * 3 + [("b", "inner")]


def test_ontology(spark):
    order = """role: ontology-entity
value_id: order
display: "The \\"Order\\""
description: |
  it's one
  of two
status: stable
ontology_version: 4
bounded_contexts: [pricing, sync]
source_modules: ["backend/order/**/*.py", "backend/q.py"]
code_terms: [order-line]
code_veto:
  - order-by
relates_to:
  - target: pricing-rule
    type: depends_on
  - type: "feeds_into"
    target: 'shipment' # sent
  - target: nothing
attributes:
  - key: size
    value: 3
  - value: lost
entity_class: noun"""
    files = [
        ("b.md", f"---\n{order}\n---\nbody"), ("a.md", "---\nrole: ontology-entity\nvalue_id: item\nattributes: {open: true, kind: 'x y'}\n---\n"), ("c.md", "---\nrole: ontology-entity\nvalue_id: item\ndisplay: Later\n---\n"),
        ("d.md", "---\ntype: ontology-value\naxis_id: role\nvalue_id: adr\nallowed_lifecycle: [current]\nfilename_pattern: '^adr-\\d+'\n---\n"), ("e.md", "---\nrole: ontology-value\naxis_id: colour\nvalue_id: red\n---\n"),
        ("f.md", "---\nrole: ontology-migration\nontology_version: 7\n---\n"), ("g.md", "---\nrole: ontology-entity\nvalue_id: ~\n---\n"), ("h.md", None), ("i.md", ""), ("j.md", "---\nrole: doc\nontology_version: 9\n---\n"),
    ]
    df = table(spark, files)
    found = ontology.entities(df)
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {"order", "item"} and rows["item"].display == "item" and rows["item"].attributes == ["open=true", "kind=x y"]
    r = rows["order"]
    assert (r.display, r.description, r.status, r.entity_class, r.bounded_contexts, r.source_modules) == ('The "Order"', "it's one\nof two", "stable", "noun", ["pricing", "sync"], ["backend/order/**/*.py", "backend/q.py"])
    assert (r.code_terms, r.code_veto, r.synonyms, r.attributes) == (["order-line"], ["order-by"], [], ["size=3"])
    assert sorted(tuple(x) for x in ontology.relations(found).collect()) == [("order", "pricing-rule", "depends_on"), ("order", "shipment", "feeds_into")]
    assert [(v.axis, v.id, v.allowed_lifecycle, v.filename_pattern, v.requires_axes) for v in ontology.values(df).collect()] == [("role", "adr", ["current"], "^adr-\\d+", [])]
    assert ontology.version(df).first().version == 7 and ontology.version(df.limit(0)).first().version == 0
    # what was read is what mentions are found by
    symbols = spark.createDataFrame([("a/orders().", ""), ("a/order_line().", ""), ("a/order_by().", ""), ("b/Item#", "")], "symbol string, doc_comment string")
    assert sorted((m.src, m.dst) for m in terms.entity_mentions(symbols, found).collect()) == [("a/order_line().", "order"), ("b/Item#", "item")]


def test_script_routes_and_java(spark):
    js = "router.get('/a', auth, list);\nreturn api.all(\"/b\", true);\n  app.post(`/c`, (req) => {\nx.app.get('/no', f);\nv2.delete('/d', a.b)\n"
    got = java_routes.endpoints(table(spark, [("s.ts", js), ("A.java", 'import javax.ws.rs.*;\n@Path("a")\nclass A {\n@GET int x() {}\n}')]))
    assert sorted((r.kind, r.method, r.path, r.handler) for r in got.collect()) == [("express", "ALL", "/b", None), ("express", "DELETE", "/d", None), ("express", "GET", "/a", "list"), ("express", "POST", "/c", None), ("jaxrs", "GET", "/a", "x")]


def test_imports_by_lines(spark):
    defs = spark.createDataFrame([("b.py", "b/f()."), ("c.py", "c/g()."), ("a.py", "a/h().")], "file string, symbol string")
    occ = spark.createDataFrame([("a.py", "b/f().", 1, "reference"), ("a.py", "b/f().", 1, "reference"), ("a.py", "c/g().", 3, "reference"), ("a.py", "a/h().", 2, "reference"), ("c.py", "b/f().", 5, "import"), ("c.py", "a/h().", 1, "reference")], "file string, symbol string, line int, role string")
    at = code_index.import_lines(table(spark, [("a.py", "from b import f\n  import a\nimportant = g\n"), ("c.py", "import a"), ("d.py", None)]))
    assert sorted(tuple(r) for r in code_index.imports(defs, occ, at).collect()) == [("a.py", "b.py", 1), ("c.py", "b.py", 1)]
    assert [tuple(r) for r in code_index.imports(defs, occ).collect()] == [("c.py", "b.py", 1)]
