"""Routes of Java classes: pieces, constants over files, and a plain reading of the same sources."""

from __future__ import annotations

from quillgraph.operators import java_routes

PATHS = """package a;
public final class Paths {
  public static final String BASE = "/api";
  static final String V2 = Paths.BASE + "/v2"; final static String DEEP = V2 + "/deep" + Other.TAIL;
  // static final String GONE = "/gone";
  static final String TWICE = "/one";
  static final String LOOP = Other.LOOP + "/x";
  static final String QUOTED = "a\\"b;";
}
"""
OTHER = """class Other { static final String TAIL = "/tail"; static final String TWICE = "/two"; static final String LOOP = Paths.LOOP + "/y"; static final String MADE = make("/z"); }
"""
ROUTES = """import jakarta.ws.rs.GET;
/** @Path("/doc")
 * @GET */
@Path(a.Paths.DEEP)
@Doc(\"\"\"
  text ) with ( a paren @GET
\"\"\")
public class Users {
  static final String BASE = "/mine";
  @GET
  public List<Map<String, User>> all() { return x; }
  @POST @Path(BASE + TWICE) // trailing
  @Api(value = "x)", more = {
    @One("("), @Two(')') })
  User make(@PathParam("id") long id);

  @PUT
  /* between */
  @Path(value = Paths.LOOP)
  User put() {}
  @Path("/sub") Sub locator() {}
  void plain() {}
  static class Inner {
    @jakarta.ws.rs.HEAD @Path("/{id: [a-z]+}/") void head() {}
    @DELETE @Path(Other.MADE + Paths.QUOTED) void drop() {}
  }
  @OPTIONS
}
"""


def _routes(spark, files, **kw):
    return sorted((r.method, r.path, r.handler, r.source_line) for r in java_routes.routes(spark.createDataFrame(files, "path string, text string"), **kw).collect())


def test_routes(spark):
    files = [("a/Paths.java", PATHS), ("a/Other.java", OTHER), ("a/Users.java", ROUTES), ("a/Plain.java", ROUTES.replace("ws.rs", "none")), ("a/x.py", ROUTES), ("a/Null.java", None), ("a/Empty.java", "")]
    base = "/api/v2/deep/tail"
    want = [("DELETE", base + '/{MADE}a\\"b;', "drop", 25), ("GET", base, "all", 10), ("HEAD", base + "/{id: [a-z]+}", "head", 24), ("POST", base + "/mine{TWICE}", "make", 12), ("PUT", base + "/{LOOP}", "put", 17)]
    # the annotation before a closing brace names nothing
    assert _routes(spark, files) == sorted([*want, ("OPTIONS", base, None, 27)], key=lambda x: x[:2])
    plain = {(m, p) for m, p, _, _ in _routes(spark, files, folded=False)}
    assert ("GET", "/{DEEP}") in plain and ("POST", "/{DEEP}/mine{TWICE}") in plain
    assert _routes(spark, files[3:]) == [] and _routes(spark, []) == []


def test_long_and_odd_texts(spark):
    long = "import javax.ws.rs.*;\n" + "/*" + "*" * 300_000 + "*/\n@Path(" + " + ".join(f'"/{k}"' for k in range(2000)) + ")\nclass A {\n" + "  int x = 1;\n" * 20_000 + '  @GET @Path("' + "y" * 200_000 + '") void go() {}\n}\n'
    found = _routes(spark, [("A.java", long), ("B.java", 'x.ws.rs "open\n@GET void a() {} /* open'), ("C.java", "x.ws.rs @" + "(" * 100_000)])
    assert [(m, len(p), h, n) for m, p, h, n in found] == [("GET", 1, "a", 2), ("GET", sum(len(f"/{k}") for k in range(2000)) + 200_001, "go", 20_005)]


def test_chain_of_constants(spark):
    chain = "class C { static final String C0 = \"/0\"; " + " ".join(f'static final String C{k} = C{k - 1} + "/{k}";' for k in range(1, 5)) + " }"
    got = java_routes.known_constants(spark.createDataFrame([("C.java", chain), ("D.java", 'class D { static final String C0 = "/other"; static final String D = C.C4; }')], "path string, text string"))
    rows = {(r.scope, r.key): r.value for r in got.collect()}
    assert rows["", "C.C4"] == "/0/1/2/3/4" == rows["", "D"] and rows["D.java", "C0"] == "/other" and ("", "C0") not in rows
