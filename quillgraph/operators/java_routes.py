"""Web routes of Java resource classes, with the string constants that their paths are made of.

A file is cut into pieces by one pattern (blanks, comments, annotations with their
arguments, code up to the end of a line), so strings and comments hide what is in them
and an annotation may run over lines.  What belongs together is then found by running
sums over a file's pieces: a file is the unit of order, and files spread over the cluster.

A path is literals and names joined by plus signs.  Constants are a table of their own,
from all Java files; constants made of others are worked out in rounds, each an equality
join on names, until none changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import repository
from ..sources.repository import pieces
from .analytics import Tables, extra, held

# Loops are possessive: a long piece needs neither backtracking nor a deep stack.
STRING = r'"(?:[^"\\\n]++|\\.)*+"'
CHAR = r"'(?:[^'\\\n]++|\\.)*+'"
BLOCK = r'"""[\s\S]*?"""'
COMMENT = r"/\*[\s\S]*?(?:\*/|\z)|//[^\n]*+"
#: How deep parentheses may nest in an annotation's arguments.
NESTED = 8


def _arguments(depth: int) -> str:
    inner = f"|{_arguments(depth - 1)}" if depth else ""
    return rf"""\((?:[^()"']++|{BLOCK}|{STRING}|{CHAR}{inner})*+\)"""


PIECE = rf"""\s++|{BLOCK}|{COMMENT}|@(?!interface\b)[\w.]++(?:\s*+{_arguments(NESTED)})?+|(?:{STRING}|{CHAR}|[^"'/\n]++|/(?![/*]))++|[\s\S]"""
TYPE = r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"
CONSTANT = rf"""\b(?:static\s+final|final\s+static)\s+String\s+([A-Za-z_]\w*)\s*=\s*((?:{STRING}|[^";]++)*+);"""
OPERAND = rf'(?:{STRING}|[^"+]++)++'
FOLDABLE = rf"^\s*+(?:{STRING}|[A-Za-z_][\w.]*+)(?:\s*+\+\s*+(?:{STRING}|[A-Za-z_][\w.]*+))*+\s*+$"
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def _operands(expression: Column) -> Column:
    """Array of what plus signs join; ``value =`` before it drops."""
    bare = F.regexp_replace(F.trim(expression), r"^value\s*=(?!=)", "")
    return F.filter(F.transform(F.regexp_extract_all(bare, F.lit(OPERAND), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _literal(operand: Column) -> Column:
    return F.when(operand.rlike(r'(?s)^".*"$'), F.substring(operand, F.lit(2), F.length(operand) - 2))


def constants(java: DataFrame, folded: bool = True) -> DataFrame:
    """(path, type, name, operands) of ``static final String`` fields whose value is a literal or, if folded, literals and names joined by plus signs.

    ``type`` is the file's first type.  Comments and text blocks hold no constants.
    """
    bare = java.where(F.col("text").contains("String")).select("path", F.regexp_replace("text", f"{BLOCK}|{COMMENT}|({STRING}|{CHAR})", "$1").alias("text"))
    each = lambda k: F.regexp_extract_all("text", F.lit(CONSTANT), F.lit(k))
    rows = bare.select("path", F.regexp_extract("text", TYPE, 1).alias("type"), F.explode(F.arrays_zip(each(1).alias("name"), each(2).alias("value"))).alias("c"))
    rows = rows.select("path", "type", F.col("c.name").alias("name"), F.col("c.value").alias("value"))
    return rows.where(F.col("value").rlike(FOLDABLE if folded else rf"^\s*+{STRING}\s*+$")).select("path", "type", "name", _operands(F.col("value")).alias("operands"))


def _lookups(path: Column, operand: Column) -> Column:
    """Where a name is looked up, in order: the file with and without the type, then all files alike.  None for a literal."""
    name, typed = F.regexp_extract(operand, r"([^.]*)$", 1), F.regexp_extract(operand, r"([^.]+\.[^.]*)$", 1)
    places = F.array(*[F.struct(F.lit(k).alias("rank"), scope.alias("scope"), key.alias("key")) for k, (scope, key) in enumerate([(path, typed), (path, name), (F.lit(""), typed), (F.lit(""), name)])])
    return F.when(_literal(operand).isNull(), F.filter(places, lambda p: p["key"] != ""))


def _known(defined: DataFrame) -> DataFrame:
    """(scope, key, value): names with one value in a file or, scope '', in all files; of (path, type, name, value), where a null value is not known yet."""
    typed = F.when(F.col("type") != "", F.concat_ws(".", "type", "name"))
    places = F.array(*[F.struct(scope.alias("scope"), key.alias("key")) for scope in (F.col("path"), F.lit("")) for key in (F.col("name"), typed)])
    rows = defined.select(F.explode(F.filter(places, lambda p: p["key"].isNotNull())).alias("p"), "value")
    found = rows.groupBy("p.scope", "p.key").agg(F.min("value").alias("value"), F.max("value").alias("other"), F.count_if(F.col("value").isNull()).alias("open"))
    return found.where("open = 0 AND value = other").select("scope", "key", "value")


def _resolved(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, open): the operands of each row put together (path is among the keys), and how many of them no constant gives; such a name stands in braces."""
    parts = rows.select(*keys, F.posexplode("operands").alias("k", "operand")).select(*keys, "k", "operand", F.explode_outer(_lookups(F.col("path"), F.col("operand"))).alias("p"))
    looked = parts.join(known.withColumnRenamed("value", "_found"), (F.col("p.scope") == F.col("scope")) & (F.col("p.key") == F.col("key")), "left")
    one = looked.groupBy(*keys, "k", "operand").agg(F.min_by("_found", F.when(F.col("_found").isNotNull(), F.col("p.rank"))).alias("_found"))
    given = F.coalesce(_literal(F.col("operand")), F.col("_found"))
    shown = F.coalesce(given, F.concat(F.lit("{"), F.regexp_extract("operand", r"([^.]*)$", 1), F.lit("}")))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("k"), shown.alias("s")))), lambda x: x["s"]), "")
    return one.groupBy(*keys).agg(put.alias("value"), F.count_if(given.isNull()).alias("open"))


def known_constants(java: DataFrame, folded: bool = True) -> DataFrame:
    """(scope, key, value) of all constants: by name and by Type.name, within a file and (scope '') in all.

    A name with two values has none.  Rounds end when no further constant is
    worked out; those left, as in a cycle, count as not seen.  A chain of n
    constants takes n rounds.
    """
    literal = F.transform("operands", _literal)
    done = F.forall(literal, lambda x: x.isNotNull())
    # equal definitions of one file are one
    rows = held(constants(java, folded).distinct().withColumn("value", F.when(done, F.array_join(literal, ""))))
    while folded:
        found = _resolved(rows.where("value IS NULL"), _known(rows), ["path", "type", "name", "operands"]).where("open = 0").select("path", "type", "name", "operands", F.col("value").alias("_new"))
        found = held(found)
        if found.isEmpty():
            break
        rows = held(rows.join(found, ["path", "type", "name", "operands"], "left").withColumn("value", F.coalesce("value", "_new")).drop("_new"))
    return _known(rows.where("value IS NOT NULL"))


def statements(java: DataFrame) -> DataFrame:
    """(path, n, code, at, verb): type declarations and what has a verb, with the arguments of the last path annotation before it and the verb (name, line).

    A statement is code and all annotations since the code before it; comments
    and blanks part nothing.
    """
    rows = pieces(java.where(F.col("text").contains(".ws.rs")), PIECE).where(~F.col("piece").rlike(r'\A(?:\s|//|/\*|""")'))
    note = F.col("piece").rlike(r"\A@(?!interface\b)")
    n = F.sum((~note).cast("int")).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("n", F.coalesce(n, F.lit(0))).withColumn("note", F.when(note, F.regexp_extract("piece", r"^@(?:\w+\.)*+(\w+)", 1)))
    arguments = F.regexp_extract("piece", r"(?s)^@[\w.]+\s*\((.*)\)$", 1)
    grouped = rows.groupBy("path", "n").agg(
        F.max(F.when(F.col("note").isNull(), F.col("piece"))).alias("code"),
        F.max(F.when(F.col("note") == "Path", F.struct("pos", arguments.alias("arguments"))))["arguments"].alias("at"),
        F.max(F.when(F.col("note").isin(*VERBS), F.struct("pos", F.col("note").alias("name"), "line"))).alias("verb"),
    )
    is_type = F.col("code").rlike(TYPE)
    return grouped.where("code IS NOT NULL").withColumn("is_type", is_type).where("is_type OR verb IS NOT NULL")


def routes(files: DataFrame, folded: bool = True) -> DataFrame:
    """(id, kind, method, path, handler, source_file, source_line) of the Java files among (path, text), paths being unique.

    The path annotation of a file's first type stands before those of its
    methods; a type within it shares it.  A name that no constant gives, or that
    has two values, stands in braces.  ``folded=False`` takes literal constants
    alone, as the tool that this follows does.  Files without text have no
    routes; other columns are left out.
    """
    java = files.where(F.col("path").endswith(".java")).select("path", F.coalesce("text", F.lit("")).alias("text"))
    every = Window.partitionBy("path")
    rows = statements(java).withColumn("first", F.min(F.when(F.col("is_type"), F.struct("n", "at"))).over(every)).where("verb IS NOT NULL AND NOT is_type")
    prefix = F.when(F.col("first.n") < F.col("n"), F.col("first.at"))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.coalesce(c, F.lit("")).alias("text")) for k, c in enumerate((prefix, F.col("at")))])
    rows = rows.withColumn("sides", sides)
    wanted = rows.select("path", "n", F.explode("sides").alias("s")).select("path", "n", "s.side", _operands(F.col("s.text")).alias("operands"))
    put = _resolved(wanted, known_constants(java, folded), ["path", "n", "side"])
    slashless = F.regexp_replace("value", "^/+|/+$", "")
    both = put.groupBy("path", "n").agg(F.max(F.when(F.col("side") == 0, slashless)).alias("a"), F.max(F.when(F.col("side") == 1, slashless)).alias("b"))
    route = F.concat(F.lit("/"), F.array_join(F.filter(F.array("a", "b"), lambda x: x.isNotNull() & (x != "")), "/"))
    head = F.regexp_replace(F.regexp_extract("code", r"^([^({=;:]*)", 1), r"<[^<]*>\s*$", "")
    found = rows.join(both, ["path", "n"], "left").select("path", F.col("verb.name").alias("method"), route.alias("route"), F.nullif(F.regexp_extract(head, r"([A-Za-z_]\w*)\s*$", 1), F.lit("")).alias("handler"), F.col("verb.line").alias("line"))
    return found.select(F.concat_ws(":", F.lit("jaxrs"), "method", "route").alias("id"), F.lit("jaxrs").alias("kind"), "method", F.col("route").alias("path"), "handler", F.col("path").alias("source_file"), F.col("line").alias("source_line"))


def endpoints(files: DataFrame, folded: bool = True) -> DataFrame:
    """Routes of all languages that have a reader: Python and script files line by line, Java with its constants."""
    return repository.endpoints(files).unionByName(routes(files, folded))


# Java sources that the parts and their brands stand for: a class of constants for each
# brand, one of them made of another, and a resource class for each part.  ``ROOT`` alone
# has as many values as there are brands.
SOURCES = """
    SELECT concat('src/paths/', b, '.java') AS path, concat('package paths;\npublic class ', b, ' {{\n  // static final String ITEMS = "/no";\n  public static final String ITEMS = ', b, '.ROOT + "/items";\n  public static final String ROOT = "/', lower(b), '";\n}}\n') AS text
    FROM (SELECT DISTINCT replace(p_brand, '#', '') AS b FROM {part} WHERE p_brand IS NOT NULL)
    UNION ALL
    SELECT concat('src/parts/P', p_partkey, 'Resource.java'), concat('package parts;\nimport javax.ws.rs.*;\n/* @Path("/no")\n@GET */\n@Path(paths.', b, '.ITEMS + "/', p_partkey, '/")\npublic class P', p_partkey, 'Resource {{\n  private static final String SIZE = "size-', p_size, '";\n',
        '  @GET\n  public Part read(@PathParam("id") String id) {{\n    return find(") // {{");\n  }}\n',
        '  @javax.ws.rs.PUT\n  @Path(value = SIZE) // the size\n  @Operation(description = "a) b",\n    tags = {{"x"}})\n  public Map<String, Part> resize(\n    @PathParam("n") int n) {{}}\n',
        CASE WHEN p_size > 25 THEN '  @Path(ROOT + "/all") @DELETE void drop() {{}}\n' ELSE '  @POST @Path("/new/")\n  Part make() {{}}\n' END, '}}\n')
    FROM (SELECT *, replace(p_brand, '#', '') AS b FROM {part} WHERE p_brand IS NOT NULL AND p_size IS NOT NULL)"""


@extra(
    "derive_jaxrs_endpoints",
    """WITH r AS (SELECT p_partkey AS k, p_size, '/' || lower(replace(p_brand, '#', '')) || '/items/' || p_partkey AS base FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL),
    e AS (SELECT 'GET' AS method, base AS path, 'read' AS handler, k, 8 AS source_line FROM r
        UNION ALL SELECT 'PUT', base || '/size-' || p_size, 'resize', k, 12 FROM r
        UNION ALL SELECT 'DELETE', base || '/{ROOT}/all', 'drop', k, 18 FROM r WHERE p_size > 25
        UNION ALL SELECT 'POST', base || '/new', 'make', k, 18 FROM r WHERE p_size <= 25)
    SELECT 'jaxrs:' || method || ':' || path AS id, 'jaxrs' AS kind, method, path, handler, 'src/parts/P' || k || 'Resource.java' AS source_file, source_line FROM e""",
)
def derive_jaxrs_endpoints(t: Tables) -> DataFrame:
    """Routes of the Java sources that all parts and brands stand for."""
    part = t["part"]
    return routes(part.sparkSession.sql(SOURCES, part=part))
