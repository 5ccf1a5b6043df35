"""Readers of a repository's files, as DataFrame operations over text.

Files come as (path, text) from :func:`read_files` or any table; everything
else is split, regular expressions and windows over a file's lines, so one file
is the unit of order and files spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import heading_slug

# Languages by file ending.
LANGUAGES = {"py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "cs": "csharp", "dart": "dart", "go": "go", "pyx": "cython", "pxd": "cython", "md": "markdown", "adoc": "asciidoc"}
LINKS = ("depends-on", "informed-by", "supersedes")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text) of the files under a folder, paths relative to it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^.*?{base.lstrip('/')}", "")
    return df.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))


# Folders of build output and caches.
SKIPPED = ("target", ".git", ".obsidian", "node_modules", "bin", "obj", ".dart_tool", ".nuxt", ".output", ".next", "dist", "coverage")


def authored(files: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """The files (path, ...) outside skipped folders and outside a ``build`` folder beside a Gradle script.

    Folders above the root do not count; rows keep all their columns, repeated ones stay.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    kept = files.where(~F.arrays_overlap(folders, F.lit(list(skipped)))) if skipped else files
    scripts = kept.where(F.col("path").rlike(r"(?:^|/)build\.gradle(?:\.kts)?$")).select(F.regexp_replace("path", r"[^/]*$", "").alias("root")).distinct()
    # what stands before each folder of that name: an equality joins it with the scripts' folders
    before = F.transform(F.filter(F.sequence(F.lit(1), F.size(folders)), lambda k: F.element_at(folders, k) == "build"), lambda k: F.array_join(F.transform(F.slice(folders, F.lit(1), k - 1), lambda x: F.concat(x, F.lit("/"))), ""))
    built = kept.where(F.array_contains(folders, "build")).select("path", F.explode(before).alias("root")).join(scripts, "root").select("path").distinct()
    return kept.join(built, "path", "left_anti").select(*files.columns)


def file_table(files: DataFrame) -> DataFrame:
    """(path, language, loc): lines are line ends."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return files.select("path", F.try_element_at(names, ending).alias("language"), F.regexp_count("text", F.lit("\n")).alias("loc"))


def modules(files: DataFrame, markers: tuple[str, ...] = ("Cargo.toml", "package.json", "pyproject.toml", "__init__.py")) -> DataFrame:
    """(id, name): folders that hold a marker file."""
    at = F.regexp_extract("path", r"^(.*)/([^/]+)$", 1)
    return files.where(F.regexp_extract("path", r"([^/]+)$", 1).isin(*markers)).select(at.alias("id")).where("id <> ''").distinct().withColumn("name", F.regexp_extract("id", r"([^/]+)$", 1))


def in_module(files: DataFrame, mods: DataFrame) -> DataFrame:
    """(src, dst): each file's closest module; its ancestors are exploded, so an equality joins them."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = files.where(F.col("path").contains("/")).select("path", F.explode(ancestors).alias("id"))
    return up.join(mods.select("id"), "id").groupBy(F.col("path").alias("src")).agg(F.max_by("id", F.length("id")).alias("dst"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text")


def pieces(files: DataFrame, pattern: str, adoc: str | None = None) -> DataFrame:
    """(path, pos, line, piece): what a pattern that covers any text cuts a file into, with the line that each piece begins at; .adoc files may have a pattern of their own."""
    cut_by = lambda x: F.regexp_extract_all("text", F.lit(x), F.lit(0))
    each = F.when(is_adoc(F.col("path")), cut_by(adoc)).otherwise(cut_by(pattern)) if adoc else cut_by(pattern)
    cut = files.select("path", F.posexplode(each).alias("pos", "piece"))
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    before = F.sum(breaks).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return cut.select("path", "pos", (F.coalesce(before, F.lit(0)) + 1).cast("int").alias("line"), "piece")


def front_matter(files: DataFrame) -> DataFrame:
    """(path, front, body): the lines between the first two rules of a file, '' if there are none; a byte order mark is skipped."""
    text = F.regexp_replace("text", "^﻿", "")
    front = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    body = F.when(front != "", F.regexp_replace(text, r"^---\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|$)", "")).otherwise(text)
    return files.select("path", front.alias("front"), body.alias("body"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def scalar(key: str) -> Column:
    """A key's text in ``front``: plain, quoted or a block (``>`` joins its lines, ``|`` keeps them); null if there is none."""
    row = F.regexp_extract("front", rf"(?md)^{key}:[ \t]+([^\n]*?)[ \t\r]*$", 1)
    block = F.regexp_extract("front", rf"(?md)^{key}:[ \t]+[>|][+-]?[ \t\r]*\n((?:(?:[ \t]+[^\n]*+)?(?:\n|\z))+?)(?=\S|\z)", 1)
    kept = F.regexp_replace(F.regexp_replace(block, r"(?md)^[ \t]+|\r$", ""), r"\A\s+|\s+\z", "")

    def value(r: Column) -> Column:
        double = F.replace(F.regexp_extract(r, r'^"((?:[^"\\]++|\\.)*+)"', 1), F.lit('\\"'), F.lit('"'))
        single = F.replace(F.regexp_extract(r, r"^'((?:[^']++|'')*+)'", 1), F.lit("''"), F.lit("'"))
        plain = F.regexp_replace(r, r"(?:^|\s)#.*$|\s+$|^(?:~|null)\s*(?:#.*)?$", "")
        return F.when(r.startswith('"'), double).when(r.startswith("'"), single).when(r.rlike(r"^>[+-]?$"), F.regexp_replace(kept, r"\s*\n\s*", " ")).when(r.rlike(r"^\|[+-]?$"), kept).otherwise(plain)

    return F.get(F.filter(F.array(bound(row, value)), lambda x: x != ""), F.lit(0))


def listed(key: str) -> Column:
    """A key's list in ``front``: in brackets, one item a line, or a single text."""
    inline = F.regexp_extract("front", rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    block = F.regexp_extract("front", rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1)
    given = F.struct(inline.alias("inline"), block.alias("block"), F.coalesce(scalar(key), F.lit("")).alias("one"))

    def items(g: Column) -> Column:
        each = F.when(g["inline"] != "", F.split(g["inline"], ",")).when(g["block"] != "", F.split(F.regexp_replace(g["block"], r"(?m)^[ \t]*-[ \t]*", ""), "\n"))
        return each.when((g["one"] != "") & ~g["one"].startswith("["), F.array(g["one"])).otherwise(F.array())

    return F.filter(F.transform(bound(given, items), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def documents(files: DataFrame, by_path: bool = False) -> DataFrame:
    """(path, id, title, summary, ..., tags, covers, body) of markdown and AsciiDoc files, from their front matter.

    A byte order mark is skipped.  A file without front matter gets the role doc, the
    status stable, its first paragraph (300 characters at most) as summary, its title
    from its first heading and its id from its name or, ``by_path``, from its whole path
    (for a root with settings of its own, where names such as index repeat).
    """
    base = front_matter(files)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    heading = F.when(is_adoc(F.col("path")), F.regexp_extract("body", r"(?md)^= +(\S[^\n]*?)\s*$", 1)).otherwise(F.regexp_extract("body", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1))
    made = F.col("front") == ""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("path", r"\.[^./]+$", "")), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-|-$", "")
    # lines that are neither empty nor of a heading, an attribute, a fence, a list of attributes or a remark
    prose = r"[ \t]*+(?!#|=|:|```|----|\[|<!--)\S[^\n]*+"
    first = F.trim(F.regexp_replace(F.regexp_extract("body", rf"(?md)^{prose}(?:\n{prose})*+", 0), r"\s*\n\s*", " "))
    summary = F.when(F.length(first) > 300, F.concat(F.substring(first, 1, 300), F.lit("…"))).otherwise(F.nullif(first, F.lit("")))
    given = {"summary": summary, "role": F.lit("doc"), "status": F.lit("stable")}
    return base.select(
        "path",
        F.coalesce(scalar("id"), slug if by_path else name).alias("id"),
        F.coalesce(scalar("title"), F.when(heading != "", heading), name).alias("title"),
        *[(F.when(made, given[k]).otherwise(scalar(k)) if k in given else scalar(k)).alias(k) for k in ("summary", "role", "kind", "lifecycle", "status", "updated", "phase")],
        scalar("bounded_context").alias("bounded_context"),
        listed("tags").alias("tags"),
        listed("covers").alias("covers"),
        *[listed(k).alias(k.replace("-", "_")) for k in LINKS],
        "body",
    )


# A fence is closed by a line that begins with the same marker, or by the end of the text.
# Loops are possessive: a long block needs no deep stack.
def _fenced(markers: str) -> str:
    return rf"(?md)^[ \t]*+({markers})[^\n]*+(?:\n(?![ \t]*+\1)[^\n]*+)*+(?:\n[ \t]*+\1[^\n]*+)?+\n?+"


#: A file in blocks of code and single lines; AsciiDoc has two more markers.
MARKDOWN_PIECE = rf"{_fenced('```|~~~')}|[^\n]*+\n|[^\n]++"
ADOC_PIECE = rf"{_fenced(r'```|~~~|----|\.\.\.\.')}|[^\n]*+\n|[^\n]++"


def is_adoc(path: Column) -> Column:
    return path.endswith(".adoc")


def sections(files: DataFrame) -> DataFrame:
    """(path, heading, anchor, level, line, text): headings outside code, with the text up to the next one.

    Markdown has ``#`` to ``######`` behind three blanks at most, AsciiDoc (by the
    file's ending) ``=`` to ``======`` at the start of a line.  A repeated anchor gets
    -1, -2 and so on.  Text before the first heading belongs to none; null and empty
    texts have no sections.  Paths are unique.
    """
    adoc = is_adoc(F.col("path"))
    rows = pieces(files, MARKDOWN_PIECE, ADOC_PIECE)
    row = F.regexp_replace("piece", r"\r?\n\z", "")
    found = F.when(adoc, F.regexp_extract(row, r"(?s)\A(={1,6}) (.*)\z", 1)).otherwise(F.regexp_extract(row, r"(?s)\A {0,3}(#{1,6})(?:[ \t].*)?\z", 1))
    title = F.when(adoc, F.regexp_extract(row, r"(?s)\A={1,6} (.*)\z", 1)).otherwise(F.regexp_replace(F.regexp_extract(row, r"(?s)\A {0,3}#{1,6}(?:[ \t](.*))?\z", 1), r"[ \t]*#*[ \t]*\z", ""))
    title = F.regexp_replace(title, r"\A\s+|\s+\z", "")
    rows = rows.withColumn("head", F.when(found != "", F.when(title != "", F.struct("pos", title.alias("heading"), F.length(found).alias("level"), "line"))))
    # a running count of headings: no join, and one exchange of a file's pieces
    rows = rows.withColumn("k", F.count("head").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("k > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "piece")))), lambda x: x["piece"]), "")
    heads = rows.groupBy("path", "k").agg(F.max("head").alias("head"), text.alias("text")).withColumn("slug", heading_slug(F.col("head.heading")))
    again = F.row_number().over(Window.partitionBy("path", "slug").orderBy("k")) - 1
    anchor = F.when(again > 0, F.concat_ws("-", "slug", again)).otherwise(F.col("slug"))
    return heads.select("path", "head.heading", anchor.alias("anchor"), "head.level", "head.line", F.regexp_replace(F.regexp_replace("text", r"\r\n", "\n"), r"\A\s+|\s+\z", "").alias("text"))


# Endings of paths that stand in code spans.
PATH_ENDINGS = "md|rs|toml|yaml|yml|json|sh|ts|tsx|py|js|jsx|txt|lock|sql|conf|ini|env|dockerfile|html|css|scss|proto|graphql|mjs|cjs|kt|java|go|c|cpp|h|hpp"
URL = r"(?i)\A(?:https?://|mailto:|ftps?://|tel:)"
_INLINE = r"(?:[^`\n]++|\n(?![ \t]*+\n))*+"
_LINKS = rf"(?<!`)`(?!`){_INLINE}`(?!`)|(?<!`)(``++)(?:[^`\n]++|\n(?![ \t]*+\n)|(?<!`)`(?!`))*+\2(?!`)|\[\[[^\]|#]++(?:#[^\]|]++)?(?:\|[^\]]++)?\]\]|\]\([^)\n]*+\)|xref:[^\[\s]++\[|!\[[^\]\n]*+\]\([^)\n]*+\)|(?:[^`\[\]x!\n]++|x(?!ref:)|!(?!\[))++|[\s\S]"
MARKDOWN_LINK = rf"{_fenced('```|~~~')}|{_LINKS}"
ADOC_LINK = rf"{_fenced(r'```|~~~|----|\.\.\.\.')}|{_LINKS}"


def links(files: DataFrame) -> DataFrame:
    """(path, kind, target, line): wiki links, markdown links and AsciiDoc references outside code, and paths in code spans.

    * ``wikilink``: ``[[target]]``, with an anchor or a label or not; it may be wrapped.
    * ``md_link``: ``[label](target)`` but for addresses and bare anchors; the anchor and a title drop.
    * ``xref``: ``xref:target[label]`` of .adoc files, but for coordinates and addresses (a colon).
    * ``inline_path``: a code span, not the label of a link, that begins with ``./`` or ``../``, or has a
      folder and a known ending, and has no blank, pattern sign or brace and is not absolute.

    Images are no links.  Code by indentation counts as text.  Paths of files are unique.
    """
    adoc = is_adoc(F.col("path"))
    rows = pieces(files, MARKDOWN_LINK, ADOC_LINK)
    p, by_file = F.col("piece"), Window.partitionBy("path").orderBy("pos")
    # a span directly between brackets is a label
    label = (F.lag("piece").over(by_file) == "[") & F.coalesce(F.lead("piece").over(by_file).startswith("]("), F.lit(False))
    rows = rows.withColumn("label", label).where(p.rlike(r"\A(?:\[\[.|\]\(|xref:.|`)") & ~p.rlike(r"\A```[^`]*\n"))
    span = F.trim(F.regexp_replace(p, r"\A`++|`++\z", ""))
    wiki = F.trim(F.regexp_replace(F.regexp_extract(p, r"\A\[\[([^\]|#]+)", 1), "[\r\n]", ""))
    mark = F.regexp_extract(p, r"\A\]\(\s*<?([^)\s#>]*)", 1)
    xref = F.regexp_extract(p, r"\Axref:([^\[\s#]+)", 1)
    path_like = span.rlike(r"\A[^\s*?{<]+\z") & ~span.rlike(r"\A(?:~/|/)") & ~span.rlike(URL) & (span.rlike(r"\A\.\.?/") | span.rlike(rf"(?i)\A[^#]*/[^/#]*\.(?:{PATH_ENDINGS})(?::[^/#.]*)?(?:#.*)?\z"))
    one = (
        F.when(p.startswith("[["), F.struct(F.lit("wikilink").alias("kind"), wiki.alias("target")))
        .when(p.startswith("]("), F.when(~mark.rlike(URL), F.struct(F.lit("md_link").alias("kind"), mark.alias("target"))))
        .when(p.startswith("xref:"), F.when(adoc & ~xref.contains(":"), F.struct(F.lit("xref").alias("kind"), xref.alias("target"))))
        .when(path_like & ~F.coalesce("label", F.lit(False)), F.struct(F.lit("inline_path").alias("kind"), span.alias("target")))
    )
    return rows.withColumn("one", one).where("one.target <> ''").select("path", "one.kind", "one.target", "line")


#: Lines of a log that are ordered together.
LOG_BLOCK = 4096


def git_log(log: DataFrame) -> DataFrame:
    """(commit, at, file) from lines ``hash|unix time|`` followed by file names; (line, text) in log order.

    Each name belongs to the last header before it: a running maximum within
    blocks of lines, with what the earlier blocks leave, so only a row for each
    block is put in one order.
    """
    head = F.col("text").rlike(r"^[0-9a-f]{7,40}\|\d+\|")
    rows = log.withColumn("block", F.expr(f"line div {LOG_BLOCK}")).withColumn("head", F.when(head, F.col("line")))
    ends = rows.groupBy("block").agg(F.max("head").alias("last"))
    before = ends.select("block", F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    running = F.max("head").over(Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("own", running).join(before, "block").withColumn("at_line", F.coalesce("own", "carried"))
    heads = log.where(head).select(F.col("line").alias("at_line"), F.split("text", r"\|")[0].alias("commit"), F.split("text", r"\|")[1].cast("long").alias("at"))
    return marked.where(F.col("head").isNull() & (F.trim("text") != "")).join(heads, "at_line").select("commit", "at", F.trim("text").alias("file"))


# Words that end a call and name no handler.
RESERVED = ("function", "async", "await", "return", "true", "false", "null", "undefined")
_VERBS = "get|post|put|delete|patch|head|options"


def endpoints(files: DataFrame) -> DataFrame:
    """(id, kind, method, path, handler, source_file, source_line) of web routes found by pattern.

    Python decorators take the next ``def`` within 20 lines as the handler, by
    a window over the following lines; a script's call takes the name that is its
    last argument.  Java has a reader of its own (``operators.java_routes``).
    """
    rows = lines(files)
    name = F.regexp_extract("text", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", 1)
    ahead = Window.partitionBy("path").orderBy("line").rowsBetween(1, 20)
    rows = rows.withColumn("handler", F.first(F.when(name != "", name), ignorenulls=True).over(ahead))
    fast = rows.where(F.col("path").endswith(".py") & F.col("text").rlike(rf"^\s*@\w+\.({_VERBS})\(\s*[\"']")).select(F.lit("fastapi").alias("kind"), F.upper(F.regexp_extract("text", rf"\.({_VERBS})\(", 1)).alias("method"), F.regexp_extract("text", r"\(\s*[\"']([^\"']*)", 1).alias("route"), "handler", "path", "line")
    given = F.regexp_extract("text", r"methods\s*=\s*\[([^\]]*)\]", 1)
    methods = F.when(given != "", F.regexp_extract_all(F.upper(given), F.lit(r"([A-Z]+)"), 1)).otherwise(F.array(F.lit("GET")))
    flask = rows.where(F.col("path").endswith(".py") & F.col("text").rlike(r"^\s*@\w+\.route\(")).select(F.lit("flask").alias("kind"), F.explode(methods).alias("method"), F.regexp_extract("text", r"\(\s*[\"']([^\"']*)", 1).alias("route"), "handler", "path", "line")
    called = rf"^\s*(?:(?:export|return|await|const|let|var)\s+)?\w+\.({_VERBS}|all)\s*\(\s*[\"'`]([^\"'`]+)[\"'`](.*)$"
    last = F.regexp_extract(F.regexp_extract("text", called, 3), r",\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\)\s*;?\s*$", 1)
    express = rows.where(F.col("path").rlike(r"\.[jt]sx?$") & F.col("text").rlike(called)).select(
        F.lit("express").alias("kind"), F.upper(F.regexp_extract("text", called, 1)).alias("method"), F.regexp_extract("text", called, 2).alias("route"), F.when((last != "") & ~last.isin(*RESERVED), last).alias("handler"), "path", "line")
    found = fast.unionByName(flask).unionByName(express)
    return found.select(F.concat_ws(":", "kind", "method", "route").alias("id"), "kind", "method", F.col("route").alias("path"), "handler", F.col("path").alias("source_file"), F.col("line").alias("source_line"))


# Line comments by file ending.
COMMENTS = {"rs": "//", "ts": "//", "tsx": "//", "js": "//", "jsx": "//", "mjs": "//", "cjs": "//", "java": "//", "py": "#"}


def _cut_bytes(text: Column, most: int) -> Column:
    """At most so many bytes of a text, whole characters alone, with a sign where it was cut."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # one character for each byte
    head = F.regexp_extract(latin, rf"(?s)\A(.{{0,{most}}})(?![\x80-\xBF])", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.encode(head, "ISO-8859-1"), "UTF-8"), F.lit("…")))


def findings(files: DataFrame, markers: tuple[str, ...] = ("TODO", "FIXME", "XXX", "HACK"), most: int = 200) -> DataFrame:
    """(id, kind, file, line, message, severity): the first marker of each line that begins as a comment of its language.

    A marker is a word in capitals.  FIXME and HACK are warnings, others tell; a
    message longer than ``most`` bytes is cut.  Files of other languages have none.
    """
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in COMMENTS.items() for x in kv]), F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = lines(files.where(prefix.isNotNull())).withColumn("text", F.regexp_replace("text", r"\A\s+", "")).where(F.startswith("text", prefix))
    body = F.regexp_replace(F.expr("text"), r"\A(?://|#)\s*", "")
    pattern = rf"(?s)\A(?:.*?[^A-Za-z0-9])??({'|'.join(markers)})(?![A-Za-z0-9])\s*:?(.*)\z"
    rows = rows.select("path", "line", F.regexp_extract(body, pattern, 1).alias("marker"), F.regexp_replace(F.regexp_extract(body, pattern, 2), r"\A\s+|\s+\z", "").alias("message")).where("marker <> ''")
    kind = F.lower("marker")
    return rows.select(F.concat_ws(":", "path", "line", kind).alias("id"), kind.alias("kind"), F.col("path").alias("file"), "line", _cut_bytes(F.col("message"), most).alias("message"), F.when(F.col("marker").isin("FIXME", "HACK"), "warning").otherwise("info").alias("severity"))


def innermost(occurrences: DataFrame, spans: DataFrame) -> DataFrame:
    """Each occurrence (file, line, ...) with the innermost of the spans (file, symbol, begin, end) that hold it.

    Which span that is depends on file and line alone, so it is settled for each line
    of a file, not for each occurrence: spans are cut to blocks of 64 lines, of those
    that cover the same lines of a block the innermost stays (there are at most 2080
    such ranges in a block, however many spans), and what stays is laid out by lines.
    Occurrences come back as often as they were given.
    """
    best = F.struct(F.expr("end - begin").alias("size"), "symbol")
    cut = spans.where("begin <= end").select("file", "begin", "end", best.alias("best")).groupBy("file", "begin", "end").agg(F.min("best").alias("best"))
    blocks = cut.withColumn("block", F.explode(F.sequence(F.expr("shiftright(begin, 6)"), F.expr("shiftright(end, 6)"))))
    ranges = blocks.select("file", F.expr("greatest(begin, block * 64)").alias("low"), F.expr("least(end, block * 64 + 63)").alias("high"), "best").groupBy("file", "low", "high").agg(F.min("best").alias("best"))
    by_line = ranges.select("file", F.explode(F.sequence("low", "high")).alias("line"), "best").groupBy("file", "line").agg(F.min("best")["symbol"].alias("enclosing"))
    return occurrences.join(by_line, ["file", "line"]).select(*occurrences.columns, "enclosing")
