"""Calls of the projection by keys: what the SQL of CALLS says, without its texts.

A function's symbol and file follow from its kind, its key and its home (the nation of
a customer or supplier, the brand of a part), and no two of these share a symbol.  So
calls are joined, made distinct and counted by kind, home and key, and the texts are
made last, of what is left.  ``home`` is the number of the file's form, that of the symbol's,
and the nation or brand, null where that is null; then the symbol is null too, and all
such functions are one.  Forms are settled once for each function, so what runs for each
call is two lookups and short enough to be compiled.  ``n`` is how many rows of Function
have the symbol.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A file is what stands before and after the nation or brand, by form: customers, suppliers, then parts.
FILES = (
    *((f"backend/{x}", ".py") for x in ("tests/test_n", "app/routes/n", "app/cli/n", "app/core/n")),
    *(("src/supply/n", x) for x in ("_tests.rs", "/mod.rs", ".rs")),
    *(("lib/", x) for x in (".pyx", ".pxd", ".pyi")),
    *((f"frontend/src/{d}/", x) for d in ("routes", "components", "client", "lib") for x in (".gen.ts", ".spec.tsx", ".tsx")),
)
#: A symbol is what stands before and after the nation or brand; the key follows.
SYMBOLS = (
    *(("backend/tests/test_n", x) for x in ("/_helper", "/Case#__made", "/test_c")), ("app/cli/n", "/c"), *(("app/n", x) for x in ("/_c", "/Base#_c", "/Base#c", "/__init__c", "/c")),
    ("supply/n", "/s"), ("web/", "/View#p"), ("web/", "/p"),
)
#: Kind to table, key, nation or brand, and the numbers of the forms.
_FORMS = {
    "c": ("customer", "c_custkey", "CAST(c_nationkey AS STRING)", "CASE at % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END",
          "CASE at % 7 WHEN 0 THEN CASE at % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END WHEN 2 THEN 3 ELSE CASE at % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 7 ELSE 8 END END"),
    "s": ("supplier", "s_suppkey", "CAST(s_nationkey AS STRING)", "CASE WHEN at % 9 = 0 THEN 4 WHEN at % 11 = 0 THEN 5 ELSE 6 END", "9"),
    "p": ("part", "p_partkey", "replace(p_brand, '#', '')",
          "CASE WHEN at % 17 = 0 THEN CASE WHEN at % 2 = 0 THEN 7 ELSE 8 END WHEN at % 19 = 0 THEN 9 ELSE 10 + 3 * CASE at % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END + CASE WHEN at % 13 = 0 THEN 0 WHEN at % 29 = 0 THEN 1 ELSE 2 END END",
          "CASE WHEN at % 3 = 0 THEN 10 ELSE 11 END"),
}


def _form(home: str, start: int, forms: tuple, side: int) -> str:
    return f"element_at(array({', '.join(repr(x[side]) for x in forms)}), 1 + CAST(substr({home}, {start}, 2) AS INT))"


_FILE = f"concat({_form('{h}', 1, FILES, 0)}, lower(substr({{h}}, 5)), {_form('{h}', 1, FILES, 1)})"
_SYMBOL = f"concat({_form('{h}', 3, SYMBOLS, 0)}, substr({{h}}, 5), {_form('{h}', 3, SYMBOLS, 1)}, CAST({{k}} AS STRING), '().')"
_TYPE = """concat('web/', substr({h}, 5), '/T', CAST({k} AS STRING), element_at(array('Error#', 'Exception#', 'Failure#', 'Record#', 'SignalDetector#', '#'), CAST(1 + if({k} % 7 BETWEEN 0 AND 4, {k} % 7, 5) AS INT)))"""
KINDS = ("cs", "sp", "pc", "cc")
ENDS = ("src_home", "src_key", "dst_home", "dst_key")


def file_of(end: str) -> Column:
    return F.expr(_FILE.format(h=f"{end}_home", k=f"{end}_key"))


def symbol_of(end: str) -> Column:
    return F.expr(_SYMBOL.format(h=f"{end}_home", k=f"{end}_key"))


def line_of(end: str) -> Column:
    return F.expr(f"1 + CAST({end}_key % 400 AS INT)")


def type_of(end: str) -> Column:
    """The type that stands for the same part as a function."""
    return F.expr(_TYPE.format(h=f"{end}_home", k=f"{end}_key"))


def functions(raw: Mapping[str, DataFrame], kind: str) -> DataFrame:
    """(at, e): keys of a kind, each with its ends (home, key, n)."""
    table, key, group, file, symbol = _FORMS[kind]
    rows = raw[table].select(F.col(key).alias("at"), F.expr(group).alias("of")).where("at IS NOT NULL")
    rows = rows.select("at", F.expr(f"concat(lpad({file}, 2, '0'), lpad({symbol}, 2, '0'), of)").alias("home"))
    each = rows.groupBy("at", "home").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("home").isNotNull()
    return each.select("at", F.struct("home", F.when(known, F.col("at").cast("long")).alias("key"), F.when(known, F.col("n")).otherwise(0).cast("long").alias("n")).alias("e"))


def ends(raw: Mapping[str, DataFrame]) -> DataFrame:
    """(home, key, symbol) of every function that has a symbol, once."""
    found = functions(raw, "c").unionByName(functions(raw, "s")).unionByName(functions(raw, "p")).where("e.home IS NOT NULL").select("e.home", "e.key").distinct()
    return found.select("home", "key", F.expr(_SYMBOL.format(h="home", k="key")).alias("symbol"))


def rows(raw: Mapping[str, DataFrame], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(src_home, src_key, src_n, dst_home, dst_key, dst_n, line, dispatch) of each call, as often as the rows say it.

    An order finds its customer, then a line its order, supplier and part: a line is
    moved once for each, and gives all of its calls.
    """
    found = None
    if {"cs", "sp", "pc"} & set(kinds):
        line = raw["lineitem"].select("l_orderkey", "l_suppkey", "l_partkey", F.col("l_linenumber").alias("line"), F.expr("l_linenumber = 1 AND l_returnflag = 'R'").alias("sent"))
        if {"cs", "sp"} & set(kinds):
            line = line.join(functions(raw, "s").select(F.col("at").alias("l_suppkey"), F.col("e").alias("s")), "l_suppkey", "left")
        if {"sp", "pc"} & set(kinds):
            line = line.join(functions(raw, "p").select(F.col("at").alias("l_partkey"), F.col("e").alias("p")), "l_partkey", "left")
        if {"cs", "pc"} & set(kinds):
            order = raw["orders"].select("o_orderkey", F.col("o_custkey").alias("at")).join(functions(raw, "c"), "at").select(F.col("o_orderkey").alias("l_orderkey"), F.col("e").alias("c"))
            line = line.join(order, "l_orderkey", "left")
        made = [F.when(F.expr(f"{k[0]} IS NOT NULL AND {k[1]} IS NOT NULL" + (" AND sent" if k == "pc" else "")), F.struct(F.col(k[0]).alias("src"), F.col(k[1]).alias("dst"), F.lit(int(k == "pc")).alias("dispatch"))) for k in ("cs", "sp", "pc") if k in kinds]
        found = line.select("line", F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.src", "x.dst", "line", "x.dispatch")
    if "cc" in kinds:
        urgent = raw["orders"].where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("a"), F.expr("o_custkey + 1").alias("b")).distinct()
        a, b = functions(raw, "c").select(F.col("at").alias("a"), F.col("e").alias("src")), functions(raw, "c").select(F.col("at").alias("b"), F.col("e").alias("dst"))
        next_ = urgent.join(a, "a").join(b, "b").select("src", "dst", F.lit(1).alias("line"), F.lit(0).alias("dispatch"))
        found = next_ if found is None else found.union(next_)
    return found.select(*[F.col(f"{end}.{x}").alias(f"{end}_{x}") for end in ("src", "dst") for x in ("home", "key", "n")], "line", "dispatch")


def distinct_calls(raw: Mapping[str, DataFrame], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    return rows(raw, kinds).distinct()


def calls(raw: Mapping[str, DataFrame]) -> DataFrame:
    """The table CALLS."""
    return distinct_calls(raw).select(symbol_of("src").alias("src"), symbol_of("dst").alias("dst"), file_of("src").alias("source_file"), F.col("line").alias("source_line"), "dispatch")


def pairs(raw: Mapping[str, DataFrame], kind: str, line: bool = False, customers: DataFrame | None = None) -> DataFrame:
    """(a, b[, line]) of a kind's calls by the keys of the raw tables alone, as often as the rows say it.

    ``customers`` (c, ...) adds what is said of a customer, to its orders, which are fewer than their lines.
    """
    if kind == "cc":
        found = raw["orders"].where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("a"), F.expr("o_custkey + 1").alias("b"), F.lit(1).alias("line"))
    else:
        of = raw["lineitem"].select("l_orderkey", F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("line"), "l_returnflag")
        if kind == "pc":
            of = of.where("line = 1 AND l_returnflag = 'R'")
        if "c" in kind:
            order = raw["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c")).where("c IS NOT NULL")
            if customers is not None:
                order = order.join(customers, "c")
            of = of.where(f"{kind.replace('c', '')} IS NOT NULL").join(order, "l_orderkey")
        found = of.withColumnsRenamed({kind[0]: "a", kind[1]: "b"})
    more = [x for x in (customers.columns if customers is not None else ()) if x != "c"]
    return found.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", *(["line"] if line else []), *more)


def keys(raw: Mapping[str, DataFrame], kind: str, by: str, line: bool = False, customers: DataFrame | None = None) -> DataFrame:
    """What :func:`pairs` says, once each and dealt by one of the ends.

    Rows are moved once to be made distinct, and lie where the end they are dealt by is
    looked up or counted.
    """
    return pairs(raw, kind, line, customers).repartition(F.col(by)).distinct()


#: Groups of parts that lines are dealt to; a supplier's row goes to each.
CELLS = 128


def beside(found: DataFrame, far: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(cell, a, b, ...) of calls, once each, with the columns of ``far`` (a, ...) and ``near`` (b, ...), as inner joins give them.

    Lines are moved once, however many suppliers there are: to the cell of their part, as
    the part's row is, and each supplier's row is laid in every cell.  Within a cell rows
    are sorted by an end, where what is said of it stands before its lines and is carried on.
    """
    cell, more = F.expr(f"pmod(hash(b), {CELLS})"), found.columns

    def said(of: DataFrame, end: str) -> DataFrame:
        return of.groupBy(end).agg(F.collect_list(F.struct(*[x for x in of.columns if x != end])).alias(f"of_{end}"))

    def carried(df: DataFrame, end: str, other: str) -> DataFrame:
        before = Window.partitionBy("cell", end).orderBy(F.col(other).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(f"of_{end}", F.last(f"of_{end}", ignorenulls=True).over(before)).where(f"{other} IS NOT NULL AND ({end} IS NULL OR of_{end} IS NOT NULL)")

    laid = found.withColumn("cell", cell).unionByName(said(far, "a").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))), allowMissingColumns=True)
    if near is not None:
        laid = laid.unionByName(said(near, "b").withColumn("cell", cell), allowMissingColumns=True)
    ends = ["of_a"] + (["of_b"] if near is not None else [])
    once = laid.repartition(F.col("cell")).groupBy("cell", *more).agg(*[F.first(x, ignorenulls=True).alias(x) for x in ends])
    once = carried(once, "a", "b")
    if near is not None:
        once = carried(once, "b", "a")
    for x in ends:
        once = once.select(*[c for c in once.columns if c != x], F.inline(x))
    return once


def call_ends(raw: Mapping[str, DataFrame], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(symbol, file, dst_symbol, dst_file, n): calls with what their ends' rows of Function say; n such pairs of rows."""
    found = None
    for kind in kinds:
        one = keys(raw, kind, "a", line=True)
        for end, name in (("a", "src"), ("b", "dst")):
            of = functions(raw, kind[end == "b"]).where("e.home IS NOT NULL")
            one = one.join(of.select(F.col("at").alias(end), F.col("e.home").alias(f"{name}_home"), F.col("e.n").alias(f"{name}_n")), end)
        one = one.select(*[F.col(x).alias(f"{name}_key") for x, name in (("a", "src"), ("b", "dst"))], "src_home", "dst_home", "src_n", "dst_n")
        found = one if found is None else found.unionByName(one)
    return found.select(symbol_of("src").alias("symbol"), file_of("src").alias("file"), symbol_of("dst").alias("dst_symbol"), file_of("dst").alias("dst_file"), F.expr("src_n * dst_n").alias("n"))


def ends_under(prefix: str) -> str:
    """The table of the calls that functions of files under a path can make."""
    heads = {"c": FILES[:4], "s": FILES[4:7], "p": FILES[7:]}
    can = [k for k, files in heads.items() if any(h.startswith(prefix) or prefix.startswith(h) for h, _ in files)]
    return f"call_ends_{can[0]}" if len(can) == 1 else "call_ends"


def degree(raw: Mapping[str, DataFrame], mine: str, other: str) -> DataFrame:
    """(k, file, n, files): the functions on the other end of a function's calls, and their files; no call is from a function to itself."""
    at = int(mine == "dst")
    end, far = "ab"[at], "ab"[1 - at]
    out = None
    for m in "csp":
        found = None
        for kind in (k for k in KINDS if k[at] == m):
            o = kind[1 - at]
            # a key's symbols by file: the file's form, which the key gives, and the nation or brand as the file has it
            of = functions(raw, o).where("e.home IS NOT NULL").groupBy("at", F.expr("concat(substr(e.home, 1, 2), lower(substr(e.home, 5)))").alias("of")).agg(F.count(F.lit(1)).alias("h"))
            if kind == "cs" and o == "c":
                each = keys(raw, kind, end, customers=of.withColumnRenamed("at", "c"))
            else:
                # lines of a part are dealt by the part, whichever end is counted: the other end is looked up by what is near, and counts are summed before they are moved
                each = keys(raw, kind, "b" if kind == "sp" else end).join(of.withColumnRenamed("at", far), far)
            each = each.select(F.col(end).alias("at"), "of", "h")
            found = each if found is None else found.unionByName(each)
        sums = found.groupBy("at").agg(F.sum("h").alias("n"), F.count_distinct("of").alias("files"))
        homes = functions(raw, m).where("e.home IS NOT NULL").select("at", F.col("e.home").alias(f"{mine}_home"))
        one = sums.join(homes, "at").select(F.col("at").alias(f"{mine}_key"), f"{mine}_home", "n", "files")
        out = one if out is None else out.unionByName(one)
    return out.select(symbol_of(mine).alias("k"), file_of(mine).alias("file"), "n", "files")


#: What a function's symbol begins with, by kind.
_BEGINS = {"c": ("backend/", "app/"), "s": ("supply/",), "p": ("web/",)}


def named(table: DataFrame, kind: str) -> DataFrame:
    """(at, to, w): what a table (src, dst) of symbols says of the keys of a kind, and how often; a symbol ends in its key."""
    begins = " OR ".join(f"startswith(src, '{x}')" for x in _BEGINS[kind])
    at = F.regexp_extract("src", r"(-?[0-9]+)\(\)\.$", 1).cast("long")
    return table.where(begins).groupBy(at.alias("at"), F.col("dst").alias("to")).agg(F.count(F.lit(1)).alias("w"))


def between(raw: Mapping[str, DataFrame], source: DataFrame, target: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(src, dst, frequency): calls between what functions stand for, by (src, dst) tables of symbols; what stands for itself is left out.

    ``kinds`` are those calls whose ends can be in the two tables.
    """
    found = None
    for kind in kinds:
        a = named(source, kind[0]).select(F.col("at").alias("a"), F.col("to").alias("src"), F.col("w").alias("k"))
        b = named(target, kind[1]).select(F.col("at").alias("b"), F.col("to").alias("dst"), F.col("w").alias("l"))
        met = beside(pairs(raw, kind, line=True), a, b) if kind == "sp" else keys(raw, kind, "b", line=True).join(b, "b").join(a, "a")
        one = met.where("src <> dst").groupBy("src", "dst").agg(F.sum(F.expr("k * l")).alias("frequency"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("src", "dst").agg(F.sum("frequency").alias("frequency"))


def _occurrences(parts: list[tuple[Column, Column]], times: str) -> Column:
    each = [F.struct(symbol.alias("symbol"), line.alias("line")) for symbol, line in parts]
    return F.flatten(F.array_repeat(F.array(*each), F.expr(f"CAST({times} AS INT)")))


def references(raw: Mapping[str, DataFrame]) -> DataFrame:
    """(file, symbol, line, role) of the code index's references: a call's, and for one of a part its type's and, for each row of the part, its field's."""
    e = distinct_calls(raw).where("src_home IS NOT NULL")
    at = line_of("src")
    of_type = type_of("dst")
    field = F.concat(of_type, F.lit("f"), F.col("dst_key").cast("string"), F.lit("."))
    once = _occurrences([(symbol_of("dst"), at + 1 + F.col("line"))], "src_n")
    used = F.when(F.expr("dst_home IS NULL OR substr(dst_home, 1, 2) >= '07'") & F.expr("substr(src_home, 1, 2) BETWEEN '04' AND '06'"), F.concat(_occurrences([(of_type, at + F.col("line"))], "src_n"), _occurrences([(field, at + F.col("line"))], "src_n * dst_n")))
    found = e.select(file_of("src").alias("file"), F.inline(F.concat(once, F.coalesce(used, F.array().cast("array<struct<symbol:string,line:int>>")))))
    return found.select("file", "symbol", "line", F.lit("reference").alias("role"))
