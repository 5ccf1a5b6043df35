"""Lines of files against spans."""

from pyspark.sql import functions as F

from quillgraph.sources import repository


def test_lines_of_many_spans(spark):
    """As many spans and occurrences as there are, on few lines: what is joined grows with both, not with their product."""
    n = 20_000
    spans = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("s"), "id").alias("symbol"), (1 + F.col("id") % 97).alias("begin"), (1 + F.col("id") % 97 + 5 + F.col("id") % 61).alias("end"))
    used = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") % 200 - 5).alias("line"), F.col("id").alias("tag"))
    got = repository.innermost(used, spans)
    plain = {}
    for s in spans.collect():
        for line in range(s.begin, s.end + 1):
            plain[line] = min(plain.get(line, (10**9, "")), (s.end - s.begin, s.symbol))
    assert sorted((r.tag, r.enclosing) for r in got.collect()) == sorted((r.tag, plain[r.line][1]) for r in used.collect() if r.line in plain)
