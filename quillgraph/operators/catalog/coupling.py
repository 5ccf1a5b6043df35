"""Files that change together."""

from __future__ import annotations

from ...plans.relation import rel
from .base import cols, count_if, define, has, ladder

COUPLING = "file-coupling"
PAIR = {"a.path": "r.src", "b.path": "r.dst", "r.commits": "r.commits", "r.jaccard": "r.jaccard", "r.last_co_change_at": "r.last_co_change_at"}
REAL = "COUPLED_WITH r", ("semi", "File a", "a.path = r.src"), ("semi", "File b", "b.path = r.dst")
BY_JACCARD, BY_COMMITS = ["-r.jaccard", "-r.commits", "a.path", "b.path"], ["-r.commits", "-r.jaccard", "a.path", "b.path"]


def pairs(name: str, about: str, where, order: list[str], **params: str) -> None:
    define(COUPLING, name, about, lambda p: rel(*REAL, where=where(p), out=PAIR, order=order, limit=50), **params)


pairs("coupled-files", "pairs of files that change together", lambda p: None, BY_JACCARD)
pairs("coupled-files-without-scaffold", "pairs that do not always change together", lambda p: "r.jaccard < 1.0", BY_JACCARD)
pairs("coupled-files-by-jaccard-range", "pairs within a range", lambda p: f"r.jaccard >= CAST({p.min_jaccard} AS DOUBLE) AND r.jaccard <= CAST({p.max_jaccard} AS DOUBLE)", BY_JACCARD, min_jaccard="0.05", max_jaccard="0.5")
pairs("feature-evolution-coupling-hybrid", "pairs of many commits or few in common", lambda p: "r.commits >= 5 OR r.jaccard <= 0.55", BY_COMMITS)
pairs("feature-evolution-coupling", "pairs of five commits or more", lambda p: "r.commits >= 5", BY_JACCARD)
pairs("feature-evolution-coupling-by-commits", "such pairs by commits", lambda p: "r.commits >= 5", BY_COMMITS)
define(COUPLING, "coupling-density-stats", "scaffold against real coupling", lambda p: rel(*REAL, agg={"total_couplings": "count(*)", "scaffold_count": f"CAST({count_if('r.commits < 5 AND r.jaccard > 0.55')} AS BIGINT)", "real_count": f"CAST({count_if('r.commits >= 5 OR r.jaccard <= 0.55')} AS BIGINT)"}))
EITHER = rel("COUPLED_WITH c", out=cols("c", "src dst commits jaccard last_co_change_at"), union=[rel("COUPLED_WITH c", out={"src": "c.dst", "dst": "c.src", **cols("c", "commits jaccard last_co_change_at")})])
define(COUPLING, "files-coupled-to", "files that change with one", lambda p: rel(EITHER, ("semi", "File a", "a.path = r.src"), ("File b", "b.path = r.dst"), alias="r", where=f"r.src = {p.path}", out={"coupled_path": "b.path", "language": "b.language", "jaccard": "r.jaccard", "commits": "r.commits", "last_co_change": "r.last_co_change_at"}, order=["-jaccard", "coupled_path"]), path="backend/app/core/n1.py")
DEGREE = {"degree": "count(DISTINCT o.path)", "total_co_change_commits": "CAST(sum(r.commits) AS BIGINT)"}
define(COUPLING, "file-coupling-degree", "files by how many change with them", lambda p: rel("File f", (EITHER, "r.src = f.path", "r"), ("File o", "o.path = r.dst"), by=cols("f", "file_path=path language"), agg=DEGREE, having="degree >= 2", order=["-degree", "-total_co_change_commits", "file_path"], limit=50))
define(COUPLING, "files-by-path-pattern-with-coupling", "files of a path with their coupling", lambda p: rel("File f", ("left", EITHER, "r.src = f.path", "r"), ("left", "File o", "o.path = r.dst"), where=has("f.path", p.pattern), by=cols("f", "path language loc"), agg=DEGREE, order=["-degree", "-loc", "path"], limit=50), pattern="core")
# Sums of rounded values: engines add doubles in different orders.
MEAN = "round(sum(round(r.jaccard, 9)) / count(r.dst), 6)"
HUBS = rel("COUPLED_WITH r", ("semi", "File f", "f.path = r.src"), ("semi", "File o", "o.path = r.dst"), where="r.commits >= 5", by={"file": "r.src"}, agg={"neighbor_count": "count(r.dst)", "avg_jaccard": MEAN}, having="neighbor_count >= 2")
define(COUPLING, "feature-evolution-coupling-hubs", "files with two such pairs or more", lambda p: rel(HUBS, order=["-neighbor_count", "-avg_jaccard", "file"], limit=25))
define(COUPLING, "tight-vs-loose-coupling-hubs", "such files by how tight their coupling is", lambda p: rel(HUBS, out={"file": "file", "neighbor_count": "neighbor_count", "avg_jaccard": "avg_jaccard", "cluster_type": ladder(("avg_jaccard >= 0.7", "tight-cluster"), ("avg_jaccard < 0.5", "loose-orbit"), default="mixed")}, order=["-neighbor_count", "-avg_jaccard", "file"], limit=25))
