"""The reference graph of a package, what its root reaches, and chains from sources to sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators.documents import is_markdown, links
from tracewright.scratch import discard, stash

# Root names, reference shapes, capabilities at either end of a chain, rules that run unattended, the pair bound.
ROOT_NAMES = ("skill.md", "skill.yaml", "skill.yml")
MENTIONS = {"reference": r"(?U)\breferences?/[\w./-]+", "script": r"(?U)\bscripts?/[\w./-]+"}
IMPORT = r"(?mdU)^\s*(?:import|from)\s+([\w.]+)"
SOURCE_CAPABILITIES = ("credential_access",)
SINK_CAPABILITIES = ("exfiltration", "stage2_fetch", "hidden_execution", "persistence", "privilege_escalation", "ssrf")
UNATTENDED_RULES = ("SC-ST1", "SC-ST2", "SC-ST3", "SC-ST4", "SC-ST8")
MAX_PAIRS = 20_000
MAX_DEPTH = 10_000


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_extension(path: Column) -> Column:
    return F.when(basename(path).contains("."), F.regexp_extract(path, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(path)


def ordered_files(files: DataFrame) -> DataFrame:
    """`files` with file_ord, the place in the order of path components within the package."""
    return files.withColumn("file_ord", F.row_number().over(Window.partitionBy("pkg_id").orderBy(F.split("path", "/"))) - 1)


def roots(files: DataFrame) -> DataFrame:
    """(pkg_id, root): the shortest well-known root at the top, else the shortest markdown file there."""
    known, top = F.lower("path").isin(*ROOT_NAMES), F.lower("path").endswith(".md") & ~F.col("path").contains("/")
    ranked = ordered_files(files).where(known | top)
    return ranked.groupBy("pkg_id").agg(F.min_by("path", F.struct(F.when(known, 0).otherwise(1), F.length("path"), "file_ord")).alias("root"))


def mentions(texts: DataFrame) -> DataFrame:
    """(pkg_id, path, kind, target, line, ord, plausible): links of markdown files, and references and scripts that their text names.

    An unresolved mention counts only if it is plausible: its last part has an extension, or it stands in inline code.
    """
    markdown = texts.where(is_markdown(F.col("path")))
    linked = links(markdown).select("pkg_id", "path", F.lit("link").alias("kind"), "target", "line", F.lit(0).alias("ord"), F.lit(False).alias("plausible"))
    lines = markdown.select("pkg_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("_at", "_line"))
    out = linked
    for kind, shape in MENTIONS.items():
        some = lines.where(F.col("_line").rlike(shape)).withColumn("_gaps", F.split("_line", shape, -1))
        each = some.select("*", F.posexplode(F.regexp_extract_all("_line", F.lit(shape), F.lit(0))).alias("ord", "target"))
        ticks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("`"), F.lit("")))
        before = ticks(F.array_join(F.slice("_gaps", F.lit(1), F.col("ord") + 1), ""))
        quoted = (before % 2 == 1) & (ticks(F.col("_line")) > before)
        out = out.unionByName(each.select("pkg_id", "path", F.lit(kind).alias("kind"), "target", (F.col("_at") + 1).alias("line"), "ord", (basename(F.col("target")).contains(".") | quoted).alias("plausible")))
    return out


def resolved(named: DataFrame, files: DataFrame) -> DataFrame:
    """`named` with `found`, the file that a mention means, or null.

    The first file in order that is the mention from the mentioning folder, the mention itself, or ends with it; for
    a mention without extension, else the first whose path without extension is so. Files and mentions meet by the last part of
    their paths, so the join is one on keys.
    """
    key = ["pkg_id", "path", "kind", "target", "line", "ord"]
    bare = T.stripped(F.substring_index("target", "#", 1))
    folder = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    asked = named.select(*key, bare.alias("t"), F.replace(F.when(folder != "", F.concat(folder, F.lit("/"), bare)).otherwise(bare), F.lit("./"), F.lit("")).alias("c"))
    asked = asked.where((F.col("t") != "") & ~F.col("t").rlike("^(https?://|mailto:)"))
    stems = ~basename(F.col("t")).contains(".")
    keyed = asked.distinct().withColumn("base", F.explode(F.array_distinct(F.array(basename(F.col("t")), basename(F.col("c"))))))
    held = ordered_files(files).select(F.col("pkg_id").alias("_pkg"), F.col("path").alias("_file"), "file_ord")
    same = lambda p: (p == F.col("c")) | (p == F.col("t")) | F.endswith(p, F.concat(F.lit("/"), F.col("t")))
    whole = keyed.join(held.withColumn("_base", basename(F.col("_file"))), (F.col("pkg_id") == F.col("_pkg")) & (F.col("base") == F.col("_base"))).where(same(F.col("_file"))).withColumn("pass", F.lit(0))
    cut = held.withColumn("_stem", without_extension(F.col("_file")))
    stem = keyed.where(stems).join(cut.withColumn("_base", basename(F.col("_stem"))), (F.col("pkg_id") == F.col("_pkg")) & (F.col("base") == F.col("_base"))).where(same(F.col("_stem"))).withColumn("pass", F.lit(1)).drop("_stem")
    best = whole.unionByName(stem).groupBy(*key).agg(F.min_by("_file", F.struct("pass", "file_ord")).alias("found"))
    return named.join(best, key, "left")


def imports(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(pkg_id, src, dst) of Python files that import a module of the package by its path from the top."""
    modules = texts.where(F.col("path").endswith(".py")).select("pkg_id", F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1))).alias("module"))
    stem = F.replace("module", F.lit("."), F.lit("/"))
    wanted = modules.select("pkg_id", "src", F.explode(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))).alias("path"))
    return wanted.join(files.select("pkg_id", "path"), ["pkg_id", "path"]).select("pkg_id", "src", F.col("path").alias("dst"))


def edges_and_unresolved(texts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (pkg_id, src, dst); mentions of files that are not there (pkg_id, path, kind, target, line, ord)."""
    told = resolved(mentions(texts), files)
    linked = told.where("found is not null").select("pkg_id", F.col("path").alias("src"), F.col("found").alias("dst"))
    return linked.unionByName(imports(texts, files)).distinct(), told.where("found is null and plausible and kind != 'link'").drop("found", "plausible")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(pkg_id, path) that `starts` reach along `edges`, themselves included: a frontier is joined until nothing is new."""
    seen = stash(starts.select("pkg_id", "path").distinct(), "reached")
    frontier = seen
    for _ in range(MAX_DEPTH):
        step = edges.join(frontier, (edges.pkg_id == frontier.pkg_id) & (edges.src == frontier.path)).select(edges.pkg_id, F.col("dst").alias("path")).distinct()
        fresh = stash(step.join(seen, ["pkg_id", "path"], "left_anti"), "frontier")
        if fresh.isEmpty():
            return seen
        grown = stash(seen.unionByName(fresh), "reached")
        discard(seen)
        seen, frontier = grown, fresh
    raise RuntimeError(f"a reference chain of more than {MAX_DEPTH} files")


def nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(pkg_id, path, has_root, reachable, load_stage) of every file."""
    top = roots(files)
    seen = reached(edges, top.select("pkg_id", F.col("root").alias("path"))).withColumn("_seen", F.lit(True))
    joined = files.select("pkg_id", "path").join(top, "pkg_id", "left").join(seen, ["pkg_id", "path"], "left")
    reachable = F.coalesce("_seen", F.lit(False))
    stage = F.when(F.col("path") == F.col("root"), F.lit("immediate")).when(reachable, F.lit("on-demand")).otherwise(F.lit("unreachable"))
    return joined.select("pkg_id", "path", F.col("root").isNotNull().alias("has_root"), reachable.alias("reachable"), stage.alias("load_stage"))


def promoted(of_files: DataFrame, findings: DataFrame) -> DataFrame:
    """`of_files` with load_stage unattended where a structural rule says that the file runs on its own."""
    alone = findings.where((F.col("detector") == "structure") & F.col("rule_id").isin(*UNATTENDED_RULES)).select("pkg_id", "path").distinct().withColumn("_alone", F.lit(True))
    joined = of_files.join(alone, ["pkg_id", "path"], "left")
    return joined.withColumn("load_stage", F.when(F.col("_alone"), F.lit("unattended")).otherwise(F.col("load_stage"))).drop("_alone")


def capped(findings: DataFrame, most: int = MAX_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(sources, sinks) of each package; where they make too many pairs, only the first sources."""
    per_package = Window.partitionBy("pkg_id")
    source, sink = F.col("capability").isin(*SOURCE_CAPABILITIES), F.col("capability").isin(*SINK_CAPABILITIES)
    ends = findings.where(source | sink).withColumn("_n", F.count(F.when(source, 1)).over(per_package)).withColumn("_m", F.count(F.when(sink, 1)).over(per_package))
    first = ends.where(source).withColumn("_i", F.row_number().over(per_package.orderBy("finding_ord")))
    room = F.when(F.col("_n") * F.col("_m") > most, F.greatest(F.lit(1), F.expr(f"{most} div greatest(1, _m)"))).otherwise(F.col("_n"))
    return first.where(F.col("_i") <= room), ends.where(sink)


def chains(findings: DataFrame, of_files: DataFrame, edges: DataFrame, most: int = MAX_PAIRS) -> DataFrame:
    """(pkg_id, chain_id, chain_ord, source_ord, sink_ord, source_rule, sink_rule, source_path, sink_path, same_file, direct, sink_unattended).

    Pairs of a source and a sink in one file, with an edge between their files either way, or in files that the root
    both reaches. A package's pairs are bounded, and so is its part of the join.
    """
    sources, sinks = capped(findings, most)
    stage = of_files.select("pkg_id", "path", "reachable", "load_stage", "has_root")
    end = lambda df, name: df.join(stage, ["pkg_id", "path"], "left").select("pkg_id", F.col("finding_ord").alias(f"{name}_ord"), F.col("rule_id").alias(f"{name}_rule"), F.col("path").alias(f"{name}_path"), F.coalesce(F.col("reachable") & F.col("has_root"), F.lit(False)).alias(f"{name}_reached"), F.coalesce(F.col("load_stage") == "unattended", F.lit(False)).alias(f"{name}_unattended"))
    pairs = end(sources, "source").join(end(sinks, "sink"), "pkg_id").where("source_ord != sink_ord")
    both_ways = edges.select("pkg_id", F.col("src").alias("source_path"), F.col("dst").alias("sink_path")).unionByName(edges.select("pkg_id", F.col("dst").alias("source_path"), F.col("src").alias("sink_path"))).distinct().withColumn("_edge", F.lit(True))
    met = pairs.join(both_ways, ["pkg_id", "source_path", "sink_path"], "left").withColumn("same_file", F.col("source_path") == F.col("sink_path"))
    met = met.withColumn("direct", F.col("same_file") | F.coalesce("_edge", F.lit(False))).where(F.col("direct") | (F.col("source_reached") & F.col("sink_reached")))
    number = F.row_number().over(Window.partitionBy("pkg_id").orderBy("source_ord", "sink_ord"))
    return met.withColumn("chain_ord", number).select("pkg_id", F.concat(F.lit("CHAIN-"), "chain_ord").alias("chain_id"), "chain_ord", "source_ord", "sink_ord", "source_rule", "sink_rule", "source_path", "sink_path", "same_file", "direct", "sink_unattended")
