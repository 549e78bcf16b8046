"""Paths from roots to codes through vocabularies.

edges: child, parent (and pos, the parent's place). One level a step: partial
paths are joined with edges on their head, so each step is one equi-join; the
levels are written between steps. Paths run from root to code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def walk_up(codes: DataFrame, edges: DataFrame, most_nodes: int = 200, per_level: int | None = None, guard: bool = True, root_fallback: bool = False) -> DataFrame:
    """code, path of every way from a root to each code.

    guard: no node twice on a path. root_fallback: a path whose parents are all on
    it already ends there. per_level: so many partial paths a code and level, by
    their order. Paths of more than most_nodes nodes are dropped.
    """
    links = cut_lineage(edges.select("child", "parent").distinct(), "links")
    known = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    tops = cut_lineage(known.join(links.select(F.col("child").alias("node")).distinct(), "node", "left_anti"), "tops")
    now = codes.select("code").distinct().join(known.withColumnRenamed("node", "code"), "code", "left_semi").select("code", F.col("code").alias("node"), F.array("code").alias("path"))
    done: list[DataFrame] = []
    for _ in range(most_nodes):
        now = cut_lineage(now, "paths")
        if now.isEmpty():
            break
        done.append(now.join(tops, "node", "left_semi").select("code", "path"))
        ahead = now.join(links, now["node"] == links["child"])
        if guard:
            ahead = ahead.where(~F.array_contains("path", F.col("parent")))
        if root_fallback:
            stuck = now.join(tops, "node", "left_anti").join(ahead.select("code", "path").distinct(), ["code", "path"], "left_anti")
            done.append(stuck.select("code", "path"))
        now = ahead.select("code", F.col("parent").alias("node"), F.concat(F.array("parent"), "path").alias("path"))
        if per_level:
            now = now.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("path"))).where(F.col("r") <= per_level).drop("r")
    return reduce(DataFrame.unionByName, done) if done else now.select("code", "path")


def capped(paths: DataFrame, paths_a_code: int, most_nodes: int, truncate: bool = False) -> DataFrame:
    """The first paths of each code; those too long are dropped, or cut to their first nodes."""
    rows = paths.withColumn("path", F.slice("path", 1, most_nodes)) if truncate else paths.where(F.size("path") <= most_nodes)
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.array_join("path", " > ")))).where(F.col("r") <= paths_a_code).drop("r")


def with_unknown(codes: DataFrame, paths: DataFrame, edges: DataFrame, label: str = "Unknown: ") -> DataFrame:
    """Adds one-node paths for codes that the vocabulary doesn't have."""
    known = edges.select(F.col("child").alias("code")).union(edges.select("parent"))
    missing = codes.select("code").distinct().join(known.distinct(), "code", "left_anti")
    return paths.unionByName(missing.select("code", F.array(F.concat(F.lit(label), "code")).alias("path")))


def with_names(paths: DataFrame, names: DataFrame, label: str = "Unknown: ", keep: tuple[str, ...] = ()) -> DataFrame:
    """paths with nodes (code, name); a node without a name is called by its label and code. names: code, name, one a code. keep: further columns."""
    rows = paths.withColumn("_path", F.col("path")).select("code", *keep, "_path", F.posexplode("path").alias("at", "node"))
    called = rows.join(names.select(F.col("code").alias("node"), "name"), "node", "left")
    step = F.struct("at", F.col("node").alias("code"), F.coalesce("name", F.concat(F.lit(label), "node")).alias("name"))
    steps = called.groupBy("code", *keep, "_path").agg(F.array_sort(F.collect_list(step)).alias("s"))
    return steps.select("code", *keep, F.transform("s", lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"))).alias("path"))


#: What the first letters of tree numbers stand for.
ROOTS = {
    "A": "Anatomy",
    "B": "Organisms",
    "C": "Diseases",
    "D": "Chemicals and Drugs",
    "E": "Analytical, Diagnostic and Therapeutic Techniques, and Equipment",
    "F": "Psychiatry and Psychology",
    "G": "Phenomena and Processes",
    "H": "Disciplines and Occupations",
    "I": "Anthropology, Education, Sociology and Social Phenomena",
    "J": "Technology, Industry, Agriculture",
    "K": "Humanities",
    "L": "Information Science",
    "M": "Named Groups",
    "N": "Health Care",
    "O": "Publication Characteristics",
    "P": "Publication Components",
    "Q": "Geographic Locations",
    "V": "Publication Types",
    "Z": "Geographical Locations",
}


def descriptor_paths(trees: DataFrame) -> DataFrame:
    """code, tree, path of every tree number, root letter first, nodes (code, name). trees: tree, code, name.

    A tree number that no descriptor has is called Unknown, unless it is a root's letter.
    """
    steps = trees.select("code", "tree", F.posexplode(prefixes(F.col("tree"))).alias("at", "node"))
    held = trees.groupBy(F.col("tree").alias("node")).agg(F.min(F.struct("code", "name")).alias("d"))
    root = F.element_at(F.create_map(*[F.lit(x) for pair in ROOTS.items() for x in pair]), F.col("node"))
    name = F.coalesce("d.name", root, F.concat(F.lit("Unknown: "), "node"))
    rows = steps.join(held, "node", "left").select("code", "tree", F.struct("at", F.coalesce("d.code", "node").alias("code"), name.alias("name")).alias("s"))
    out = rows.groupBy("code", "tree").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return out.select("code", "tree", F.transform("s", lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"))).alias("path"))


def single_parent(edges: DataFrame) -> DataFrame:
    """Only each child's first parent."""
    return edges.groupBy("child").agg(F.min_by("parent", "pos").alias("parent"))


def prefixes(tree_number: Column, separator: str = r"\.", by: str = ".") -> Column:
    """The tree numbers on the way from the root to one, its letter first."""
    parts = F.split(tree_number, separator)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), by))
    return F.concat(F.array(F.substring(tree_number, 1, 1)), steps)


def levels(names: list[str]) -> Column:
    """A path from the levels of a wide row, top first; missing levels are left out."""
    return F.array_compact(F.array(*[F.when(F.col(n) != "", F.col(n)) for n in names]))


def icd_parents(codes: DataFrame) -> DataFrame:
    """child, parent, pos: the longest proper prefix (the dot left out) that is a code itself."""
    bare = codes.select("code", F.replace(F.col("code"), F.lit("."), F.lit("")).alias("b")).distinct()
    shorter = F.when(F.length("b") > 3, F.transform(F.sequence(F.lit(3), F.greatest(F.length("b") - 1, F.lit(3))), lambda k: F.substring(F.col("b"), F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    tries = bare.select(F.col("code").alias("child"), F.explode(shorter).alias("p"))
    found = tries.join(bare.select(F.col("code").alias("parent"), F.col("b").alias("p")), "p")
    return found.groupBy("child").agg(F.max_by("parent", F.length("p")).alias("parent")).withColumn("pos", F.lit(0))


def path_stats(paths: DataFrame, by: list[str]) -> DataFrame:
    """Numbers and lengths of paths of a group's codes."""
    per_code = paths.groupBy(*by, "code").agg(F.count("*").alias("n"), F.sum(F.size("path")).alias("nodes"), F.min(F.size("path")).alias("lo"), F.max(F.size("path")).alias("hi"))
    return per_code.groupBy(*by).agg(F.count("*").alias("codes"), F.sum("n").alias("total_paths"), F.avg("n").alias("mean_paths"), F.median("n").alias("median_paths"), F.min("lo").alias("min_length"), F.max("hi").alias("max_length"), (F.sum("nodes") / F.sum("n")).alias("mean_length"))


def code_status(codes: DataFrame, paths: DataFrame, valid: Column, active: Column | None = None, skipped: Column | None = None, invalid: str = "error", nothing: str = "not_found") -> DataFrame:
    """codes (cui, code) with n_paths and status: skipped_mthu, `invalid`, inactive, `nothing` or success. paths: a row a path, or code and n_paths."""
    n = paths if "n_paths" in paths.columns else paths.groupBy("code").agg(F.count("*").alias("n_paths"))
    status = F.when(~valid, invalid) if skipped is None else F.when(skipped, "skipped_mthu").when(~valid, invalid)
    status = status.when(~active, "inactive") if active is not None else status
    rows = codes.join(n, "code", "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)))
    return rows.withColumn("status", status.when(F.col("n_paths") == 0, nothing).otherwise("success"))


def resume(todo: DataFrame, processed: DataFrame) -> DataFrame:
    """What is left to do; results of before stay, new ones are appended."""
    return todo.join(processed.select("cui").distinct(), "cui", "left_anti")
