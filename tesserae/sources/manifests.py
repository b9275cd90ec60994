"""Readers of JSON manifests and file inventories."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASE = "name string, repo_path string, buggy_functions array<string>, expected_rule_ids array<string>, failing_tests array<string>, passed_tests array<string>, metadata map<string,string>"


def read_manifests(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A row for each manifest below ``path``, with ``file`` (where it lies), ``manifest_reason`` and ``raw``.

    ``multi_line``: a manifest a file; else one a line. Only the columns of
    ``schema`` are taken from a manifest; missing ones are null. A manifest that
    is no JSON, or whose values are of other kinds than the schema's, is
    a row too: its text is ``raw`` and manifest_reason says ``not_readable``;
    one that has none of the columns has ``no_fields``; else it is empty.
    """
    rows = spark.read.schema(f"{schema}, raw string").json(path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="raw")
    fields = [f for f in rows.columns if f != "raw"]
    none = reduce(and_, [F.col(f).isNull() for f in fields])
    reason = F.when(F.col("raw").isNotNull(), "not_readable").when(none, "no_fields").otherwise("")
    return rows.select(*fields, F.col("_metadata.file_path").alias("file"), reason.alias("manifest_reason"), "raw")


def cases_of(manifests: DataFrame) -> DataFrame:
    """A row for each case of manifests with an array ``cases``; missing lists are empty, missing metadata too. A ``file`` stays."""
    kept = [c for c in ("file",) if c in manifests.columns]
    rows = manifests.select(*kept, F.explode("cases").alias("c")).select(*kept, "c.*")
    filled = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in rows.schema if f.dataType.typeName() == "array"}
    filled |= {f.name: F.coalesce(f.name, F.create_map().cast(f.dataType)) for f in rows.schema if f.dataType.typeName() == "map"}
    return rows.withColumns(filled)


def read_cases(spark: SparkSession, path: str, case: str = CASE, multi_line: bool = True) -> DataFrame:
    """Cases of all readable manifests below ``path``, each with the ``file`` it comes from."""
    return cases_of(read_manifests(spark, path, f"cases array<struct<{case}>>", multi_line).where("manifest_reason = ''"))


def unread(spark: SparkSession, path: str, case: str = CASE, multi_line: bool = True) -> DataFrame:
    """(file, reason) of manifests below ``path`` that give no case."""
    rows = read_manifests(spark, path, f"cases array<struct<{case}>>", multi_line)
    reason = F.when(F.col("manifest_reason") != "", F.col("manifest_reason")).when(F.size("cases") == 0, "no_cases").otherwise("")
    return rows.select("file", reason.alias("reason")).where("reason <> ''")


def runs_with_defaults(suites: DataFrame) -> DataFrame:
    """(suite, at, name, settings): each run's own settings over the suite's defaults; unnamed runs get their number.

    ``suites``: suite, defaults (map), runs (array of maps).
    """
    rows = suites.select("suite", "defaults", F.posexplode("runs").alias("at", "run"))
    kept = F.map_filter("defaults", lambda k, v: ~F.map_contains_key("run", k))
    rows = rows.withColumn("settings", F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), "run"))
    name = F.coalesce(F.nullif(F.try_element_at("settings", F.lit("name")), F.lit("")), F.concat(F.lit("run_"), (F.col("at") + 1).cast("string")))
    return rows.select("suite", "at", name.alias("name"), "settings")


def flatten_inventory(trees: DataFrame, items: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repo, path, kind, size, origin) of four shapes: tree entries, search items, plain files, repositories with path lists."""
    t = trees.select("repo", F.explode("tree").alias("e")).select("repo", "e.path", F.col("e.type").alias("kind"), "e.size").withColumn("origin", F.lit("tree"))
    i = items.select("repo", F.col("path"), F.lit("blob").alias("kind"), F.col("size")).withColumn("origin", F.lit("items"))
    f = files.select("repo", "path").withColumn("origin", F.lit("files"))
    r = repositories.select("repo", F.explode("paths").alias("path")).withColumn("origin", F.lit("repositories"))
    return t.unionByName(i).unionByName(f, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)


def with_reasons(rows: DataFrame, include: str = r"\.py$", exclude: str = r"(^|/)(vendor|build)/") -> DataFrame:
    """Rows with ``reason``: the first rule they fail, empty for accepted ones. All rows stay."""
    p = F.coalesce("path", F.lit(""))
    bad = (p == "") | p.startswith("/") | F.array_contains(F.split(p, "/"), "..")
    reason = (F.when(bad, "missing_or_unsafe_source_path").when(F.coalesce("kind", F.lit("blob")) != "blob", "not_blob").when(~p.rlike(include), "not_included")
              .when(p.rlike(exclude), "excluded").when(F.coalesce("repo", F.lit("")) == "", "missing_owner_repo_ref").otherwise(""))
    return rows.withColumn("reason", reason)


def collision_free(rows: DataFrame, by: str, target: str, order: list[str]) -> DataFrame:
    """Rows with ``unique_target``: the second and later rows of a target get _2, _3, ... before the suffix."""
    n = F.row_number().over(Window.partitionBy(by, target).orderBy(*order))
    stem, suffix = F.regexp_extract(target, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(target, r"^(.*?)(\.[^./]*)?$", 2)
    return rows.withColumn("_n", n).withColumn("unique_target", F.when(F.col("_n") == 1, F.col(target)).otherwise(F.concat(stem, F.lit("_"), "_n", suffix))).drop("_n")


def unnest_attempts(cases: DataFrame, array: str, key: str) -> DataFrame:
    """A row for each element of an array of structs, with its rank from 1."""
    return cases.select(key, F.posexplode(array).alias("at", "a")).select(key, (F.col("at") + 1).alias("rank"), "a.*")


def repo_profile(files: DataFrame) -> DataFrame:
    """Per repository: files, source files and share, tests, configuration files, packages, top ten folders with counts.

    ``files``: repo, path, reason (empty: imported).
    """
    p = F.col("path")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.when(p.contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    imported = F.col("reason") == ""
    sums = files.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum(imported.cast("int")).alias("imported"), F.sum(p.rlike(r"(^|/)tests?/|(^|/)test_").cast("int")).alias("tests"),
        F.sum(name.isin("setup.py", "setup.cfg", "pyproject.toml", "tox.ini").cast("int")).alias("config"), F.sum((name == "__init__.py").cast("int")).alias("packages"),
        F.countDistinct(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extensions"))
    each = files.groupBy("repo", folder.alias("folder")).agg(F.count("*").alias("n"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "folder"))).where("r <= 10")
    top = top.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "folder", "n"))), lambda x: F.concat_ws(":", x["folder"], x["n"])).alias("folders"))
    return sums.join(top, "repo").withColumn("source_ratio", F.col("imported") / F.greatest(F.lit(1), "files"))


def prefix_pick(packages: DataFrame) -> DataFrame:
    """(repo, prefix): the only src-layout package, else the only root that isn't auxiliary, else empty. ``packages``: repo, root, src_layout."""
    aux = F.col("root").isin("tests", "test", "docs", "doc", "examples", "tools", "scripts")
    g = packages.groupBy("repo").agg(F.collect_set(F.when(F.col("src_layout"), F.col("root"))).alias("s"), F.collect_set(F.when(~F.col("src_layout") & ~aux, F.col("root"))).alias("r"))
    return g.select("repo", F.when(F.size("s") == 1, F.concat(F.lit("src/"), F.get("s", F.lit(0)))).when(F.size("r") == 1, F.get("r", F.lit(0))).otherwise("").alias("prefix"))
