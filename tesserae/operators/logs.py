"""Log evidence: text lines to tests, frames, failure classes and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shaped(text: Column, shape: Callable[[Column], Column]) -> Column:
    """A row for what ``shape`` gives for a text, none for null; a filter on it doesn't work it out again."""
    return F.explode(F.filter(F.transform(F.array(text), shape), lambda x: x.isNotNull()))


def _group(text: Column, pattern: str, n: int) -> Column:
    """A group of the pattern (never an empty one), null where it doesn't match."""
    return _let(F.regexp_extract(text, pattern, n), lambda x: F.when(x != "", x))


def _source_free() -> Column:
    return F.regexp_replace(F.trim("text"), _SOURCE, "")


# parameters in brackets may hold blanks, dashes and brackets of their own
_NODE = r"[^\s:]+\.py(?:::[^\s\[]+)+(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\])?"
_SOURCE = r"^\[(stdout|stderr)\]\s+"
_UNITTEST = r"^(FAIL|ERROR):\s+([A-Za-z_]\w*)\s+\(([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\)"


def failing_tests(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, nodeid, path, test): of three shapes the first that a line has.

    ``FAILED <node>`` (with a reason or a note that a command was scoped to the
    node), ``<node> FAILED`` and ``FAIL: method (module.Class.method)``. A
    source in brackets before the line doesn't count.
    """
    def unit(t: Column) -> Column:
        def named(parts: Column, method: Column) -> Column:
            n = F.size(parts)
            in_class = (n >= 3) & F.get(parts, n - 2).rlike("^[A-Z]")
            module = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), n - F.when(in_class, 2).otherwise(1))), "/")
            last = F.get(parts, n - 1)
            return F.when(last == method, F.concat(module, F.lit(".py::"), F.when(in_class, F.concat(F.get(parts, n - 2), F.lit("::"))).otherwise(""), last))

        dotted = _let(_group(t, _UNITTEST, 3), lambda d: F.split(d, r"\."))
        return F.when(t.startswith("FAIL:") | t.startswith("ERROR:"), _let(dotted, lambda parts: named(parts, F.regexp_extract(t, _UNITTEST, 2))))

    def node(t: Column) -> Column:
        first = F.when(t.startswith("FAILED "), _group(t, rf"^FAILED ({_NODE})(?: - .*| \(nodeid-scoped [^()]*\))?$", 1))
        return F.coalesce(first, F.when(t.contains(" FAILED"), _group(t, rf"^({_NODE}) FAILED", 1)), unit(t))

    some = F.col("text").contains("FAIL") | F.col("text").contains("ERROR:")
    rows = lines.where(some).select("run_id", "line_no", _shaped(_source_free(), node).alias("nodeid"))
    return rows.select("run_id", "line_no", "nodeid", F.substring_index("nodeid", "::", 1).alias("path"), F.regexp_replace(F.substring_index("nodeid", "::", -1), r"\[.*$", "").alias("test"))


_PYTHON = r'^File "([^"]+\.py)", line (\d+), in ([A-Za-z_]\w*)'
_PYTEST = r"^([^:\s][^:]*\.py):(\d+):\s+in\s+([A-Za-z_]\w*)"


def frames(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, path, line, function, format) of traceback lines of two shapes."""
    def shape(t: Column) -> Column:
        one = lambda pattern, name: F.when(t.rlike(pattern), F.struct(
            F.regexp_extract(t, pattern, 1).alias("path"), F.regexp_extract(t, pattern, 2).cast("int").alias("line"), F.regexp_extract(t, pattern, 3).alias("function"), F.lit(name).alias("format")))
        return F.coalesce(one(_PYTHON, "python_traceback"), one(_PYTEST, "pytest"))

    rows = lines.where(F.col("text").contains(".py") & F.col("text").contains("in "))
    return rows.select("run_id", "line_no", _shaped(_source_free(), shape).alias("f")).select("run_id", "line_no", "f.*")


def failure_class(output: str = "output") -> Column:
    """Class of an attempt from success, timeout, output, failed and returncode; the first rule that fits."""
    t = F.lower(F.coalesce(output, F.lit("")))
    has = t.contains
    return (
        F.when(F.col("success"), "success").when(F.col("timeout"), "timeout")
        .when(has("safety_gate_blocked") | has("blocked by safety gate"), "safety_gate_blocked")
        .when(has("patch target does not exist") | has("original source block not found"), "patch_apply_error").when(has("syntaxerror"), "syntax_error")
        .when(has("importerror") | has("modulenotfounderror"), "import_error").when(has("attributeerror"), "attribute_error").when(has("typeerror"), "type_error")
        .when(has("assertionerror") | (F.col("failed") > 0), "test_failure").when(has("traceback") | ~F.col("returncode").isin(0, -1), "runtime_error")
        .when(F.col("returncode") == -1, "execution_error").otherwise("unknown_failure"))


RUNNERS = ("pytest", "nose", "tox", "nox")


def run_diagnosis(output: str = "output") -> list[Column]:
    """category and signal of a run; the first rule that fits. Needs success and returncode."""
    t = F.lower(F.coalesce(output, F.lit("")))
    has = t.contains
    module = F.when(F.col(output).rlike("No module named '?([A-Za-z0-9_.]+)"), F.regexp_extract(output, "No module named '?([A-Za-z0-9_.]+)", 1))
    fixture = F.when(F.col(output).rlike("fixture '([^']+)' not found"), F.regexp_extract(output, "fixture '([^']+)' not found", 1))
    rules = [
        (F.col("success"), "none", F.lit("")),
        (module.isin(*RUNNERS), "missing_test_runner", F.concat(F.lit("missing_runner:"), module)),
        (module.isNotNull(), "missing_dependency", F.concat(F.lit("missing_module:"), module)),
        (fixture.isNotNull(), "missing_pytest_fixture", F.concat(F.lit("missing_fixture:"), fixture)),
        (has("syntaxerror:") | has("indentationerror:"), "syntax_error", F.col(output)),
        (has("import file mismatch"), "import_path_error", F.col(output)),
        (has("django_settings_module") | has("improperlyconfigured"), "framework_configuration_error", F.col(output)),
        (has("pytestwarning"), "pytest_warning_as_error", F.col(output)),
        (has("error collecting") | has("importerror while importing test module"), "pytest_collection_error", F.col(output)),
        (has("no tests ran") | has("collected 0 items"), "no_tests_collected", F.col(output)),
        (has("error: usage:") | has("unrecognized arguments"), "command_usage_error", F.col(output)),
        (has("could not find python interpreter") | has("interpreternotfound"), "tox_missing_python_interpreter", F.col(output)),
        (has("assertionerror") | t.rlike("[0-9]+ failed"), "test_assertion_failure", F.col(output)),
    ]
    category, signal = F.lit("command_failed"), F.concat(F.lit("returncode:"), F.col("returncode").cast("string"))
    for fits, name, sign in reversed(rules):
        fits = F.coalesce(fits, F.lit(False))
        category, signal = F.when(fits, name).otherwise(category), F.when(fits, sign).otherwise(signal)
    return [category.alias("category"), signal.alias("signal")]


def test_counts(output: str = "output") -> list[Column]:
    """passed, failed, skipped and total: sums of all ``N passed`` and the like; else the ``Ran N tests`` shape, all passed."""
    t = F.lower(F.coalesce(output, F.lit("")))

    def total(word: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"(^|[^a-z0-9])([0-9]+)\s+{word}\b"), F.lit(2))
        return F.aggregate(found, F.lit(0), lambda acc, x: acc + x.cast("int"))

    passed, failed, skipped = total("passed"), total("failed") + total("errors?"), total("skipped")
    some = passed + failed + skipped > 0
    ran = F.when(t.rlike(r"(^|\n)\s*ran ([0-9]+) tests? in"), F.regexp_extract(t, r"(^|\n)\s*ran ([0-9]+) tests? in", 2).try_cast("int"))
    return [F.when(some, passed).otherwise(F.coalesce(ran, F.lit(0))).alias("passed"), failed.alias("failed"), skipped.alias("skipped"),
            F.when(some, passed + failed + skipped).otherwise(F.coalesce(ran, F.lit(0))).alias("total")]


#: Fixed value: the blanks of Unicode's category Zs.
_BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def failure_line(*columns: str, limit: int = 120) -> Column:
    """First non-blank line of the given texts in order, without blanks at its ends, cut to the limit with dots."""
    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in columns])
    # a lambda: transform would hand a line's number to trim as the characters to take away
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_BLANKS)))
    first = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when(F.length(first) <= limit, first).otherwise(F.concat(F.substring(first, 1, limit - 3), F.lit("...")))


def evidence_level(status: Column, category: Column, present: Column, executed: Column) -> Column:
    return (
        F.when(~present, "none").when(~executed, "not_executed").when(status == "pass", "passing_tests").when(category == "test_assertion_failure", "failing_tests")
        .when(category.isin("missing_dependency", "missing_pytest_fixture", "command_usage_error", "pytest_warning_as_error"), "environment_failure")
        .when(category.isin("pytest_collection_error", "syntax_error", "no_tests_collected"), "collection_failure").when(category == "timeout", "timeout").otherwise("unknown_failure"))


def best_execution(rows: DataFrame, by: str) -> DataFrame:
    """One row of each ``by``: an executed assertion failure (a retry first), else any executed one (a retry first), else the planned one.

    ``rows``: retry, executed, category, ordinal.
    """
    fails = F.col("executed") & (F.col("category") == "test_assertion_failure")
    tier = F.when(fails & F.col("retry"), 0).when(fails, 1).when(F.col("executed") & F.col("retry"), 2).when(F.col("executed"), 3).when(~F.col("retry"), 4).otherwise(5)
    w = Window.partitionBy(by).orderBy("_tier", "ordinal")
    return rows.withColumn("_tier", tier).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_tier")


def _base(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _ends(x: str, by: str) -> Column:
    """All ends of a text that begin behind ``by``, and the text itself."""
    parts = F.split(x, f"[{by}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), by))


def _met(left: DataFrame, right: DataFrame, keys: list[tuple], by: list[str]) -> DataFrame:
    """Pairs of rows that share a (kind, value) of ``keys``: (kind, array of left, array of right)."""
    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def filed(rows: DataFrame, side: int) -> DataFrame:
        return rows.withColumn("_k", F.explode(F.flatten(F.array(*[named(k[0], k[side]) for k in keys])))).select("*", "_k.*").drop("_k")

    # explode makes more rows than the planner reckons with, so neither side is sent to all executors
    return filed(left, 1).join(filed(right, 2).hint("shuffle_merge"), ["kind", "value", *by]).drop("kind", "value")


def _kinds(entities: DataFrame, features: list[str]) -> DataFrame:
    """The first entity of each combination of what points are given for: ties go to it, so no other can be an answer.

    Stored: the planner would take the rows after explode for as few as the file's bytes, and send them all to every executor.
    """
    return stored(entities.groupBy(*features).agg(F.min("entity").alias("entity")), "entities")


def match_tests(tests: DataFrame, entities: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(nodeid, entity, score): best entity of a test in a file of the same base name.

    4 for the qualified name, 3 for its end, 2 for the leaf name, 1 for the path; ties by entity.
    ``tests``: nodeid, path, test, qualified; ``entities``: entity, path, name, qualified;
    ``by`` names columns of both that must agree, such as a repository.

    A base name such as __init__.py is shared by very many files, so rows meet
    by base name and what gives points, and of entities alike in all of it only
    the first is looked at. Of a file whose path alone matches only
    the first entity can be the answer, so one row a file stands for it.
    """
    keys = list(by)
    t = tests.select(*keys, "nodeid", F.col("path").alias("t_path"), "test", F.col("qualified").alias("t_qualified")).distinct()
    t = stored(t, "distinct-tests")  # read twice
    e = _kinds(entities, [*keys, "path", "name", "qualified"])
    first = e.groupBy(*keys, "path").agg(F.min_by(F.struct("entity", "name", "qualified"), "entity").alias("_f")).select(*keys, "path", "_f.*")
    at = lambda base, values: F.transform(values, lambda v: F.concat(base, F.lit("\n"), v))
    t_base, base = _base("t_path"), _base("path")
    named = _met(t, e, [
        ("name", at(t_base, F.array("test")), at(base, F.array("name"))),
        ("qualified", at(t_base, F.array("t_qualified")), at(base, _ends("qualified", ".")))], keys)
    filed = _met(t, first, [("in", _ends("t_path", "/"), F.array("path")), ("out", F.array("t_path"), _ends("path", "/"))], keys)
    same = (F.col("t_path") == F.col("path")) | F.col("t_path").endswith(F.concat(F.lit("/"), F.col("path"))) | F.col("path").endswith(F.concat(F.lit("/"), F.col("t_path")))
    score = (F.when(F.col("qualified") == F.col("t_qualified"), 4).otherwise(0) + F.when(F.col("qualified").endswith(F.concat(F.lit("."), F.col("t_qualified"))), 3).otherwise(0)
             + F.when(F.col("name") == F.col("test"), 2).otherwise(0) + F.when(same, 1).otherwise(0))
    m = named.unionByName(filed).where(_base("t_path") == _base("path")).withColumn("score", score).where("score > 0")
    return m.groupBy(*keys, "nodeid").agg(F.max("score").alias("score"), F.min_by("entity", F.struct(-F.col("score"), F.col("entity"))).alias("entity"))


def match_frames(frames_: DataFrame, entities: DataFrame, by: tuple[str, ...] = (), lines: int = 64) -> DataFrame:
    """(path, line, function, entity, score): best entity of a frame in a file of the same base name, with more than 1 point.

    8 for the line inside, 4 for the name, 2 for the end of the qualified name, 1 for the path; ties by entity.
    ``by`` names columns of both that must agree, such as a repository.

    Of entities alike in all of these only the first is looked at. Rows meet by
    base name and name, or base name and end of the qualified name. Where only
    the line (or the line and the path) gives points, the first entity around the line is the answer, so it is found once for each
    distinct line of a base name (or of a path), by blocks of lines.
    """
    keys = list(by)
    # stored, as it is read several times below; the regular expressions run once
    f = stored(frames_.select(*keys, F.col("path").alias("f_path"), "line", "function").distinct(), "distinct-frames")
    e = _kinds(entities.withColumnRenamed("path", "e_path"), [*keys, "e_path", "name", "qualified", "start_line", "end_line"])
    at = lambda base, values: F.transform(values, lambda v: F.concat(base, F.lit("\n"), v))
    named = _met(f, e, [
        ("name", at(_base("f_path"), F.array("function")), at(_base("e_path"), F.array("name"))),
        ("qualified", at(_base("f_path"), F.array("function")), at(_base("e_path"), _ends("qualified", ".")))], keys)

    def around(spots: DataFrame, where: list[str], place: Column) -> DataFrame:
        """The first entity around each spot (where, line), with its columns."""
        block = F.sequence(F.floor(F.col("start_line") / lines), F.floor(F.col("end_line") / lines))
        filed = e.where("start_line <= end_line").withColumn("_w", place).select("*", F.explode(block).alias("_b"))
        met = spots.withColumn("_b", F.floor(F.col("line") / lines)).join(filed.withColumnRenamed("_w", where[-1]), [*where, "_b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
        own = ["entity", "e_path", "name", "qualified", "start_line", "end_line"]
        return met.groupBy(*where, "line").agg(F.min_by(F.struct(*own), "entity").alias("_e")).select(*where, "line", "_e.*")

    by_base = f.withColumn("_base", _base("f_path"))
    spots = by_base.select(*keys, "_base", "line").distinct()
    in_base = by_base.join(around(spots, [*keys, "_base"], _base("e_path")), [*keys, "_base", "line"]).drop("_base")
    # the ends of a frame's path, one of which is the entity's path
    ended = f.withColumn("_end", F.explode(_ends("f_path", "/")))
    in_path = ended.join(around(ended.select(*keys, "_end", "line").distinct(), [*keys, "_end"], F.col("e_path")), [*keys, "_end", "line"]).drop("_end")
    score = (F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), 8).otherwise(0) + F.when(F.col("name") == F.col("function"), 4).otherwise(0)
             + F.when(F.col("qualified").endswith(F.concat(F.lit("."), F.col("function"))), 2).otherwise(0)
             + F.when((F.col("f_path") == F.col("e_path")) | F.col("f_path").endswith(F.concat(F.lit("/"), F.col("e_path"))), 1).otherwise(0))
    m = named.unionByName(in_base).unionByName(in_path).withColumn("score", score).where("score > 1").withColumnRenamed("f_path", "path")
    return m.groupBy(*keys, "path", "line", "function").agg(F.max("score").alias("score"), F.min_by("entity", F.struct(-F.col("score"), F.col("entity"))).alias("entity"))


def evidence_spectrum(tests: DataFrame, matches: DataFrame, framed: DataFrame) -> DataFrame:
    """(run_id, test, entity): what the failing tests of a run cover.

    A matched test covers its target; every failing test of a run covers the
    entities of the run's frames; a run with frames and no failing test gets
    one made-up test. ``tests``: run_id, nodeid; ``matches``: nodeid, entity; ``framed``: run_id, entity.
    """
    t = tests.select("run_id", F.col("nodeid").alias("test")).distinct()
    direct = t.join(matches.select(F.col("nodeid").alias("test"), "entity"), "test").select("run_id", "test", "entity")
    f = framed.select("run_id", "entity").distinct()
    by_frame = f.join(t, "run_id", "left").select("run_id", F.coalesce("test", F.lit("synthetic::failure")).alias("test"), "entity")
    return direct.unionByName(by_frame).distinct()


def evidence_counts(tests: DataFrame, matches: DataFrame, framed: DataFrame) -> DataFrame:
    """(run_id, n, tests, entities): rows, distinct tests and distinct entities of ``evidence_spectrum``, a row for each run that has any.

    Every test of a run covers all entities of its frames, so their pairs are counted, not
    made: tests times entities, and the matched targets that no frame names.
    """
    item = lambda entity, framed, tests, aiming, aimed: F.struct(
        entity.alias("entity"), F.lit(framed).alias("framed"), F.lit(tests).alias("tests"), aiming.alias("aiming"), F.lit(aimed).alias("aimed"))
    kind = dict(framed.dtypes)["entity"]
    targets = matches.groupBy(F.col("nodeid").alias("test")).agg(F.collect_set("entity").alias("targets"))
    t = tests.select("run_id", F.col("nodeid").alias("test")).distinct().join(targets, "test", "left")
    own = item(F.lit(None).cast(kind), 0, 1, F.col("targets").isNotNull().cast("int"), 0)
    aims = F.transform(F.coalesce("targets", F.array().cast(f"array<{kind}>")), lambda e: item(e, 0, 0, F.lit(0), 1))
    rows = t.select("run_id", F.explode(F.concat(F.array(own), aims)).alias("i")).select("run_id", "i.*").unionByName(
        framed.select("run_id", item(F.col("entity"), 1, 0, F.lit(0), 0).alias("i")).select("run_id", "i.*"))
    by_entity = rows.groupBy("run_id", "entity").agg(F.max("framed").alias("framed"), *[F.sum(c).alias(c) for c in ("tests", "aiming", "aimed")])
    by_run = by_entity.groupBy("run_id").agg(
        F.sum("framed").alias("framed"), F.sum("tests").alias("all"), F.sum("aiming").alias("aiming"),
        F.sum(F.when(F.col("framed") == 0, F.col("aimed")).otherwise(0)).alias("outside"), F.count("entity").alias("entities"))
    # a run with frames and no failing test has a made-up one
    tests_ = F.when(F.col("framed") > 0, F.greatest("all", F.lit(1))).otherwise(F.col("aiming"))
    n = F.col("framed") * F.greatest("all", F.lit(1)) + F.col("outside")
    return by_run.select("run_id", n.alias("n"), tests_.alias("tests"), "entities").where("n > 0")


def pattern_score(text: str) -> Column:
    """Additive weights of what a source text shows."""
    t = F.lower(F.coalesce(text, F.lit("")))
    flat = F.replace(t, F.lit(" "), F.lit(""))
    has = t.contains
    guarded = flat.contains("ifnot") | flat.contains("==0") | flat.contains("<=0") | has("raise valueerror") | has("raise statisticserror")
    add = lambda c, n: F.when(c, n).otherwise(0)
    divides = has("len(") & (has("/") | has("%"))
    raised = has("traceback (most recent call last)") & (has("zerodivisionerror") | has("indexerror") | has("keyerror") | has("valueerror"))
    return (add(divides, 80) + add(divides & guarded, -40) + add(divides & ~guarded, 70) + add(has(".sort(") & has("="), 60)
            + add(has("range(") & (has("[i +") | has("[index +")), 70) + add(~has(".get(") & has("[") & has("key"), 30)
            + add(has("except exception") | has("except:"), 50) + add(raised, 220) + add(has("\ndef test_"), -90))


def scan_rules(lines: DataFrame, rules: list[tuple[str, str, str, float]], text: str = "line") -> DataFrame:
    """Lines with rule_id, bug_type, confidence for each rule (id, pattern, type, confidence) that they match.

    The rules are literals of the plan, so each line is read once and no pairs are made.
    """
    hits = F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(b).alias("bug_type"), F.lit(c).alias("confidence"))) for i, p, b, c in rules])
    return lines.withColumn("_hit", F.explode(F.filter(hits, lambda x: x.isNotNull()))).select(*lines.columns, "_hit.*")
