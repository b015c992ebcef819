"""What tools report, as rows: test results, diagnostics, changed files, commits, matches, sizes, crashes.

Every reader takes ``lines(run_id, pos, line)`` of its tool's runs and reads them with patterns and window functions over
one partitioning by run. Null lines and lines of other shapes give no row; a run without any gives none. Repeated rows of
one position count twice. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("run_id",)


def group(pattern: str, i: int, line: Column | None = None) -> Column:
    return F.regexp_extract(F.col("line") if line is None else line, pattern, i)


def number(text: Column) -> Column:
    """A whole number, null where there is none."""
    return F.try_to_number(F.nullif(text, F.lit("")), F.lit("999999999999")).cast("long")


def parsed(lines: DataFrame, pattern: str, names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos and the pattern's groups of the lines that it matches."""
    return lines.where(F.col("line").rlike(pattern)).select(*keys, "pos", *[group(pattern, i).alias(n) for i, n in enumerate(names, 1)])


def blocks(lines: DataFrame, starts: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """``block``: how many starts there were up to a line of its run; ``head``: the block's first line."""
    w = Window.partitionBy(*keys).orderBy("pos")
    marked = lines.where("line is not null").withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))
    return marked.withColumn("head", F.first("line").over(Window.partitionBy(*keys, "block").orderBy("pos")))


def body(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """A block's lines in order, joined by line ends."""
    held = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias(name))


# --- go test

GO_VERDICT = r"^(ok|FAIL|\?)\s+(\S+)(?:\s+(.*))?$"
GO_TEST = r"^\s*--- (PASS|FAIL|SKIP): (\S+) \(([0-9.]+)s\)"


def go_test_summary(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, packages ok, failed and without tests, tests passed, failed and skipped."""
    line = F.col("line")
    kind, state = group(GO_VERDICT, 1), group(GO_TEST, 1)
    seen = lines.where(line.rlike(GO_VERDICT) | line.rlike(GO_TEST))
    return seen.groupBy(*keys).agg(
        F.count_if(kind == "ok").alias("n_ok"),
        F.count_if(kind == "FAIL").alias("n_fail"),
        F.count_if(kind == "?").alias("n_without"),
        F.count_if(state == "PASS").alias("n_passed"),
        F.count_if(state == "FAIL").alias("n_failed"),
        F.count_if(state == "SKIP").alias("n_skipped"),
    )


def go_test_failures(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, test, package, output: failed tests with the indented lines after them; the package is the next verdict's."""
    after = Window.partitionBy(*keys).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    verdict = F.when(F.col("line").rlike(GO_VERDICT), group(GO_VERDICT, 2))
    rows = lines.withColumn("package", F.first(verdict, ignorenulls=True).over(after))
    rows = blocks(rows, ~F.col("line").rlike(r"^\s+\S") | F.col("line").rlike(GO_TEST), keys)
    rows = rows.where(F.col("head").rlike(GO_TEST) & (group(GO_TEST, 1, F.col("head")) == "FAIL"))
    first = rows.groupBy(*keys, "block").agg(
        F.min("pos").alias("pos"), F.min(group(GO_TEST, 2, F.col("head"))).alias("test"), F.min_by("package", "pos").alias("package")
    )
    said = body(rows.where(F.col("line") != F.col("head")), [*keys, "block"], "output")
    return first.join(said, [*keys, "block"], "left").select(*keys, "pos", "test", "package", F.coalesce("output", F.lit("")).alias("output"))


# --- pytest

PYTEST_SHORT = r"^(FAILED|ERROR) (\S+?)(?:::(\S+))?(?: - (.*))?$"
PYTEST_END = r"^=+ (?=.*\d+ (?:passed|failed|errors?|skipped|warnings?))(.*) in [0-9.]+s"


def pytest_summary(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, n_passed, n_failed, n_errors, n_skipped by the last line of results of each run."""
    ends = lines.where(F.col("line").rlike(PYTEST_END))
    last = ends.groupBy(*keys).agg(F.max_by("line", "pos").alias("line"))
    n = lambda word: F.coalesce(number(group(rf"(\d+) {word}", 1)), F.lit(0)).cast("long")
    return last.select(*keys, n("passed").alias("n_passed"), n("failed").alias("n_failed"), n("error").alias("n_errors"), n("skipped").alias("n_skipped"))


def pytest_failures(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, state, file, test, message of the short summary."""
    return parsed(lines, PYTEST_SHORT, ["state", "file", "test", "message"], keys)


# --- git

GIT_AREAS = {
    "staged": r"^Changes to be committed:",
    "unstaged": r"^Changes not staged for commit:",
    "untracked": r"^Untracked files:",
    "unmerged": r"^Unmerged paths:",
}
GIT_ENTRY = r"^\t(?:(new file|modified|deleted|renamed|copied|typechange|both modified|both added|deleted by us|deleted by them):\s+)?(.+)$"


def git_status(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, area, state, path, source of each entry: its section is the last heading's; a rename has its source."""
    heading = F.lit(None).cast("string")
    for area, pattern in GIT_AREAS.items():
        heading = F.when(F.col("line").rlike(pattern), area).otherwise(heading)
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = lines.withColumn("area", F.last(heading, ignorenulls=True).over(w)).where(F.col("line").rlike(GIT_ENTRY) & F.col("area").isNotNull())
    both = F.split(group(GIT_ENTRY, 2), " -> ")
    state = F.when(group(GIT_ENTRY, 1) == "", F.col("area")).otherwise(group(GIT_ENTRY, 1))
    return rows.select(
        *keys, "pos", "area", state.alias("state"), F.element_at(both, -1).alias("path"), F.when(F.size(both) > 1, both[0]).alias("source")
    )


def git_diff(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, file, kind, n_hunks, n_added, n_removed of each file of a diff."""
    rows = blocks(lines, F.col("line").rlike("^diff --git "), keys).where(F.col("block") > 0)
    line = F.col("line")
    # a file's head ends at its first hunk: its +++ and --- are no changes
    hunk = F.sum(F.when(line.rlike("^@@ "), 1).otherwise(0)).over(Window.partitionBy(*keys, "block").orderBy("pos"))
    rows = rows.withColumn("hunk", hunk)
    seen = lambda p: F.max((F.col("hunk") == 0) & line.rlike(p))
    out = rows.groupBy(*keys, "block").agg(
        F.min(F.regexp_extract("head", r" b/(.*)$", 1)).alias("file"),
        F.when(seen("^new file mode"), "new").when(seen("^deleted file mode"), "deleted").when(seen("^rename to "), "renamed")
        .when(seen("^Binary files "), "binary").otherwise("changed").alias("kind"),
        F.max("hunk").cast("long").alias("n_hunks"),
        F.count_if((F.col("hunk") > 0) & line.startswith("+")).alias("n_added"),
        F.count_if((F.col("hunk") > 0) & line.startswith("-")).alias("n_removed"),
    )
    return out.drop("block")


def git_log(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, sha, author, subject, n_lines (of the message) of each commit."""
    rows = blocks(lines, F.col("line").rlike("^commit [0-9a-f]{7,40}"), keys).where(F.col("block") > 0)
    line = F.col("line")
    said = line.rlike(r"^    \S")
    return rows.groupBy(*keys, "block").agg(
        F.min("pos").alias("pos"),
        F.min(F.regexp_extract("head", "^commit ([0-9a-f]+)", 1)).alias("sha"),
        F.max(F.when(line.rlike("^Author:"), F.regexp_extract("line", r"^Author:\s+(.*?) <", 1))).alias("author"),
        F.min_by(F.when(said, F.substring("line", 5, 1 << 20)), F.when(said, F.col("pos"))).alias("subject"),
        F.count_if(said).alias("n_lines"),
    ).drop("block")


# --- diagnostics

TSC = r"^(\S+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$"
CC = r"^([^\s:]+):(\d+):(\d+): (fatal error|error|warning|note): (.*)$"
ESLINT_FILE = r"^(?:/|[A-Za-z]:\\|\.{0,2}/?\w)[^:]*\.[A-Za-z]+$"
ESLINT = r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.*?)\s{2,}(\S+)$"


def tsc(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, file, at_line, at_column, severity, code, message."""
    return numbered(parsed(lines, TSC, ["file", "at_line", "at_column", "severity", "code", "message"], keys))


def cc(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, file, at_line, at_column, severity, message of compilers, and of build tools that run them."""
    return numbered(parsed(lines, CC, ["file", "at_line", "at_column", "severity", "message"], keys))


def eslint(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, file, at_line, at_column, severity, message, rule; the file is the last heading's."""
    w = Window.partitionBy(*keys).orderBy("pos")
    file = F.last(F.when(F.col("line").rlike(ESLINT_FILE), F.col("line")), ignorenulls=True).over(w)
    rows = parsed(lines.withColumn("file", file), ESLINT, ["at_line", "at_column", "severity", "message", "rule"], (*keys, "file"))
    return numbered(rows.select(*keys, "pos", "file", "at_line", "at_column", "severity", "message", "rule"))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at_line", number(F.col("at_line"))).withColumn("at_column", number(F.col("at_column")))


def by_kind(found: DataFrame, kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, ``kind``, severity, n, n_files, example (the first's message): diagnostics regrouped, the most frequent first to tell."""
    return found.groupBy(*keys, kind, "severity").agg(
        F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.min_by("message", "pos").alias("example")
    )


# --- search, sizes, crashes

SEARCH = r"^([^\s:][^:]*?)[:-](\d+)[:-](.*)$"


def search(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, file, at_line, hit (false: a context line), text."""
    rows = lines.where(F.col("line").rlike(SEARCH) & ~F.col("line").rlike("^--$"))
    hit = F.col("line").rlike(r"^[^\s:][^:]*?:\d+:")
    return rows.select(
        *keys, "pos", group(SEARCH, 1).alias("file"), number(group(SEARCH, 2)).alias("at_line"), hit.alias("hit"), group(SEARCH, 3).alias("text")
    )


def search_files(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, directory, n_files, n_hits of matches."""
    directory = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    return found.where("hit").groupBy(*keys, directory.alias("directory")).agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_hits"))


DU = r"^([0-9.]+)([BKMGTP]?)\t(.+)$"


def du(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, path, bytes: sizes as printed, in blocks of 1,024 bytes where they have no unit."""
    power = F.when(group(DU, 2) == "B", 0).when(group(DU, 2) == "", 1).otherwise(F.instr(F.lit("KMGTP"), group(DU, 2)))
    size = F.round(group(DU, 1).cast("double") * F.pow(F.lit(1024.0), power)).cast("long")
    return lines.where(F.col("line").rlike(DU)).select(*keys, "pos", group(DU, 3).alias("path"), size.alias("bytes"))


FRAME = r'^  File "(.+?)", line (\d+), in (.+)$'
RAISED = r"^([A-Za-z_][\w.]*(?:Error|Exception|Warning|Interrupt|Exit|Iteration))(?:: (.*))?$"


def tracebacks(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, error, message, n_frames, file, at_line, function: the last frame of each traceback that names its error."""
    rows = blocks(lines, F.col("line").rlike(r"^Traceback \(most recent call last\):"), keys).where(F.col("block") > 0)
    w = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__ended", F.coalesce(F.max(F.col("line").rlike(RAISED)).over(w), F.lit(False))).where("not __ended")
    frame, raised = F.col("line").rlike(FRAME), F.col("line").rlike(RAISED)
    last = F.max_by(F.when(frame, F.col("line")), F.when(frame, F.col("pos")))
    out = rows.groupBy(*keys, "block").agg(
        F.min("pos").alias("pos"), F.count_if(frame).alias("n_frames"), F.max(F.when(raised, F.col("line"))).alias("__r"), last.alias("__f")
    )
    return out.where("__r is not null").select(
        *keys, "pos", group(RAISED, 1, F.col("__r")).alias("error"), group(RAISED, 2, F.col("__r")).alias("message"), "n_frames",
        group(FRAME, 1, F.col("__f")).alias("file"), number(group(FRAME, 2, F.col("__f"))).alias("at_line"), group(FRAME, 3, F.col("__f")).alias("function"),
    )


# --- histories of lines, versions, events

BLAME = r"^(\^?[0-9a-f]{7,40}) (?:\S+ +)?\((.*?) +(\d{4}-\d{2}-\d{2}(?: [\d:]+ [+-]\d{4})?) +(\d+)\) ?(.*)$"


def blame_runs(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, sha, author, date, first_line, n_lines, is_first: neighbouring lines of one commit; ``is_first`` marks the
    commit's first stretch, where author and date are told."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = parsed(lines, BLAME, ["sha", "author", "date", "at_line"], keys)
    rows = rows.withColumn("__new", F.when(F.lag("sha").over(w) == F.col("sha"), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w)).withColumn("at_line", number(F.col("at_line")))
    out = rows.groupBy(*keys, "__run", "sha", "author", "date").agg(
        F.min("pos").alias("pos"), F.min("at_line").alias("first_line"), F.count("*").alias("n_lines")
    )
    first = F.min("pos").over(Window.partitionBy(*keys, "sha")) == F.col("pos")
    return out.select(*keys, "pos", "sha", "author", "date", "first_line", "n_lines", first.alias("is_first"))


LOCKED = r"^([+-])\s*(\S+) v?([0-9][^\s/]*)(?:/go\.mod)? (?:h1:\S+)$"


def lock_changes(lines: DataFrame, pattern: str = LOCKED, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, package, state (changed, added, removed), old, new: versions on removed against versions on added lines.

    A version on both sides didn't change. One version gone and one come are a change; others are told one by one."""
    rows = parsed(lines, pattern, ["side", "package", "version"], keys)
    both = rows.groupBy(*keys, "package", "version").agg(F.max(F.col("side") == "-").alias("__gone"), F.max(F.col("side") == "+").alias("__came"))
    both = both.where(F.col("__gone") != F.col("__came"))
    w = Window.partitionBy(*keys, "package")
    one = (F.count_if("__gone").over(w) == 1) & (F.count_if("__came").over(w) == 1)
    other = F.max(F.when(F.col("__gone"), F.col("version"))).over(w)
    both = both.withColumn("__one", one).withColumn("__old", other).where(~F.col("__one") | F.col("__came"))
    state = F.when(F.col("__one"), "changed").when(F.col("__came"), "added").otherwise("removed")
    old = F.when(F.col("__one"), F.col("__old")).when(F.col("__gone"), F.col("version"))
    return both.select(*keys, "package", state.alias("state"), old.alias("old"), F.when(F.col("__came"), F.col("version")).alias("new"))


EVENT = "struct<Action:string,Package:string,Test:string,Output:string,Elapsed:double>"


def go_test_events(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, package, test ('' for the package itself), state (the last of pass, fail and skip; 'unfinished' without one),
    output: the text of tests that failed or didn't finish, in order."""
    # the field names differ from others by case only in other schemas: they are read as they stand
    event = F.from_json("line", EVENT)
    rows = lines.where(F.col("line").startswith("{")).select(*keys, "pos", event.alias("e")).where("e.Action is not null and e.Package is not null")
    rows = rows.select(*keys, "pos", F.col("e.Action").alias("action"), F.col("e.Package").alias("package"),
                       F.coalesce("e.Test", F.lit("")).alias("test"), F.col("e.Output").alias("said"))
    by = [*keys, "package", "test"]
    ended = F.col("action").isin("pass", "fail", "skip")
    state = rows.groupBy(*by).agg(F.coalesce(F.max_by(F.when(ended, F.col("action")), F.when(ended, F.col("pos"))), F.lit("unfinished")).alias("state"))
    bad = state.where("state not in ('pass', 'skip')")
    held = F.array_sort(F.collect_list(F.struct("pos", "said")))
    said = rows.where("action = 'output'").join(bad.select(*by), by, "left_semi").groupBy(*by).agg(
        F.array_join(F.transform(held, lambda x: x["said"]), "").alias("output")
    )
    return state.join(said, by, "left").select(*by, "state", F.coalesce("output", F.lit("")).alias("output"))


def merged_events(events: DataFrame, keys: Sequence[str] = KEYS, most: int = 60, normal: int = 20) -> DataFrame:
    """Events (keys, pos, type, reason, object, message) with equal ones merged into the last: keys, pos, ..., n, shown.

    Where more than ``most`` stay, of the normal ones the last ``normal`` are shown; the others are for ``hidden_events``."""
    same = [*keys, "type", "reason", "object", "message"]
    rows = events.groupBy(*same).agg(F.max("pos").alias("pos"), F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    recent = F.row_number().over(Window.partitionBy(*keys, "type").orderBy(F.desc("pos")))
    shown = (F.count("*").over(whole) <= most) | (F.col("type") != "Normal") | (recent <= normal)
    return rows.withColumn("shown", shown)


def hidden_events(merged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, n, summary: events that aren't shown by reason, each with its whole number, the most frequent first."""
    by = merged.where("not shown").groupBy(*keys, "reason").agg(F.sum("n").alias("k"))
    held = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col("reason").alias("r"))))
    told = F.array_join(F.transform(held, lambda x: F.concat(x["r"], F.lit(" "), (-x["k"]).cast("string"))), ", ")
    return by.groupBy(*keys).agg(F.sum("k").alias("n"), told.alias("summary"))


def last_refresh(lines: DataFrame, heading: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The lines from the last one that ``heading`` matches, with ``n_refreshes``; runs without one give none."""
    rows = blocks(lines, F.col("line").rlike(heading), keys).where("block > 0")
    rows = rows.withColumn("n_refreshes", F.max("block").over(Window.partitionBy(*keys)))
    return rows.where("block = n_refreshes").select(*keys, "pos", "line", "n_refreshes")


KLOG = r"^([IWEF])\d{4} \d{2}:\d{2}:\d{2}\.\d{6}\s+\d+ \S+:\d+\] "


def tagged_klog(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lines of runs most of whose lines begin with a klog head, with the level before it in brackets; others as they are."""
    is_klog = F.col("line").rlike(KLOG)
    whole = Window.partitionBy(*keys)
    rows = lines.withColumn("__most", F.count_if(is_klog).over(whole) * 2 > F.count("*").over(whole))
    line = F.when(F.col("__most") & is_klog, F.concat(F.lit("["), group(KLOG, 1), F.lit("] "), "line")).otherwise(F.col("line"))
    return rows.withColumn("line", line).drop("__most")


COVERAGE = r"^\s*(\S.*?)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)\s*\|"


def low_coverage(lines: DataFrame, below: float = 80.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, file, statements, branches, functions, lines, least: rows of a coverage table with a share below ``below``."""
    names = ["statements", "branches", "functions", "lines"]
    rows = parsed(lines, COVERAGE, ["file", *names], keys)
    rows = rows.select(*keys, "pos", "file", *[F.col(c).cast("double").alias(c) for c in names])
    return rows.withColumn("least", F.least(*names)).where((F.col("least") < below) & (F.col("file") != "All files"))
