"""What a reader is, which run it reads, and how each kind rewrites lines.

A reader is a name, a pattern on the command and one of six kinds:

* ``whole``: its output is data; nothing is left out;
* ``noise``: lines of given patterns are counted in one note at the first one's place;
* ``repeat``: lines equal up to a pattern appear once, with their number;
* ``prefix``: lines up to a token cap, then how many are left;
* ``table``: long tables keep the rows that need a look, and counts by the status column;
* ``plain``: no rewriting of its own; the engine's general shapes (paths, logs, stacks, JSON) take it.

Error lines are never dropped or counted away. Runs of all readers go through one plan: a run's reader is a column, and
each kind is one branch, whichever readers it serves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.classify import ERR, level
from loomline.functions.tokens import estimate


@dataclass(frozen=True)
class Reader:
    name: str
    command: str  # what the command begins with
    kind: str
    noise: tuple[tuple[str, str], ...] = ()  # (pattern, what the note calls such lines)
    same: str = ""  # repeat: what is cut off before lines are compared
    cap: int = 7000
    healthy: str = ""  # table: a row that needs no look
    status: int = 1  # table: the column counted by


#: Programs that run another one: they and their options are peeled off, up to four of them.
WRAPPERS = r"^(?:(?:env(?: [A-Za-z_][0-9A-Za-z_]*=\S*)*|time|nice(?: -n ?\S+)?|nohup|command|sudo|npx|uv run|poetry run|pipenv run|bundle exec|timeout \S+) )"


def peeled(command: Column, times: int = 4) -> Column:
    out = F.trim(command)
    for _ in range(times):
        out = F.regexp_replace(out, WRAPPERS, "")
    return out


READERS: list[Reader] = []


def _add(kind: str, name: str, command: str, **more) -> None:
    READERS.append(Reader(name, command, kind, **more))


_GIT_PROGRESS = (r"^(?:remote: )?(?:Enumerating|Counting|Compressing|Receiving|Resolving|Writing|Total|Delta) ?", "transfer lines")
_add("noise", "git-sync", r"git (?:push|pull|fetch|clone)\b", noise=(_GIT_PROGRESS, (r"^ (?:create|delete) mode \d+", "mode lines")))
_add("noise", "git-merge", r"git (?:merge|rebase|cherry-pick)\b", noise=((r"^ (?:create|delete) mode \d+", "mode lines"),))
_add("noise", "git-commit", r"git commit\b", noise=((r"\.{3,}(?:Passed|Skipped|\(no files to check\)Skipped)$", "hooks passed or skipped"), (r"^ (?:create|delete) mode \d+", "mode lines")))
_add("noise", "git-status", r"git status\b", noise=((r'^  \(use "git ', "hints"),))
for _name, _rest in (("log", "log"), ("show", "show"), ("stash", "stash"), ("list", "(?:reflog|shortlog|worktree|ls-remote|submodule)")):
    _add("prefix", f"git-{_name}", rf"git {_rest}\b")
_add("prefix", "git-blame", r"git blame\b")
_add("repeat", "git-remote", r"git remote -v", same=r"\s+\((?:fetch|push)\)$")
_add("prefix", "git-tag", r"git tag\b", cap=4000)
_add("prefix", "git-branch", r"git branch\b", cap=4000)
_add("prefix", "git-diff", r"git diff\b")
_add("noise", "go-test-json", r"go test\b.* -json\b", noise=((r'^\{.*"Action":"(?:start|run|pause|cont|pass|skip)"', "events"), (r'^\{.*"Action":"output".*"Output":"(?:=== |--- PASS|PASS|ok )', "events of passed tests")))
_add("noise", "go-test", r"go test\b", noise=((r"^=== (?:RUN|PAUSE|CONT|NAME)\s", "run lines"), (r"^\s*--- PASS", "passed tests"), (r"^ok\s", "packages ok"), (r"^\?\s.*\[no test files\]", "packages without tests")))
_add("repeat", "go-build", r"go (?:build|vet)\b")
_add("noise", "go-mod", r"go (?:mod|get)\b", noise=((r"^go: (?:downloading|finding|extracting) ", "modules fetched"),))
_add("whole", "go-list", r"go list\b")
_add("whole", "go-machine", r"go (?:env|version|doc)\b")
_JS_PASS = ((r"^\s*(?:✓|✔|√)\s", "passed tests"), (r"^PASS\s", "suites passed"))
for _name in ("jest", "vitest", "mocha"):
    _add("noise", _name, rf"{_name}\b", noise=_JS_PASS)
_add("noise", "npm-test", r"(?:npm|pnpm|yarn|bun) (?:run )?test\b", noise=(*_JS_PASS, (r"^> ", "script lines")))
_add("noise", "npm-install", r"(?:npm|pnpm|yarn|bun) (?:i|install|add|ci)\b", noise=((r"^npm warn deprecated ", "deprecations"), (r"^Progress: resolved", "progress lines"), (r"looking for funding|npm fund", "funding lines")))
_add("noise", "npm-run-build", r"(?:npm|pnpm|yarn|bun) run build\b|vite build\b|next build\b|webpack\b", noise=((r"^dist/\S+\s+[\d.,]+ [kM]?B", "assets"),))
_add("prefix", "npm-ls", r"(?:npm|pnpm|yarn) (?:ls|list)\b")
_add("prefix", "npm-audit", r"npm audit\b")
_add("whole", "npm-outdated", r"(?:npm|pnpm|yarn) outdated\b")
_add("repeat", "tsc", r"tsc\b", same=r"^\S+\(\d+,\d+\): ")
_add("repeat", "eslint", r"eslint\b", same=r"^\s+\d+:\d+\s+")
_add("noise", "pytest", r"(?:python3? -m )?pytest\b", noise=((r"^\S+\.py(?:::\S+)? (?:[.sxX]+|PASSED)\s*(?:\[\s*\d+%\])?$", "progress lines"),))
_add("noise", "pip-install", r"(?:python3? -m )?pip3? install\b", noise=((r"^\s*Requirement already satisfied: ", "requirements already met"), (r"^\s*(?:Collecting|Downloading|Using cached|Obtaining|Preparing|Building|Created|Stored) ?", "steps")))
_add("noise", "pip-uninstall", r"(?:python3? -m )?pip3? uninstall\b", noise=((r"^\s*(?:Would remove|Proceed|/)", "steps"),))
_add("whole", "pip-list", r"(?:python3? -m )?pip3? list\b")
_add("whole", "pip-show", r"(?:python3? -m )?pip3? show\b")
_add("repeat", "mypy", r"(?:python3? -m )?mypy\b", same=r"^\S+:\d+: note: ")
_add("noise", "ruff", r"ruff\b", noise=((r"^\s*\d* ?\|", "source lines"),))
_add("noise", "python", r"python3? (?!-m )\S+\.py\b", noise=((r'^  File ".*(?:site-packages|dist-packages|/lib/python\d)', "library frames"),))
_add("plain", "node-crash", r"node (?!-)\S+\.[cm]?js\b")
_add("plain", "find", r"(?:find|fd)\b")
_add("plain", "rg-files", r"rg --files\b")
_add("plain", "ls-recursive", r"ls\b(?=.* -[0-9A-Za-z]*R|.* --recursive)")
_add("prefix", "du", r"du\b", cap=4000)
_add("prefix", "tree", r"tree\b", cap=4000)
_add("prefix", "ls", r"ls\b", cap=3000)
_add("prefix", "search", r"(?:grep|egrep|fgrep|rg|git grep)\b", cap=4000)
_add("prefix", "cat", r"(?:cat|head|tail|bat)\b", cap=8000)
_add("noise", "curl", r"curl\b", noise=((r"^\s*(?:% Total|Dload|\d+ +\d)", "meter lines"), (r"^[*] ", "connection lines")))
_add("noise", "httpie", r"(?:http|https|xh)\b", noise=((r"(?i)^(?:accept|accept-encoding|connection|user-agent|host|content-length|date|server|vary|etag|cache-control|set-cookie): ", "header lines"),))
_add("plain", "jq", r"(?:jq|yq)\b")
_add("noise", "wget", r"wget\b", noise=((r"^\s*\d+K .*\d+%|\d+%\[", "progress lines"), (r"^(?:Resolving|Connecting to|Reusing) ", "connection lines")))
_add("noise", "make", r"(?:make|cmake|ninja)\b", noise=((r"^(?:gcc|g\+\+|cc|clang|clang\+\+|ar|ld) ", "compiler commands"), (r"^\[\s*\d+(?:%|/\d+)\] ", "build steps"), (r"^make(?:\[\d+\])?: (?:Entering|Leaving) directory", "directory lines")))
_add("repeat", "cc", r"(?:gcc|g\+\+|cc|clang|clang\+\+)\b", same=r"^\S+:\d+(?::\d+)?: ")
_add("noise", "cargo", r"cargo\b", noise=((r"^\s*(?:Compiling|Checking|Downloaded|Downloading|Fresh|Updating|Locking|Adding) ", "crates"), (r"^test .* \.\.\. ok$", "passed tests")))
_add("noise", "maven", r"(?:mvn|mvnw|\./mvnw)\b", noise=((r"^(?:\[INFO\] )?(?:Downloading|Downloaded) ", "downloads"), (r"^\[INFO\]\s*(?:-+.*)?$", "rules")))
_add("noise", "gradle", r"(?:gradle|gradlew|\./gradlew)\b", noise=((r"^> Task \S+(?: UP-TO-DATE| NO-SOURCE| FROM-CACHE)?$", "tasks"), (r"^Download ", "downloads")))
_HEALTHY = r"(?i)\b(?:running|up|healthy|completed|active|bound|ready|available|success|pass)\b"
_add("table", "docker-ps", r"(?:docker|podman) (?:ps|images|volume ls|network ls)\b", healthy=_HEALTHY)
_add("table", "kubectl-events", r"(?:kubectl|oc) (?:get (?:events?|ev)\b|events\b)", healthy=r"\bNormal\b", status=2)
_add("plain", "logs", r"(?:(?:docker|podman)(?: compose| container| service)? logs|(?:kubectl|oc) logs|journalctl)\b")
_add("table", "kubectl-get", r"(?:kubectl|oc) get\b", healthy=_HEALTHY, status=3)
_add("prefix", "kubectl-describe", r"(?:kubectl|oc) describe\b")
_add("table", "gh-list", r"gh (?:run|pr|issue) list\b", healthy=_HEALTHY)
_add("plain", "gh-run-log", r"gh run view\b.*--log")
_add("noise", "gh-run-view", r"gh run (?:view|watch)\b", noise=((r"^\s*✓ ", "passed steps"), (r"^Refreshing run status", "refreshes")))
_add("repeat", "monorepo", r"(?:turbo|nx|lerna)\b", same=r"^\S+:\S+: ")
_add("table", "pr-checks", r"gh pr checks\b", healthy=_HEALTHY, status=2)
_add("noise", "docker-build", r"(?:docker|podman) (?:build|buildx)\b", noise=((r"^#\d+ (?:sha256:|extracting|transferring|DONE|CACHED)", "layer lines"), (r"^(?: ---> | ---> Running in )", "layer lines")))
_add("noise", "docker-pull", r"(?:docker|podman) (?:pull|push)\b", noise=((r"^[0-9a-f]{12}: ", "layer lines"),))
_add("noise", "terraform", r"(?:terraform|tofu)\b", noise=((r": (?:Refreshing state\.\.\.|Reading\.\.\.|Read complete|Still )", "state lines"),))


def assign(runs: DataFrame, command: str = "command", readers: Sequence[Reader] = READERS) -> DataFrame:
    """``reader`` and ``kind`` of each run: the first reader whose pattern the peeled command begins with, else null."""
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    own = peeled(F.col(command))
    for r in reversed(readers):
        hit = own.rlike(f"^(?:{r.command})")
        name, kind = F.when(hit, r.name).otherwise(name), F.when(hit, r.kind).otherwise(kind)
    return runs.withColumn("reader", name).withColumn("kind", kind)


def _noise(lines: DataFrame, readers: Sequence[Reader], keys: Sequence[str]) -> DataFrame:
    label = F.lit(None).cast("string")
    for r in readers:
        for pattern, called in r.noise:
            label = F.coalesce(label, F.when((F.col("reader") == r.name) & F.col("line").rlike(pattern), called))
    marked = lines.withColumn("__l", F.when(level(F.col("line")) < ERR, label))
    w = Window.partitionBy(*keys, "__l")
    first = F.min("pos").over(w) == F.col("pos")
    n = F.count("*").over(w)
    note = F.when(n == 1, F.col("line")).otherwise(F.concat(F.lit("["), n.cast("string"), F.lit(" "), "__l", F.lit("]")))
    marked = marked.withColumn("__first", first).withColumn("__note", note)
    return marked.where("__l is null or __first").withColumn("line", F.when(F.col("__l").isNull(), F.col("line")).otherwise(F.col("__note")))


def _repeat(lines: DataFrame, readers: Sequence[Reader], keys: Sequence[str]) -> DataFrame:
    key = F.col("line")
    for r in readers:
        if r.same:
            key = F.when(F.col("reader") == r.name, F.regexp_replace("line", r.same, "")).otherwise(key)
    w = Window.partitionBy(*keys, "__k")
    # places differ between errors of one message: these stay
    keep = (F.trim("line") == "") | (level(F.col("line")) == ERR)
    marked = lines.withColumn("__k", F.when(keep, F.concat(F.lit("\0"), F.col("pos").cast("string"))).otherwise(key))
    marked = marked.withColumn("__n", F.count("*").over(w)).withColumn("__first", F.min("pos").over(w) == F.col("pos"))
    many = F.concat("line", F.lit(" [×"), F.col("__n").cast("string"), F.lit("]"))
    return marked.where("__first").withColumn("line", F.when(F.col("__n") > 1, many).otherwise(F.col("line")))


def _prefix(lines: DataFrame, readers: Sequence[Reader], keys: Sequence[str]) -> DataFrame:
    cap = reduce(lambda a, r: F.when(F.col("reader") == r.name, r.cap).otherwise(a), readers, F.lit(7000))
    w = Window.partitionBy(*keys).orderBy("pos")
    used = F.sum(estimate(F.col("line")) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("__in", (used <= cap) | (level(F.col("line")) == ERR))
    whole = Window.partitionBy(*keys)
    marked = marked.withColumn("__rest", F.count_if(~F.col("__in")).over(whole)).withColumn(
        "__next", F.min(F.when(~F.col("__in"), F.col("pos"))).over(whole)
    )
    more = F.concat(F.lit("… +"), F.col("__rest").cast("string"), F.lit(" more lines"))
    return marked.where("__in or pos = __next").withColumn("line", F.when(F.col("__in"), F.col("line")).otherwise(more))


def _table(lines: DataFrame, readers: Sequence[Reader], keys: Sequence[str], longest: int = 60) -> DataFrame:
    healthy, status = F.lit(True), F.lit(1)
    for r in readers:
        healthy = F.when(F.col("reader") == r.name, F.col("line").rlike(r.healthy or ".")).otherwise(healthy)
        status = F.when(F.col("reader") == r.name, r.status).otherwise(status)
    whole = Window.partitionBy(*keys)
    cells = F.split("line", r"\s{2,}|\t")
    marked = (
        lines.withColumn("__n", F.count("*").over(whole))
        .withColumn("__ok", (F.col("pos") > 0) & healthy & (level(F.col("line")) < ERR) & (F.col("__n") > longest))
        .withColumn("__s", F.when(F.col("__ok"), F.coalesce(F.try_element_at(cells, status), F.lit(""))))
    )
    by = Window.partitionBy(*keys, "__s")
    marked = marked.withColumn("__k", F.count("*").over(by)).withColumn("__first", F.min("pos").over(by) == F.col("pos"))
    note = F.concat(F.lit("[+"), F.col("__k").cast("string"), F.lit(" rows: "), "__s", F.lit("]"))
    return marked.where("not __ok or __first").withColumn("line", F.when(F.col("__ok"), note).otherwise(F.col("line")))


#: What ``apply`` rewrites; ``whole`` and ``plain`` lines pass.
KINDS = {"noise": _noise, "repeat": _repeat, "prefix": _prefix, "table": _table}


def apply(lines: DataFrame, keys: Sequence[str] = ("run_id",), readers: Sequence[Reader] = READERS) -> DataFrame:
    """Lines of runs with a reader (columns ``reader`` and ``kind``), rewritten: keys, pos, line, reader."""
    cols = [*keys, "pos", "line", "reader"]
    out = lines.where(~F.col("kind").isin(*KINDS)).select(*cols)
    for kind, rewrite in KINDS.items():
        own = [r for r in readers if r.kind == kind]
        out = out.unionByName(rewrite(lines.where(F.col("kind") == kind), own, keys).select(*cols))
    return out
