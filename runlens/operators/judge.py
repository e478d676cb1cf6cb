"""Which commands of a development loop could be wrapped, judged by tables.

A command is taken apart into a folder change, a chain of segments and a display
filter; each segment is a tool that the tables know, a declared script, or nothing
that may be touched. Everything is decided on text: nothing is run, no path is
resolved, and arguments are judged only by the tables of file-changing words, not
by a policy for each tool.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import basename, col, let
from . import commands as C

# Tools, and words that make them change files.
ALWAYS = ("pytest", "jest", "vitest", "tsc", "eslint", "mypy", "swiftlint", "make", "phpunit", "rspec", "pre-commit")
SUBCOMMANDS = {
    "cargo": ("build", "test", "check", "clippy", "doc", "nextest"), "go": ("test", "build", "vet"), "npm": ("test", "t", "ci"), "pnpm": ("test",), "yarn": ("test",), "bun": ("test",),
    "dotnet": ("test", "build"), "gradle": ("test", "build", "check"), "gradlew": ("test", "build", "check"), "mvn": ("test", "verify", "package"), "mvnw": ("test", "verify", "package"),
    "swift": ("test", "build"), "ruff": ("check",), "xcodebuild": ("test", "build"),
}
RUNNERS, RUNNER_TOOLS = ("npx", "bunx", "pnpx"), ("jest", "vitest", "tsc", "eslint")
MODULES = ("pytest", "unittest")
SAFE_ENV = ("CI", "NO_COLOR", "FORCE_COLOR", "TERM", "LANG", "LC_ALL", "TZ", "DEBUG", "RUST_LOG", "RUST_BACKTRACE", "CARGO_TERM_COLOR", "NODE_ENV", "PYTHONDONTWRITEBYTECODE", "PYTHONUNBUFFERED")
UV_FLAGS = ("--no-sync", "--frozen", "--locked", "--isolated", "--active", "--no-project", "--offline", "--no-dev")
STATE = ("cd", "export", "source", ".", "unset", "alias", "eval", "set", "ulimit", "umask")
SNAPSHOTS = ("-u", "--updateSnapshot", "--updateSnapshots", "--update", "--init", "init")
MUTATING = {
    "ruff": ("--fix", "--fix-only", "--unsafe-fixes", "--add-noqa", "format"), "eslint": ("--fix", "--fix-dry-run", "--fix-type", "--init", "init"), "swiftlint": ("--fix", "autocorrect", "--autocorrect"),
    "cargo": ("--fix",), "tsc": ("--init", "--clean", "init"), "rspec": ("--init", "init"), "pytest": ("--snapshot-update",), **dict.fromkeys(("jest", "vitest", "npm", "pnpm", "yarn", "bun"), SNAPSHOTS),
}
FILTERS = r"^(?:(?:head|tail)(?: (?:-n ?\d+|-\d+|--lines=\d+))|(?:xcbeautify|xcpretty)(?: (?:--quiet|-q|--is-ci|--disable-colored-output|-s|--simple|--no-color))*)$"
PLAIN_FOLDER = r"^[A-Za-z0-9_.=:@,+%][A-Za-z0-9_./=:@,+%-]*$"
SHELLS = ("sh", "bash", "zsh")


def option_name(word: str | Column) -> Column:
    """The name of a long option, without case, hyphens and underscores."""
    return F.lower(F.translate(F.regexp_extract(col(word), "^--?([^=]*)", 1), "-_", ""))


def words(segment: str | Column) -> Column:
    """The words of a segment without their quotes."""
    found = F.regexp_extract_all(col(segment), F.lit(r"""((?:[^\s'"]|'[^']*'|"[^"]*")+)"""), F.lit(1))
    return F.transform(found, lambda w: F.regexp_replace(w, "['\"]", ""))


def shape(command: str | Column) -> Column:
    """(folder, body, filter): a leading ``cd <folder> &&`` into the project and a
    display filter are taken off; null where either is of another form."""

    def split(c: Column) -> Column:
        moves = c.startswith("cd ")
        rest = F.when(moves, F.trim(F.regexp_extract(c, r"(?s)^cd [^&]*&&(.*)$", 1))).otherwise(c)
        folder = F.when(moves, F.trim(F.regexp_extract(c, r"^cd ([^&]*)&&", 1)))
        return let(F.struct(folder.alias("folder"), rest.alias("rest"), C.split_pipe(rest).alias("pipe")), part)

    def part(x: Column) -> Column:
        pipe = x["pipe"]
        body = C.strip_merge(F.when(pipe.isNull(), x["rest"]).otherwise(F.trim(pipe["left"])))
        shown = F.trim(F.regexp_replace(pipe["right"], " +", " "))
        return let(F.struct(x["folder"].alias("folder"), body.alias("body"), shown.alias("filter")), judged)

    def judged(x: Column) -> Column:
        folder = x["folder"]
        inside = folder.rlike(PLAIN_FOLDER) & ~F.exists(F.split(folder, "/"), lambda p: p == "..")
        ok = (folder.isNull() | inside) & (x["body"] != "") & (x["filter"].isNull() | (x["filter"].rlike(FILTERS) & C.adapter_of(x["body"]).isNotNull()))
        return F.when(F.coalesce(ok, F.lit(False)), x)

    return let(F.trim(col(command)), split)


def _in(table: dict[str, tuple], tool: Column, test) -> Column:
    """Whether ``test`` holds for the table's entries of ``tool``."""
    out = F.lit(False)
    for name, entries in table.items():
        out = F.when(tool == name, test(entries)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def changes_files(tool: Column, args: Column) -> Column:
    """Whether a word makes the tool rewrite files: as written, with a value, or a
    long option under another spelling."""

    def listed(entries) -> Column:
        names = [e.lstrip("-").replace("-", "").lower() for e in entries if e.startswith("--")]
        short = [e for e in entries if e.startswith("-") and not e.startswith("--")]
        one = lambda w: F.substring_index(w, "=", 1).isin(*entries) | (w.startswith("--") & option_name(w).isin(*names, *(s[1:] for s in short)))
        cluster = lambda w: w.rlike(r"^-[A-Za-z]+$") & w.rlike("|".join(s[1:] for s in short)) if short else F.lit(False)
        tsc = lambda w: (tool == "tsc") & w.startswith("-") & option_name(w).isin(*names)
        return F.exists(args, lambda w: one(w) | cluster(w) | tsc(w))

    return _in(MUTATING, tool, listed)


def is_noisy(tool: Column, args: Column) -> Column:
    first, second = (F.try_element_at(args, F.lit(i)) for i in (1, 2))
    runs = tool.isin("npm", "pnpm", "yarn") & (first == "run") & (second == "test")
    module = (tool.startswith("python") & (first == "-m") & second.isin(*MODULES)) | (tool.isin("-m", "--module") & first.isin(*MODULES))
    xcode = (tool == "xcodebuild") & F.exists(args, lambda w: w.isin(*SUBCOMMANDS["xcodebuild"]))
    launched = tool.isin(*RUNNERS) & basename(first).isin(*RUNNER_TOOLS)
    return F.coalesce(tool.isin(*ALWAYS) | runs | module | xcode | launched | _in(SUBCOMMANDS, tool, lambda subs: first.isin(*subs)), F.lit(False))


def paths_inside(args: Column, root: str | None) -> Column:
    """No word climbs out of the folder or names a path outside ``root``."""
    climbs = lambda w: F.exists(F.split(w, "[/=:, ]"), lambda p: p == "..")
    named = lambda w: F.regexp_extract_all(w, F.lit("(?:^|[=:, ])(/[^:, ]*)"), F.lit(1))
    ours = (lambda p: (p == root) | p.startswith(root.rstrip("/") + "/")) if root else (lambda p: F.lit(False))
    return F.forall(args, lambda w: ~climbs(w) & F.forall(named(w), ours))


def judge_segment(segment: str | Column, scripts: list[str], root: str | None = None) -> Column:
    """builtin, script, or null for a segment that must be left alone."""
    prefix = r"^((?:[A-Za-z_][A-Za-z0-9_]*=[^\s'\"]* )*)"
    uv = rf"^(?:\S*/)?(?:uvx|uv run|uv tool run) (?:(?:{'|'.join(UV_FLAGS)}) )*"
    from_second = lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))

    def split(s: Column) -> Column:
        names = F.regexp_extract_all(F.regexp_extract(s, prefix, 1), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=\S* "), F.lit(1))
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, prefix, ""), r"^(?:\S*/)?xcrun ", ""), uv, "")
        return let(F.struct(names.alias("names"), rest.alias("rest")), lambda x: let(F.struct(x["names"].alias("names"), x["rest"].alias("rest"), words(x["rest"]).alias("w")), tools))

    def tools(x: Column) -> Column:
        first = F.try_element_at(x["w"], F.lit(1))
        return let(F.struct(x.alias("x"), first.alias("first"), basename(first).alias("base"), from_second(x["w"]).alias("args")), judged)

    def judged(y: Column) -> Column:
        x, first, base, args = y["x"], y["first"], y["base"], y["args"]
        launched = base.isin(*RUNNERS)
        tool = F.when(launched, basename(F.try_element_at(args, F.lit(1)))).otherwise(base)
        own = F.when(launched, from_second(args)).otherwise(args)
        module = base.startswith("python") & (F.try_element_at(args, F.lit(1)) == "-m")
        tool = F.when(module, F.try_element_at(args, F.lit(2))).otherwise(tool)
        rest = x["rest"]
        clean = F.forall(x["names"], lambda n: n.isin(*SAFE_ENV)) & ~rest.rlike(r"^\S*['\"]") & (rest != "") & ~base.isin(*STATE) & ~base.isin("uv", "uvx")
        target = F.when(base.isin(*SHELLS), F.try_element_at(args, F.lit(1))).otherwise(first)
        declared = basename(target).isin(*(x.rsplit("/", 1)[-1] for x in scripts)) if scripts else F.lit(False)
        verdict = let(is_noisy(base, args), lambda noisy: F.when(noisy & paths_inside(x["w"], root), "builtin").when(~noisy & F.coalesce(declared, F.lit(False)), "script"))
        untouched = let(F.struct(tool.alias("tool"), own.alias("own")), lambda z: ~changes_files(z["tool"], z["own"]))
        return F.when(F.coalesce(clean & untouched, F.lit(False)), verdict)

    return let(F.trim(F.regexp_replace(col(segment), " +", " ")), split)


def judge(command: str | Column, scripts: list[str], rules: list[str], root: str | None = None) -> Column:
    """wrap, suggest (a declared script is in it), or null: every segment must be
    known and no rule of the user may cover the command."""

    def judged(body: Column) -> Column:
        found = F.transform(C.segments(body), lambda p: judge_segment(p, scripts, root))
        # a filter only shapes the display: rules are held against what runs
        return let(found, lambda all_: F.when(F.coalesce(all_.isNotNull() & ~F.exists(all_, lambda x: x.isNull()) & ~C.is_guarded(body, rules), F.lit(False)), F.when(F.exists(all_, lambda x: x == "script"), "suggest").otherwise("wrap")))

    return let(shape(command)["body"], judged)


def package_test(command: str | Column, package_json: str | Column) -> Column:
    """jest or vitest, if a package manager's test script is one of them and nothing
    else: no hooks around it, plain words only, no reporter of the user's own."""
    c = F.trim(F.regexp_replace(col(command), " +", " "))
    form = r"^(?:npm|pnpm|yarn|bun) (?:run )?(?:test|t)(?: -- | |$)(.*)$"
    get = lambda path: F.get_json_object(col(package_json), path)
    script = get("$.scripts.test")
    plain = script.rlike(r"^[A-Za-z0-9 _./=:@,+%-]+$") & ~F.concat(F.lit(" "), script, F.lit(" ")).contains(" -- ")
    inner = F.regexp_replace(F.trim(script), r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S* )*", "")
    whole = F.trim(F.concat(inner, F.lit(" "), F.regexp_extract(c, form, 1)))
    own = F.exists(F.split(whole, " "), lambda w: F.substring_index(w, "=", 1).isin("--reporter", "--json") | w.startswith("--outputFile"))
    tool = C.adapter_of(whole)
    once = (tool != "vitest") | whole.rlike(r"vitest (?:.* )?(?:run|--run)(?: |$)")
    ok = c.rlike(form) & plain & ~own & once & get("$.scripts.pretest").isNull() & get("$.scripts.posttest").isNull() & tool.isin("jest", "vitest")
    return F.when(F.coalesce(ok, F.lit(False)), tool)
