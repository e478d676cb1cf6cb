"""Command lines as text: quoting, pipes, wrappers, guards. Nothing is ever run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import basename, col, let, wildcard

# Commands that only shape a display, launchers, and tools by command.
DISPLAY_FILTERS = ("head", "tail", "cat", "less", "more", "xcbeautify", "xcpretty")
LAUNCHERS = r"^(?:\S*/)?(?:uvx|uv run|uv tool run|(?:poetry|pdm|hatch|pipenv|rye) run(?= [^-])|xcrun) (?:(?:--with|--python|-p|--group|--extra|--from|--project|--directory) \S+ |--\S+=\S+ |-- |--(?:frozen|locked|no-sync|isolated|offline|quiet|all-extras) )*"
ADAPTERS = (
    ("pytest", r"^(?:\S*/)?(?:pytest|py\.test)(?: |$)|^(?:\S*/)?python\S*(?: \S+)* -m pytest(?: |$)|^(?:-m|--module) pytest(?: |$)"),
    ("unittest", r"^(?:\S*/)?python\S*(?: \S+)* -m unittest(?: |$)"),
    ("jest", r"^(?:npx )?(?:\S*/)?jest(?: |$)"),
    ("vitest", r"^(?:npx )?(?:\S*/)?vitest(?: |$)"),
    ("swift-test", r"^swift test(?: |$)"),
    ("swift-build", r"^swift build(?: |$)"),
    ("xcodebuild-test", r"^xcodebuild(?: .*)? test(?: |$)"),
    ("xcodebuild-build", r"^xcodebuild(?: .*)? (?:build|archive)(?: |$)"),
    ("ruff", r"^(?:\S*/)?ruff check(?: |$)"),
    ("eslint", r"^(?:npx )?(?:\S*/)?eslint(?: |$)"),
    ("tsc", r"^(?:npx )?(?:\S*/)?tsc(?: |$)"),
    ("pre-commit", r"^(?:\S*/)?pre-commit run(?: |$)"),
    ("cargo-test", r"^cargo (?:\+\S+ )?(?:test|t|nextest run)(?: |$)"),
    ("cargo", r"^cargo (?:\+\S+ )?(?:build|b|check|c|clippy)(?: |$)"),
    ("go-test", r"^go test(?: |$)"),
    ("mypy", r"^(?:\S*/)?mypy(?: |$)|^(?:\S*/)?python\S* -m mypy(?: |$)"),
    ("phpunit", r"^(?:\S*/)?phpunit(?: |$)"),
    ("rspec", r"^(?:bundle exec )?(?:\S*/)?rspec(?: |$)"),
    ("swiftlint", r"^(?:\S*/)?swiftlint(?: lint)?(?: |$)"),
    ("gradle", r"^(?:\S*/)?gradlew?(?: .*)? (?:\S*:)?(?:test|check|build)(?: |$)"),
    ("maven", r"^(?:\S*/)?mvnw?(?: .*)? (?:test|verify|package|install)(?: |$)"),
    ("dotnet", r"^dotnet test(?: |$)"),
    ("golangci-lint", r"^(?:\S*/)?golangci-lint run(?: |$)"),
)

_QUOTED = r"""\\.|'[^']*'|"(?:\\.|[^"\\])*\""""
_SIDE = rf"""((?s:{_QUOTED}|[^|'"\\])*)"""


def needs_shell(command: str | Column) -> Column:
    """Operators, expansions or newlines outside quotes, or a leading assignment."""
    c = col(command)
    bare = F.regexp_replace(c, rf"(?s){_QUOTED}", "")
    expanding = F.regexp_replace(c, r"""(?s)\\.|'[^']*'|"((?:\\.|[^"\\])*)\"""", "$1")
    operator = bare.rlike(r"[|&;<>()*?\[{~]") | expanding.rlike(r"[$`]") | F.regexp_replace(c, r"(?s)\\.", "").contains("\n")
    return operator | c.rlike(r"^\s*[A-Za-z0-9_]+=")


def split_pipe(command: str | Column) -> Column:
    """(left, right) around the only unquoted pipe; null if there is not exactly one."""
    c = col(command)
    pattern = rf"^{_SIDE}\|(?!&){_SIDE}$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("left"), F.regexp_extract(c, pattern, 2).alias("right")))


def strip_merge(command: Column) -> Column:
    return F.regexp_replace(command, r" +2>&1$", "")


def strip_launcher(command: str | Column) -> Column:
    """Without uv run, poetry run, xcrun and their like."""
    return F.regexp_replace(col(command), LAUNCHERS, "")


def adapter_of(command: str | Column) -> Column:
    """Which tool's output to expect; null if none is known."""

    def known(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(ADAPTERS):
            out = F.when(c.rlike(pattern), name).otherwise(out)
        return out

    return let(strip_launcher(F.trim(F.regexp_replace(col(command), r"\s+", " "))), known)


def drop_display_filter(command: str | Column) -> Column:
    """(command, filter, merged): a display filter after a known tool is dropped."""
    c = col(command)
    pipe = split_pipe(c)
    left, right = F.rtrim(pipe["left"]), F.trim(pipe["right"])
    bare = strip_merge(left)
    ok = pipe.isNotNull() & ~needs_shell(bare) & ~needs_shell(right) & F.split(right, " ")[0].isin(*DISPLAY_FILTERS) & adapter_of(bare).isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, bare).otherwise(c).alias("command"), F.when(ok, right).alias("filter"), F.coalesce(ok & (bare != left), F.lit(False)).alias("merged"))


def segments(command: str | Column) -> Column:
    """The parts of a chain of ``&&``; null if anything else would need judging."""
    c = col(command)
    parts = F.transform(F.split(c, "&&"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    bare = F.regexp_replace(F.replace(c, F.lit("&&"), F.lit(" ")), r"""'[^'"$`\\]*'|"[^'"$`\\]*\"""", "")
    return F.when(~bare.rlike(r"[^A-Za-z0-9 _./:=@%+,^-]"), let(parts, lambda ps: F.when(~F.exists(ps, lambda p: p == ""), ps)))


def _matches(form: str):
    return (lambda c: wildcard(c, F.lit(form))) if "*" in form else (lambda c: c == form)


def is_guarded(command: str | Column, rules: list[str]) -> Column:
    """Whether a rule of the user's permissions covers the command or a part of it.

    A command that cannot be taken apart is guarded as soon as there is a rule.
    """
    rules = [r.strip() for r in rules if r == "Bash" or r.startswith(("Bash(", "Bash "))]
    if not rules:
        return F.lit(False)
    forms = []
    for rule in rules:
        inner = " ".join(rule.removeprefix("Bash(").removesuffix(")").split()) if rule.startswith("Bash(") and rule.endswith(")") else ""
        if inner in ("", "*"):
            return F.lit(True)
        inner = inner.removesuffix(":*") + "*" if inner.endswith(":*") else inner
        forms += [inner] + ([inner.removesuffix(" *")] if inner.endswith(" *") else [])

    def hit(candidates: Column) -> Column:
        out = F.lit(False)
        for form in forms:
            out = out | F.exists(candidates, _matches(form))
        return out

    whole = F.trim(F.regexp_replace(col(command), r"\s+", " "))
    return F.coalesce(let(F.concat(F.array(whole), segments(command)), hit), F.lit(True))


def rewrite_decision(command: str | Column, wrapper: str, rules: list[str]) -> Column:
    """JSON: run a known, simple, unguarded command through ``wrapper``, or null."""
    c = col(command)
    ok = adapter_of(c).isNotNull() & ~needs_shell(c) & ~is_guarded(c, rules)
    return F.when(ok, F.to_json(F.struct(F.lit("rewrite").alias("decision"), F.concat(F.lit(wrapper + " "), c).alias("command"))))


def head(command: str | Column) -> Column:
    return basename(F.split(F.trim(col(command)), r"\s+")[0])
