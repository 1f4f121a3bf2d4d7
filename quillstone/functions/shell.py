"""Shell command lines: lexing, ids closed by a command, phrases, patterns that are data."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = {";", "&&", "||", "|", "&"}


def lex(command: str | None) -> list[list[str]]:
    """The words of each sub-command; none if a quote is open."""
    try:
        lexer = shlex.shlex(command or "", posix=True, punctuation_chars=True)
        lexer.whitespace_split = True
        words = list(lexer)
    except ValueError:
        return []
    out: list[list[str]] = [[]]
    for w in words:
        if w in SEPARATORS:
            out.append([])
        else:
            out[-1].append(w)
    return [ws for ws in out if ws]


def _closed(command: str | None, tool: str, verb: str) -> list[str]:
    ids: list[str] = []
    for ws in lex(command):
        for at in range(len(ws) - 1):
            if ws[at] == tool and ws[at + 1] == verb:
                for w in ws[at + 2 :]:
                    if w.startswith("-"):
                        break
                    if "$" in w:
                        return []
                    ids.append(w)
                break
    return list(dict.fromkeys(ids))


def _options(command: str | None, name: str) -> str:
    found = []
    for ws in lex(command):
        for at, w in enumerate(ws):
            if w == name and at + 1 < len(ws):
                found.append(ws[at + 1])
            elif w.startswith(name + "="):
                found.append(w[len(name) + 1 :])
    return "\n".join(found)


def _phrase(command: str | None, phrase: list[str]) -> bool:
    n = len(phrase)
    return any(ws[i : i + n] == phrase for ws in lex(command) for i in range(len(ws) - n + 1)) if n else False


def closed_ids(command: Column, tool: str, verb: str = "close") -> Column:
    """Ids after `tool verb` up to the first flag; none if one is an unresolved variable or a quote is open."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: _closed(c, tool, verb))

    return run(command)


def option_text(command: Column, name: str = "--reason") -> Column:
    """All values of an option, joined by newlines."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: _options(c, name))

    return run(command)


def has_phrase(command: Column, phrase: str) -> Column:
    """Whether some sub-command holds the words of phrase one after the other."""
    words = phrase.split()

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: _phrase(c, words))

    return run(command)


def matches(text: Column, pattern: Column) -> Column:
    """Unanchored search for a pattern that is data; one that is no valid pattern, or null, never matches."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        known: dict = {}

        def one(t, x):
            if t is None or x is None:
                return False
            if x not in known:
                try:
                    known[x] = re.compile(x)
                except re.error:
                    known[x] = None
            return known[x] is not None and known[x].search(t) is not None

        return pd.Series([one(t, x) for t, x in zip(s, p)])

    return run(text, pattern)


def evidence_reference(reason: Column, least: int = 200) -> Column:
    """Names a commit (7 to 40 hex digits, not all decimal) or a drawer, or is long enough to stand alone."""
    sha = reason.rlike(r"(?:^|[^0-9a-zA-Z])(?![0-9]+(?![0-9a-f]))[0-9a-f]{7,40}(?![0-9a-zA-Z])")
    return F.coalesce(sha | reason.rlike(r"drawer_[a-z0-9_-]+_[0-9a-f]{24}") | (F.length(reason) >= least), F.lit(False))


# The globs of paths, in which * stands for any characters, by what they are and by runtime.
NEITHER = ("*.md", "*.json", "*/docs/*", "docs/*")
TESTS = ("*/tests/*", "tests/*", "*/test/*", "test/*", "*/spec/*", "spec/*", "*/__tests__/*", "__tests__/*", "*.test.sh", "*_test.sh", "*.bats")
SOURCES = ("*.sh", "*.bash", "*/scripts/*", "scripts/*")
RUNTIMES = {
    "python": (("test_*.py", "*/test_*.py", "*_test.py", "conftest.py", "*/conftest.py"), ("*.py",)),
    "bash": ((), ("*/hooks/*.sh", "hooks/*.sh", "*/lib/*.sh", "lib/*.sh")),
    "go": (("*_test.go",), ("*.go",)),
    "node": (("*.test.*", "*.spec.*"), ("*.js", "*.jsx", "*.mjs", "*.cjs", "*.ts", "*.tsx")),
    "ruby": (("*_test.rb", "*_spec.rb"), ("*.rb",)),
    "rust": (("*_test.rs",), ("*.rs",)),
    "": (
        ("test_*.py", "*/test_*.py", "conftest.py", "*/conftest.py", "*_test.*", "*.test.*", "*_spec.*", "*.spec.*"),
        ("*.py", "*.go", "*.js", "*.jsx", "*.mjs", "*.cjs", "*.ts", "*.tsx", "*.rb", "*.rs", "*/hooks/*.sh", "hooks/*.sh", "*/lib/*.sh", "lib/*.sh"),
    ),
}
# Commands that act on what all share, a verb after any options.
VERBS = ("git merge", "git push", "bd dolt push", "bd close", "bd update")


def _any_glob(globs: tuple[str, ...]) -> str:
    return "(?s)^(?:" + "|".join(re.escape(g).replace(r"\*", ".*") for g in globs) + ")$"


def central_verb(command: Column) -> Column:
    """The first of VERBS that a command line holds, after a separator or blank and with options between; null without."""
    pattern = lambda v: r"(^|[;&|\s])" + re.sub(r"^(\S+) ", r"\1\\s+(--?\\S+\\s+)*", v, count=1).replace("dolt push", r"dolt\s+push") + r"(\s|$)"
    return F.coalesce(*[F.when(command.rlike(pattern(v)), F.lit(v)) for v in VERBS])


def path_class(path: Column, runtime: str = "") -> Column:
    """test, source or other, by what holds for any project and for the runtime ('' or an unknown one: all).

    Documentation is other whatever else holds; tests win over sources.
    """
    tests, sources = RUNTIMES.get(runtime, RUNTIMES[""])
    hit = lambda globs: path.rlike(_any_glob(globs))
    return F.when(hit(NEITHER), "other").when(hit(TESTS + tests), "test").when(hit(SOURCES + sources), "source").otherwise("other")
