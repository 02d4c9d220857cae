"""Symbolic keys of steps: column expressions, and the regex families over commands, observations, files, diffs and queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def progress(step: str, count: str) -> Column:
    """Recorded step number over the last one's; 0 for a run of one step."""
    return F.col(step) / F.greatest(F.col(count) - 1, F.lit(1))


def phase_of_step(p: str) -> Column:
    """Extractor's phases: up to 0.33, up to 0.67, later."""
    return F.when(F.col(p) <= 0.33, "early").when(F.col(p) <= 0.67, "mid").otherwise("late")


def phase_of_state(p: str) -> Column:
    """Typed states' phases: below a third, below two thirds, later. Not the extractor's cut-offs."""
    return F.when(F.col(p) < 1 / 3, "early").when(F.col(p) < 2 / 3, "mid").otherwise("late")


def key_set(*parts: Column) -> Column:
    """The sorted distinct keys that aren't null."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*parts))))


def typed_code(role: str, phase: str, tag: str) -> Column:
    return F.concat_ws("|", role, phase, tag)


def cases(pairs: list[tuple[Column, str]], other: str) -> Column:
    """The value of the first condition that holds."""
    first, *rest = pairs
    return reduce(lambda out, p: out.when(p[0], p[1]), rest, F.when(*first)).otherwise(other)


def whole(words: str) -> str:
    """A pattern for any of these blank-separated words, each as a whole word."""
    return rf"\b({'|'.join(words.split())})\b"


#: (class, pattern): the first that matches counts.
COMMANDS = [
    ("pytest", whole(r"py\.test pytest")),
    ("python", whole("ipython python python3")),
    ("grep", whole("ack ag grep rg")),
    ("find", whole("fd find locate")),
    ("sed", whole("sed")),
    ("cat", whole("cat head less more tail")),
    ("pip", r"\b(conda|pip|pip3)\s+install\b"),
    ("git", whole("git")),
    ("cd", r"^\s*cd\b"),
    ("ls", whole("dir ls")),
    ("echo", whole("echo printf")),
    ("mkdir", whole("mkdir")),
    ("rm", whole("rm rmdir")),
    ("curl", whole("curl wget")),
]

#: Every one that matches counts. Errors are named after their exception, which is a pattern itself; MORE has what else they match.
ERRORS = ["AssertionError", "AttributeError", "FileNotFoundError", "ImportError", "IndexError", "KeyError", "NameError", "OSError", "PermissionError", "RuntimeError", "SyntaxError", "TimeoutError", "TypeError", "ValueError"]
MORE = {
    "AssertionError": r"assert\s+.*failed",
    "FileNotFoundError": "no such file",
    "ImportError": "modulenotfounderror",
    "OSError": "ioerror",
    "PermissionError": "permission denied",
    "TimeoutError": r"timed?\s*out",
}
OBSERVATIONS = [
    *((name, "(?i)" + "|".join([name, *([MORE[name]] if name in MORE else [])])) for name in ERRORS),
    ("success", r"(?i)\bsuccess(ful|fully)?\b"),
    ("test_error", r"(?i)test.*\berror\b|\berror\b.*\btest"),
    ("test_failed", r"(?i)\bfailed\b"),
    ("test_passed", r"(?i)\bpassed\b.*\btest"),
    ("traceback", r"Traceback \(most recent call last\)"),
]

#: What a line that a diff adds begins with; a function's own line counts when it is removed as well.
ADDED = {"assert": r"assert\b", "class": r"class\s+\w+", "condition": "(else:|elif |if )", "function": r"def\s+\w+", "import": "(import |from .* import )", "return": r"return\b", "try": "(finally:|except |try:)"}
DIFFS = [*((f"add_{k}", rf"(?m)^\+\s*{p}") for k, p in ADDED.items()), ("modify_function", rf"(?m)^[+-]\s*{ADDED['function']}")]


def command_class(cmd: str) -> Column:
    return cases([(F.col(cmd).rlike(p), name) for name, p in COMMANDS], "other")


def observation_keys(text: str) -> Column:
    return key_set(*[F.when(F.col(text).rlike(p), F.lit("OBS:" + name)) for name, p in OBSERVATIONS])


def diff_keys(text: str) -> Column:
    return key_set(*[F.when(F.col(text).rlike(p), F.lit("DIFF:" + name)) for name, p in DIFFS])


def last_two(path: Column) -> Column:
    """The last two parts of a path."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))


def extension(path: Column) -> Column:
    """Lower-cased, '' for none or one of other signs or of more than six."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1))


#: An absolute path that ends in an extension, after a blank, a quote or a parenthesis.
PATHS = r"""(?m)(?:["'(\s]|^)(/[^"')\s]+\.\w+)"""


def file_keys(text: str) -> Column:
    paths = F.regexp_extract_all(F.col(text), F.lit(PATHS), 1)
    names = F.transform(paths, lambda p: F.concat(F.lit("FILE_PATH:"), last_two(p)))
    kinds = F.transform(F.filter(paths, lambda p: extension(p) != ""), lambda p: F.concat(F.lit("FILE_EXT:"), extension(p)))
    return F.array_sort(F.array_union(names, kinds))


def domains(text: str) -> Column:
    """Last two labels of the hosts in the first 5000 characters, distinct and sorted."""
    hosts = F.regexp_extract_all(F.substring(text, 1, 5000), F.lit(r"(?i)https?://([^/\s\"'<>)]+)"), 1)
    labels = F.transform(hosts, lambda h: F.split(F.regexp_replace(F.regexp_replace(F.lower(h), r"[.,;:]+$", ""), r":[0-9]+$", ""), r"\."))
    good = F.filter(labels, lambda x: F.size(x) >= 2)
    return F.array_sort(F.array_distinct(F.transform(good, lambda x: F.concat_ws(".", F.slice(x, -2, 2)))))


def query_tokens(text: str) -> Column:
    """Distinct lower-cased alphanumeric tokens of more than two characters, sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > 2)))


def query_text(arguments: str) -> Column:
    """The first of the arguments' query fields that isn't empty; the arguments themselves where they are no JSON."""
    fields = [F.nullif(F.get_json_object(arguments, "$." + f), F.lit("")) for f in ("query", "q", "search_query", "input", "text")]
    return F.coalesce(*fields, F.col(arguments))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def novelty(most_alike: str) -> Column:
    """Of a query by its greatest Jaccard with an earlier one of its run (null: none)."""
    return F.when(F.col(most_alike) >= 0.6, "repeat").when(F.col(most_alike) >= 0.2, "refine").otherwise("new")


def evidence_bucket(n: str) -> Column:
    return F.when(F.col(n) < 3, "low").when(F.col(n) < 8, "mid").otherwise("high")


def strip_generic(keys: str) -> Column:
    return F.filter(keys, lambda k: ~k.startswith("PHASE:") & (k != "ACTION:other"))


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


#: First token of a live command to class.
TOKENS = {"pytest": "pytest", "grep": "grep rg", "cat": "cat head less tail", "sed": "sed", "python": "py python python3", "git": "git", "find": "find ls tree", "awk": "awk", "echo": "echo"}


def first_token_class(cmd: str) -> Column:
    token = F.lower(F.regexp_extract(cmd, r"^\s*([a-zA-Z_][\w-]*)", 1))
    return cases([(token.isin(words.split()), name) for name, words in TOKENS.items()], "other")


def intent(cmd: str) -> Column:
    """What a live command is for: edit, then read, search, test, other."""
    c = F.lower(cmd)
    edit = any_of(c, ["<<eof", "heredoc", "tee ", " > ", " >> "]) | c.startswith("awk ") | c.startswith("sed ")
    read = any_of(c, [w + " " for w in "cat find head less ls tail tree view".split()])
    test = any_of(c, ["py.test", "pytest", "unittest", "python -m ", "python3 -m "])
    return cases([(edit, "edit"), (read, "read"), (any_of(c, ["grep ", "rg "]), "search"), (test, "test")], "other")


HARD = "|".join([r"=+ failures =+", "assertionerror", "command not found", "error collecting", "failed", "no such file or directory", "permission denied", r"traceback \(most recent call last\)"])
GENERIC = r"(?i)failed|command not found|\bnot\s+found\b|" + whole("denied error invalid traceback") + "|" + "|".join(x for x in ERRORS if x not in ("OSError", "PermissionError", "TimeoutError"))


def hard_error(cls: str, text: str) -> Column:
    """A real failure in the first 4000 characters; after Python, any word for an error will do."""
    return hard_error_of(F.col(cls), F.col(text))


def hard_error_of(cls: Column, text: Column) -> Column:
    head = F.substring(text, 1, 4000)
    return head.rlike("(?i)" + HARD) | (cls.isin("pytest", "python") & head.rlike("(?i)" + whole("error exception failed failure")))


def generic_error(text: str) -> Column:
    return F.substring(text, 1, 4000).rlike(GENERIC)


def trap_family(keys: str) -> Column:
    """Decision list over a trap's keys."""
    has = lambda k: F.array_contains(keys, k)
    error = has("OBS:error") | has("OBS:traceback")
    edit, read = has("ACTION:edit") & has("CMD:sed"), has("ACTION:read") & has("CMD:cat")
    silent = [(edit, "blind_edit_silent"), (read & has("OBS:test_passed"), "misread_partial_success"), (read, "aimless_reading")]
    return cases([(has("ACTION:submit"), "premature_submit"), (edit & error, "blind_edit_error"), (read & error, "stuck_reading_error"), *silent], "unknown")


def truncated(text: str | Column, most: int) -> Column:
    """On one line, at most ``most`` characters, the last an ellipsis if some are missing."""
    line = F.regexp_replace(F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "\n", " ")
    return F.when(line == "", "(empty)").when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


#: A line that tells of a failure.
CUE = r"(?im)^.*(assertionerror|denied|error|exception|failed|invalid|not found|traceback).*$"


def error_summary(text: str, most: int = 300) -> Column:
    """The first line of a failure in 6000 characters, else the last line with anything on it of the last 1500."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    cue = F.regexp_extract(F.substring(t, 1, 6000), CUE, 0)
    lines = F.filter(F.split(F.substring(t, -1500, 1500), "\n"), lambda x: F.trim(x) != "")
    return F.when(t == "", "(no observation captured)").when(cue != "", truncated(cue, most)).otherwise(truncated(F.element_at(lines, -1), most))
