"""Keys of chat messages and live steps, and commands out of model responses."""

from __future__ import annotations

import json
import re
import shlex
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keys as K

CALL = "STRUCT<name: STRING, arguments: STRING>"
MESSAGE = f"content STRING, tool_calls ARRAY<STRUCT<function: {CALL}>>, function_call {CALL}"

#: What a tool does by parts of its name; the first pair that has one counts.
DOES = [("edit", ("str_replace", "edit")), ("create", ("create", "write")), ("view", ("view", "read")), ("search", ("search", "grep"))]


def calls(message: Column) -> Column:
    """The (name, arguments) of a parsed message's tool calls; the older single call where there are none."""
    listed = F.transform(F.coalesce(message["tool_calls"], F.array()), lambda c: c["function"])
    return F.when(F.size(listed) > 0, listed).when(message["function_call"].isNotNull(), F.array(message["function_call"])).otherwise(listed)


def _has(name: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in parts])


def action_keys(message: Column) -> Column:
    """TOOL, CMD (of shell tools) and ACTION keys of a message."""

    def of(call: Column) -> Column:
        name, arguments = F.coalesce(call["name"], F.lit("")), F.coalesce(call["arguments"], F.lit(""))
        low = F.lower(name)
        command = F.concat(F.lit("CMD:"), K.cases([(arguments.rlike(p), c) for c, p in K.COMMANDS], "other"))
        action = reduce(lambda out, d: out.when(_has(low, d[1]), F.lit("ACTION:" + d[0])), DOES[1:], F.when(_has(low, DOES[0][1]), F.lit("ACTION:" + DOES[0][0])))
        return F.array(F.when(name != "", F.concat(F.lit("TOOL:"), name)), F.when(_has(low, ("bash", "execute")), command), action)

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(calls(message), of)))))


def arguments_text(message: Column) -> Column:
    """All calls' arguments, one below the other."""
    return F.array_join(F.transform(calls(message), lambda c: F.coalesce(c["arguments"], F.lit(""))), "\n")


def live_keys(cmd: str, observation: str) -> Column:
    """Keys of a live shell step: its intent, first token, files of the command and the first 1000 characters seen, and observations of the first 4000."""
    seen = F.coalesce(F.col(observation), F.lit(""))
    kinds = "py rst md c h cpp txt cfg toml yaml yml json".split()
    text = F.concat(F.coalesce(F.col(cmd), F.lit("")), F.lit("\n"), F.substring(seen, 1, 1000))
    files = F.regexp_extract_all(text, F.lit(rf"[\w./-]+\.(?:{'|'.join(kinds)})"), 0)
    intent, first = K.intent(cmd), K.first_token_class(cmd)
    own = F.array(
        F.lit("TOOL:execute_bash"),
        F.when(intent != "other", F.concat(F.lit("ACTION:"), intent)),
        F.when(first != "other", F.concat(F.lit("CMD:"), first)),
        *[F.when(F.substring(seen, 1, 4000).rlike(p), F.lit("OBS:" + name)) for name, p in K.OBSERVATIONS],
        F.when(K.hard_error_of(first, seen), F.lit("OBS:hard_error")),
        F.when(K.generic_error(observation), F.lit("OBS:error")),
    )
    paths = F.transform(files, lambda f: F.concat(F.lit("FILE_PATH:"), f))
    ends = F.transform(files, lambda f: F.concat(F.lit("FILE_EXT:"), F.regexp_extract(f, r"\.(\w+)$", 1)))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(own, paths, ends))))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


_NAMES = ("cmd", "command", "command_string", "code", "input", "script")


def _plain(value: object) -> str:
    if isinstance(value, str):
        return value.strip()
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        return ""
    shell = len(value) > 2 and value[0] in ("sh", "bash") and value[1].lstrip("-") in ("c", "lc")
    return (value[2] if shell else shlex.join(value)).strip()


def _broken(raw: str) -> str:
    """The command of an object that is no JSON: the string behind "cmd" up to the first quote that can end it."""
    head = re.search(r'"cmd"\s*:\s*(?=")', raw)
    for end in re.finditer(r'(?<!\\)(?:\\\\)*"', raw[head.end() + 1 :]) if head else ():
        stop = head.end() + 1 + end.end()
        behind = raw[stop:].lstrip()
        if not behind or behind[0] in "},":
            return _loaded(raw[head.end() : stop])
        if behind.startswith(("]}", "],")):
            return _loaded(raw[head.end() : stop])
    return ""


def _loaded(text: str) -> str:
    try:
        return _plain(json.loads(text))
    except ValueError:
        return ""


def json_command(text: str | None) -> tuple[str, str]:
    """(what stands before it, command) of the first object in a text that holds one."""
    text, decoder = text or "", json.JSONDecoder()
    for at in (m.start() for m in re.finditer("{", text)):
        try:
            found = decoder.raw_decode(text, at)[0]
            command = next((c for n in _NAMES if (c := _plain(found.get(n)))), "")
        except ValueError:
            command = _broken(text[at:])
        if command:
            return text[:at].strip(), command
    return "", ""


def _recovered(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([json_command(x) if isinstance(x, str) else ("", "") for x in raw], columns=["before", "command"])


def recovered(raw: Column) -> Column:
    """:func:`json_command` by Arrow batches; null texts have none."""
    return F.pandas_udf(_recovered, "before string, command string")(raw)


FENCE = r"```(?:bash|sh)?\s*\n"


def unwrapped(action: Column) -> Column:
    """An action without fences around it and without a shell call in front."""
    out = stripped(action)
    for _ in range(2):
        out = stripped(F.regexp_replace(out, r"(?is)^```(?:bash|sh)?\s*\n?(.*?)\n?```$", "$1"))
    out = stripped(F.regexp_replace(out, rf"(?i)^{FENCE}", ""))
    out = stripped(F.regexp_replace(out, "```$", ""))
    return stripped(F.regexp_replace(out, r"(?s)^(?:bash|sh)\s+-?l?c\s+(.+)$", "$1"))


def parsed(content: str, reasoning: str, raw: str) -> Column:
    """Struct of thinking, thought and action of a response; all '' where there is nothing.

    Sections first, then a fenced block of the answer or of the reasoning, then a command in JSON."""
    text, why = F.coalesce(F.col(content), F.lit("")), F.coalesce(F.col(reasoning), F.lit(""))
    block = r"(?s)<think>(.*?)</think>"
    thinks = text.rlike(block)
    thinking = F.when(thinks, stripped(F.regexp_extract(text, block, 1))).otherwise("")
    visible = F.when(thinks, stripped(F.regexp_extract(text, r"(?s)^.*?<think>.*?</think>(.*)$", 1))).otherwise(text)
    thinking = F.when(thinking == "", stripped(why)).otherwise(thinking)
    thought = stripped(F.regexp_extract(visible, r"(?is)THOUGHT:\s*(.*?)(?=ACTION:|$)", 1))
    fenced = rf"(?is)ACTION:\s*{FENCE}(.*?)```"
    section = F.when(visible.rlike(fenced), stripped(F.regexp_extract(visible, fenced, 1))).otherwise(stripped(F.regexp_extract(visible, r"(?is)ACTION:\s*(.+)$", 1)))
    loose = lambda t: (stripped(F.regexp_extract(t, rf"(?is)^(.*?){FENCE}.*?```", 1)), stripped(F.regexp_extract(t, rf"(?is){FENCE}(.*?)```", 1)))
    found = recovered(F.col(raw))
    ways = [(F.lit(""), section), loose(visible), loose(why), (F.coalesce(F.nullif(found["before"], F.lit("")), stripped(visible)), found["command"])]
    action = K.cases([(a != "", a) for _, a in ways], F.lit(""))
    before = K.cases([(a != "", b) for b, a in ways], F.lit(""))
    return F.struct(thinking.alias("thinking"), F.when(thought == "", before).otherwise(thought).alias("thought"), unwrapped(action).alias("action"))


