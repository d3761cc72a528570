"""Permissions of an agent's tools: rules on commands and paths, deny before ask before allow, and defaults by mode."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools, decisions in order of precedence, modes, and commands that are never run.
READ, WRITE, RUN, CONSULTING = "Leer", "Escribir", "Ejecutar", ("Consultar", "Buscar")
DENY, ASK, ALLOW = "denegar", "preguntar", "permitir"
PLAN, ASKING, EDITS, BATCH = "plan", "preguntar", "aceptar_ediciones", "lote"
NEVER = [f"rm {flags} {target}" for flags in ("-rf", "-fr", "-r -f", "-f -r") for target in ("/", "~", "$HOME")]
DEFAULT_ALLOWED = ("git status", "git diff *", "git log *", "ls *", "ls")
# Of a command: quoted strings, separators one by one, and what stands between them. No group repeats, as Java would go one call deeper
# for each repetition.
TOKEN, QUOTED = r"""'[^']*+'|"[^"]*+"|[;|&'"]|[^'";|&]++""", r"""'[^']*+'|"[^"]*+\""""
#: Stands for a separator; no command can hold it.
CUT = "\0"


@dataclass(frozen=True)
class Rule:
    decision: str
    tool: str
    pattern: str


def rule(decision: str, text: str) -> Rule:
    """A rule from its text, such as Ejecutar(git log *); a malformed one is an error."""
    found = re.fullmatch(r"(\w+)\((.*)\)\s*", text.strip(), re.S)
    if decision not in (DENY, ASK, ALLOW) or not found or found[1] not in (READ, WRITE, RUN):
        raise ValueError(f"no rule: {decision} {text}")
    return Rule(decision, found[1], found[2].strip())


def spaced(command: Column) -> Column:
    return F.trim(F.regexp_replace(command, r"\s+", " "))


def commands(command: Column) -> Column:
    """The parts of a compound command, split outside quotes; a command with an open quote is one part."""
    open_quote = F.regexp_replace(command, QUOTED, "").rlike("['\"]")
    marked = F.transform(F.regexp_extract_all(command, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.isin(";", "|", "&"), CUT).otherwise(t))
    parts = F.filter(F.transform(F.split(F.array_join(marked, ""), CUT), spaced), lambda p: p != "")
    return F.when(open_quote, F.array(spaced(command))).otherwise(parts)


def fits(pattern: str, part: Column) -> Column:
    """`git log *` fits git log with or without more; a pattern without a star fits word for word."""
    plain = " ".join(pattern.split())
    if plain == "*":
        return F.lit(True)
    if plain.endswith(" *"):
        return (part == plain[:-2]) | part.startswith(plain[:-1])
    return part == plain


def glob(pattern: str, root: str, home: str = "/root") -> str:
    """The regular expression of a path pattern: ** crosses folders, * and ? stay in one. // is absolute, ~/ home, others below root."""
    full = pattern[1:] if pattern.startswith("//") else f"{home}/{pattern[2:]}" if pattern.startswith("~/") else f"{root}/{pattern.removeprefix('./')}"
    parts = {"**": r"[^\n]*", "*": "[^/]*", "?": "[^/]"}
    return r"\A" + "".join(parts.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", full)) + r"\z"


def by_default(tool: Column, argument: Column, mode: Column, root: str) -> Column:
    inside = argument.startswith(f"{root}/") | (argument == root)
    return F.when(tool == READ, ALLOW).when(mode.isin(PLAN, BATCH), DENY).when((mode == EDITS) & (tool == WRITE) & inside, ALLOW).otherwise(ASK)


def decision(tool: Column, argument: Column, mode: Column, rules: list[Rule], root: str) -> Column:
    """What is decided on a request. Paths come resolved. A compound command is allowed if all of its parts are."""
    parts = commands(argument)
    of = lambda kind, name: [r.pattern for r in rules if r.decision == kind and r.tool == name]
    either = lambda conditions: reduce(Column.__or__, conditions, F.lit(False))
    any_part = lambda patterns: F.exists(parts, lambda p: either(fits(x, p) for x in patterns))
    all_parts = (F.size(parts) > 0) & F.forall(parts, lambda p: either(fits(x, p) for x in of(ALLOW, RUN)))
    run = F.when(F.exists(parts, lambda p: p.isin(NEVER)), DENY).when(any_part(of(DENY, RUN)), DENY).when(any_part(of(ASK, RUN)), ASK).when(all_parts, ALLOW).otherwise(by_default(tool, argument, mode, root))
    outside = ~(argument.startswith(f"{root}/") | (argument == root))
    path = F.when((mode == BATCH) & (tool == WRITE) & outside, DENY)
    for kind in (DENY, ASK, ALLOW):
        for name in (READ, WRITE):
            path = path.when((tool == name) & either(argument.rlike(glob(x, root)) for x in of(kind, name)), kind)
    path = path.otherwise(by_default(tool, argument, mode, root))
    return F.when(tool.isin(*CONSULTING), F.when(mode == PLAN, DENY).otherwise(ALLOW)).when(~tool.isin(READ, WRITE, RUN), DENY).when(tool == RUN, run).otherwise(path)
