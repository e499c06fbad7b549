"""Default expressions: constants, sequences and known functions are translated, the rest is refused (PLN2, PLN3)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+")
_STRING = re.compile(r"[Nn]?('(?:[^']|'')*')")
_NEXT = re.compile(r"next\s+value\s+for\s+(.+)", re.I | re.S)
_CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(\s*\)")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Translated:
    expr: str | None = None
    warn: str | None = None
    error: str | None = None


def bare(text: str) -> str:
    """Without the parentheses that enclose all of it."""
    text = text.strip()
    while text.startswith("(") and _closes(text) == len(text) - 1:
        text = text[1:-1].strip()
    return text


def _closes(text: str) -> int:
    """Where the parenthesis that text begins with is closed; quotes hide what is in them."""
    depth, quote = 0, False
    for i, c in enumerate(text):
        if c == "'":
            quote = not quote
        elif not quote:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return i
    return -1


def identifier_parts(text: str) -> list[str] | None:
    """The parts of ``[a].[b]``, ``"a"."b"`` or ``a.b``; a doubled closing mark is the mark itself."""
    part = re.compile(r'\s*(?:\[((?:[^\]]|\]\])*)\]|"((?:[^"]|"")*)"|([A-Za-z_@#][\w@#$]*))\s*')
    out, at = [], 0
    while True:
        m = part.match(text, at)
        if not m:
            return None
        out.append(m[1].replace("]]", "]") if m[1] is not None else m[2].replace('""', '"') if m[2] is not None else m[3])
        at = m.end()
        if at == len(text):
            return out
        if text[at] != ".":
            return None
        at += 1


def translate(definition: str, target_type: str, functions: dict, schema: str, sequence: Callable[[str, str], str | None]) -> Translated:
    """``sequence(schema, name)`` gives a sequence's quoted target name, or None if it isn't moved."""
    text, sign = bare(definition), ""
    while text[:1] in "+-" and text:
        sign = {"": "-", "-": ""}[sign] if text[0] == "-" else sign
        text = bare(text[1:])
    if _NUMBER.fullmatch(text):
        return _number(sign, text, target_type)
    if sign:
        return _refused(definition)
    if text.lower() == "null":
        return Translated()
    if m := _STRING.fullmatch(text):
        return Translated(m[1])
    if m := _NEXT.fullmatch(text):
        parts = identifier_parts(m[1].strip())
        if not parts:
            return _refused(definition)
        at, name = (parts[-2] if len(parts) > 1 else schema), parts[-1]
        target = sequence(at, name)
        return Translated(f"nextval('{target.replace(chr(39), chr(39) * 2)}'::regclass)") if target else Translated(error=f"sequence {at}.{name} is not moved")
    call = _CALL.fullmatch(text) or _WORD.fullmatch(text)
    if call:
        name = (call[1] if call.re is _CALL else call[0]).lower()
        if known := functions.get(name):
            return Translated(known["to"], known.get("warn"))
        return Translated(error=f"function {name} is not in defaults.functions: {definition}")
    return _refused(definition)


def _number(sign: str, digits: str, target_type: str) -> Translated:
    if target_type == "boolean":
        return Translated({"0": "false", "1": "true"}[digits]) if digits in ("0", "1") and not sign else Translated(error=f"a boolean's default is 0/1, not {sign}{digits}")
    return Translated(sign + digits)


def _refused(definition: str) -> Translated:
    return Translated(error=f"not translated automatically: {definition}")
