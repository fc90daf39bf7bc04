"""Replacement templates: `$$`, `$1`, `$name`, `${name}`; a missing group is empty, an unclosed brace is plain text."""

from __future__ import annotations

from textlode.functions.dialect import Compiled


def parts(template: str, compiled: Compiled) -> list[str | int]:
    """Plain text and group numbers; references to groups that don't exist are left out."""
    out: list[str | int] = []

    def text(s: str) -> None:
        if out and isinstance(out[-1], str):
            out[-1] += s
        elif s:
            out.append(s)

    def group(name: str) -> None:
        number = int(name) if name.isascii() and name.isdigit() else compiled.names.get(name)
        if number is not None and number <= compiled.n_groups:
            out.append(number)

    at = 0
    while at < len(template):
        c = template[at]
        if c != "$":
            text(c)
            at += 1
        elif template[at + 1 : at + 2] == "$":
            text("$")
            at += 2
        elif template[at + 1 : at + 2] == "{":
            end = template.find("}", at)
            if end < 0 or end == at + 2:
                text("${" if end < 0 else "${}")
                at += 2 if end < 0 else 3
            else:
                group(template[at + 2 : end])
                at = end + 1
        else:
            end = at + 1
            digits = template[end : end + 1].isascii() and template[end : end + 1].isdigit()
            while end < len(template) and template[end].isascii() and (template[end].isdigit() if digits else template[end].isalnum() or template[end] == "_"):
                end += 1
            if end == at + 1:
                text("$")
            else:
                group(template[at + 1 : end])
            at = max(end, at + 1)
    return out


def java(template: str, compiled: Compiled) -> str:
    """The template for Java: plain text is escaped character by character, so that no digit joins a group's number."""
    return "".join(f"${p}" if isinstance(p, int) else "".join(f"\\{c}" if c in "\\$" or c.isdigit() else c for c in p) for p in parts(template, compiled))
