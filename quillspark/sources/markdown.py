"""Markdown: front matter, sections as units, heading normalisation and document blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

_FENCE = re.compile(r"[ \t]*(`{3,})(.*)$")
_HEADING = re.compile(r"(#{1,6})(\s+)(.*)$")


def fenced(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """Each line with whether it belongs to a code fence; a fence closes with as many ticks at least and nothing else."""
    ticks = 0
    for line in lines:
        m = _FENCE.match(line)
        inside = ticks > 0 or m is not None
        if m and not ticks:
            ticks = len(m[1])
        elif m and len(m[1]) >= ticks and not m[2].strip():
            ticks = 0
        yield line, inside


def scalar(value: str) -> Any:
    """A front-matter value as int, float or text; None for nothing and for lists."""
    value = value.strip()
    if not value or value[0] == "[":
        return None
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def front_matter(lines: list[str]) -> tuple[dict[str, Any], list[str], list[str]]:
    """(attributes, list values, body lines); an unclosed block is body."""
    close = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0) if lines and lines[0].strip() == "---" else 0
    if not close:
        return {}, [], lines
    attributes, listed = {}, []
    for line in lines[1:close]:
        key, colon, value = line.partition(":")
        if not colon or not key.strip() or line[0].isspace():
            continue
        if value.strip().startswith("["):
            listed += [x.strip() for x in value.strip().strip("[]").split(",") if x.strip()]
        elif (found := scalar(value)) is not None:
            attributes[key.strip()] = found
    return attributes, listed, lines[close + 1 :]


def units(text: str) -> list[dict[str, Any]]:
    """Units of a file: one per level-two section outside fences, under the file's title and its listed values."""
    attributes, listed, lines = front_matter(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    title, sections = "", [("", [])]
    for line, code in fenced(lines):
        if not code and line.startswith("## "):
            sections.append((line[3:].strip(), []))
        elif not code and not title and line.startswith("# "):
            title = line[2:].strip()
        else:
            sections[-1][1].append(line)
    out = []
    for heading, body in sections:
        content = "\n".join(body).strip()
        if content:
            head = [x for x in (title, " ".join(listed), heading) if x]
            out.append({"text": "\n".join([*head, content]), "location_type": "section", "location": len(out) + 1, "heading": heading, "attributes": attributes})
    return out


def normalised_headings(text: str, section_level: int = 2, demote_h1: bool = False) -> str:
    """Headings without attribute blocks, levels up to section_level raised to two; lone anchors go."""
    out = []
    for line, code in fenced(text.split("\n")):
        if not code:
            bare = re.sub(r'<span id="[^"]*"></span>', "", line)
            if line.strip() and not bare.strip():
                continue
            line = bare
            if m := _HEADING.match(line):
                level = len(m[1])
                level = (2 if demote_h1 else 1) if level == 1 else max(2, level - max(0, section_level - 2)) if level > 2 else 2
                line = "#" * level + m[2] + re.sub(r"\s*\{[#.][^}]*\}\s*$", "", m[3])
        out.append(line)
    return "\n".join(out)


def blocks(text: str) -> list[dict[str, Any]]:
    """A document as blocks of kind heading, code, diagram, table, bullets or paragraph."""
    out: list[dict[str, Any]] = []
    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            end = next((j for j in range(i + 1, len(lines)) if (f := _FENCE.match(lines[j])) and len(f[1]) >= len(m[1]) and not f[2].strip()), len(lines))
            info = m[2].strip()
            out.append({"kind": "diagram" if info == "mermaid" else "code", "language": info, "text": "\n".join(lines[i + 1 : end])})
            i = end + 1
        elif m := _HEADING.match(line):
            out.append({"kind": "heading", "level": len(m[1]), "text": m[3].strip()})
            i += 1
        elif line.lstrip().startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", lines[i + 1]):
            end = i
            while end < len(lines) and lines[end].lstrip().startswith("|"):
                end += 1
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines[i:end]]
            out.append({"kind": "table", "header": rows[0], "rows": rows[2:]})
            i = end
        elif re.match(r"\s*[-*+]\s+", line):
            items = []
            while i < len(lines) and re.match(r"\s*[-*+]\s+", lines[i]):
                items.append(re.sub(r"^\s*[-*+]\s+", "", lines[i]))
                i += 1
            out.append({"kind": "bullets", "items": items})
        elif line.strip():
            start = i
            while i < len(lines) and lines[i].strip() and not (_FENCE.match(lines[i]) or _HEADING.match(lines[i]) or re.match(r"\s*[-*+]\s+", lines[i])):
                i += 1
            out.append({"kind": "paragraph", "text": "\n".join(lines[start:i])})
        else:
            i += 1
    return out


def rendered(parts: list[dict[str, Any]]) -> str:
    """Blocks as Markdown again."""
    out = []
    for b in parts:
        if b["kind"] == "heading":
            out.append("#" * b["level"] + " " + b["text"])
        elif b["kind"] in ("code", "diagram"):
            out.append(f"```{b['language']}\n{b['text']}\n```")
        elif b["kind"] == "table":
            out.append("\n".join("| " + " | ".join(r) + " |" for r in [b["header"], ["---"] * len(b["header"]), *b["rows"]]))
        elif b["kind"] == "bullets":
            out.append("\n".join("- " + x for x in b["items"]))
        else:
            out.append(b["text"])
    return "\n\n".join(out)
