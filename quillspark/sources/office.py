"""Office files, which are zipped XML: Word, Excel and PowerPoint to units."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from typing import Any
from xml.etree import ElementTree

#: Row height, in English metric units, within which shapes count as side by side; a slide group's greatest length (fixed values).
ROW, GROUP = 228_600, 200


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if _local(x) == name]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _links(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (kind, part) of a part."""
    folder, name = posixpath.split(part)
    root = _xml(archive, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in root if root is not None else ():
        target = r.get("Target", "")
        out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
    return out


def _relation(node: ElementTree.Element) -> str | None:
    return next((v for k, v in node.attrib.items() if k.endswith("relationships}id")), None)


def _unit(text: str, kind: str, location: int, heading: str = "") -> dict[str, Any]:
    return {"text": text, "location_type": kind, "location": location, "heading": heading, "attributes": {}}


def docx_units(content: bytes) -> list[dict[str, Any]]:
    """A document as one unit: its paragraphs in order, those of tables included."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = _xml(archive, "word/document.xml")
    lines = []
    for p in _all(root, "p") if root is not None else ():
        text = "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in p.iter())
        if text.strip():
            lines.append(text.strip())
    return [_unit("\n".join(lines), "document", 0)] if lines else []


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def xlsx_units(content: bytes) -> list[dict[str, Any]]:
    """One unit per sheet with content; cells as last calculated, trailing empty ones left off."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared_root = _xml(archive, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(shared_root, "si")] if shared_root is not None else []
        links, out = _links(archive, "xl/workbook.xml"), []
        for sheet in _all(_xml(archive, "xl/workbook.xml"), "sheet"):
            root, rows = _xml(archive, links[_relation(sheet)][1]), []
            for row in _all(root, "row"):
                cells: list[str] = []
                for c in _all(row, "c"):
                    value = next((v.text or "" for v in c if _local(v) == "v"), "")
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in _all(c, "t"))
                    cells += [""] * (_column(c.get("r", "")) - len(cells)) + [value.strip()]
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    rows.append(" | ".join(cells))
            if rows:
                name = sheet.get("name", "")
                out.append(_unit("\n".join([name, *rows]), "sheet", len(out) + 1, name))
    return out


def _blocks(shapes: ElementTree.Element, number: int) -> list[tuple[tuple[int, int], str]]:
    """(row, left) and text of each shape, those inside groups included, without copyright lines and the slide's own number."""
    out = []
    for shape in shapes:
        kind = _local(shape)
        if kind == "grpSp":
            out += _blocks(shape, number)
        elif kind in ("sp", "graphicFrame"):
            rows = [" | ".join("".join(t.text or "" for t in _all(c, "t")).strip() for c in _all(r, "tc")) for r in _all(shape, "tr")]
            text = "\n".join(rows) if rows else "\n".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(shape, "p"))
            kept = [x.strip() for x in text.split("\n") if x.strip() not in ("", str(number)) and not x.strip().startswith("©")]
            off = next(iter(_all(shape, "off")), None)
            at = (round(int(off.get("y", 0)) / ROW), int(off.get("x", 0))) if off is not None else (1 << 30, 1 << 30)
            if kept:
                out.append((at, "\n".join(kept)))
    return out


def grouped(blocks: list[str], limit: int = GROUP) -> list[str]:
    """Blocks packed in order into texts of at most limit characters, the line ends between them not counted; a longer one stands alone."""
    out: list[list[str]] = []
    for block in blocks:
        if out and sum(map(len, out[-1])) + len(block) <= limit:
            out[-1].append(block)
        else:
            out.append([block])
    return ["\n".join(x) for x in out]


def pptx_units(content: bytes) -> list[dict[str, Any]]:
    """Units of at most GROUP characters per slide, each under the slide's title; notes come last."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        links, out = _links(archive, "ppt/presentation.xml"), []
        for number, entry in enumerate(_all(_xml(archive, "ppt/presentation.xml"), "sldId"), 1):
            part = links[_relation(entry)][1]
            tree = next(iter(_all(_xml(archive, part), "spTree")), None)
            texts = [t for _, t in sorted(_blocks(tree, number), key=lambda b: b[0])] if tree is not None else []
            note = next((p for kind, p in _links(archive, part).values() if kind == "notesSlide"), None)
            if note and (root := _xml(archive, note)) is not None:
                texts += [t for _, t in _blocks(next(iter(_all(root, "spTree"))), number)]
            if not texts:
                continue
            title, _, rest = texts[0].partition("\n")
            bodies = grouped([x for x in [rest, *texts[1:]] if x]) or [""]
            out += [_unit(f"{title}\n{x}" if x else title, "slide", number, title) for x in bodies]
    return out
