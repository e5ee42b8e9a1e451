"""Images and scanned pages as units, with models and readers that are handed in: none of them is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from ..functions.text import CAPTION_MARK, LEAST_OCR, NO_CONTENT, OCR_MARK

#: A page with fewer characters of text than this is looked at as an image (fixed value).
LEAST_PAGE = 30

Model = Callable[[bytes], str | None]


def block(caption: str | None, ocr: str | None) -> str:
    """Caption and recognised text as one block; decorations and scraps of text are left out."""
    said, read = (caption or "").strip(), (ocr or "").strip()
    parts = [CAPTION_MARK + said] if said and said.rstrip("。.") != NO_CONTENT else []
    return "\n".join(parts + ([OCR_MARK + read] if len(read) >= LEAST_OCR else []))


def described(image: bytes, caption: Model | None, ocr: Model | None) -> tuple[str, list[str]]:
    """An image's block, and what went wrong; where one model fails the other's answer still counts."""
    said: dict[str, str | None] = {}
    errors = []
    for name, model in (("caption", caption), ("ocr", ocr)):
        try:
            said[name] = model(image) if model else None
        except Exception as error:  # any model may fail in its own way
            errors.append(f"{name}: {type(error).__name__}: {error}")
    return block(said.get("caption"), said.get("ocr")), errors


def _unit(text: str, kind: str, number: int, recognised: bool) -> dict[str, Any]:
    return {"text": text, "location_type": kind, "location": number, "heading": "", "ocr": recognised, "vlm": CAPTION_MARK in text, "attributes": {}, "warnings": []}


def image_parser(caption: Model | None = None, ocr: Model | None = None) -> Callable[[bytes], list[dict[str, Any]]]:
    """A parser for image files: one unit, or none for an image without content. It raises if all models failed."""

    def parse(content: bytes) -> list[dict[str, Any]]:
        text, errors = described(content, caption, ocr)
        if not text and errors:
            raise ValueError("; ".join(errors))
        return [_unit(text, "image", 1, OCR_MARK in text) | {"warnings": errors}] if text else []

    return parse


def page_parser(pages: Callable[[bytes], Iterable[tuple[str, bytes | None]]], caption: Model | None = None, ocr: Model | None = None) -> Callable[[bytes], list[dict[str, Any]]]:
    """A parser for page files, given a reader of each page's (text, image): pages with little text are described from their image.

    A page that can't be read is skipped, with a warning at the file's first unit; a file of which none can is an error.
    """

    def parse(content: bytes) -> list[dict[str, Any]]:
        out, errors, n = [], [], 0
        for n, (text, image) in enumerate(pages(content), 1):
            body, recognised = text.strip(), False
            if len(body) < LEAST_PAGE and image is not None:
                seen, wrong = described(image, caption, ocr)
                errors += [f"page {n}: {x}" for x in wrong]
                if seen:
                    body, recognised = seen, True
            if body:
                out.append(_unit(body, "page", n, recognised))
        if n and not out and errors:
            raise ValueError("; ".join(errors))
        if out:
            out[0]["warnings"] = errors
        return out

    return parse
