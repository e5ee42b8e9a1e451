"""A stand-in for the network: URL -> (status, content type, text), and what was asked for."""

import json

PAGES = {
    "https://one.example/llms-full.txt": (200, "text/plain", "# One\nAll of it."),
    "https://two.example/llms-full.txt": (404, "text/html", "missing"),
    "https://two.example/llms.txt": (200, "text/plain", "# Two\n- [a](b)"),
    "https://three.example/llms-full.txt": (200, "text/plain; charset=utf-8", "  <!DOCTYPE html><p>no"),
    "https://api.github.com/repos/o/r/git/trees/main?recursive=1": (
        200,
        "application/json",
        json.dumps({"sha": "c0ffee", "tree": [{"type": "blob", "path": p} for p in ("docs/a.md", "docs/sub/b.md", "docs/empty.md", "docs/gone.md", "docsother/x.md", "docs/code.cs", "README.md")] + [{"type": "tree", "path": "docs"}]}),
    ),
    "https://raw.githubusercontent.com/o/r/main/docs/a.md": (200, "text/plain", '---\ntitle: Page A\n---\n{% if x %}Text{% endif %} here.\n:::code source="code.cs" range="2" language="csharp":::\n:::code source="none.cs":::\n'),
    "https://raw.githubusercontent.com/o/r/main/docs/sub/b.md": (200, "text/plain", "# B\nSecond page."),
    "https://raw.githubusercontent.com/o/r/main/docs/empty.md": (200, "text/plain", "---\ntitle: moved\n---\n\n"),
    "https://raw.githubusercontent.com/o/r/main/docs/code.cs": (200, "text/plain", "// one\nvar two = 2;\n"),
    "https://api.github.com/repos/o/cut/git/trees/main?recursive=1": (200, "application/json", json.dumps({"sha": "x", "truncated": True, "tree": []})),
}

SOURCES = """
[[source]]
name = "one"
url = "https://one.example/llms-full.txt"
[[source]]
name = "two"
url = "https://two.example/llms-full.txt"
[[source]]
name = "three"
url = "https://three.example/llms-full.txt"
[[source]]
name = "repo"
kind = "github"
owner = "o"
repo = "r"
ref = "main"
prefixes = ["docs"]
[[source]]
name = "cut"
kind = "github"
owner = "o"
repo = "cut"
ref = "main"
prefixes = [""]
[[source]]
name = "here"
kind = "local"
path = "notes.md"
title = "Notes"
"""


def fetch(url):
    return PAGES.get(url, (404, "text/plain", ""))


def fetch_changed(url):
    status, kind, text = fetch(url)
    return status, kind, text.replace("Second page.", "Second page, again.")
