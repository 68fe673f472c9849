"""Org files as records: one for the file, one for each heading in order.

A line parser for what retrieval needs: headings with keyword, priority and
tags, planning lines, property drawers, keyword lines, and the paragraphs that
stand directly under a heading: also those of list items, footnote
definitions, drawers, and quote, center and special blocks. Tables, source,
example, export, comment and verse blocks, LaTeX environments, comments and
property drawers hold no paragraphs. Files parse independently of each other.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from loomseek import schema

_HEAD = re.compile(r"^(\*+)[ \t]+(.*)$")
_KEYWORD = re.compile(r"^[ \t]*#\+(\w+):[ \t]*(.*?)[ \t]*$")
_TAGS = re.compile(r"(?:^|[ \t]+)(:[\w@#%:]+:)[ \t]*$")
_PRIORITY = re.compile(r"^\[#([A-Z0-9])\][ \t]*")
_PLANNING = re.compile(r"^[ \t]*(?:(?:SCHEDULED|DEADLINE|CLOSED):[ \t]*[<\[][^>\]]*[>\]][ \t]*)+$")
_PROPERTY = re.compile(r"^[ \t]*:([^:\s]+):(?:[ \t]+(.*?))?[ \t]*$")
_DRAWER = re.compile(r"^[ \t]*:([\w-]+):[ \t]*$")
_END = re.compile(r"^[ \t]*:END:[ \t]*$", re.I)
_BEGIN = re.compile(r"^[ \t]*#\+begin_(\w+)", re.I)
_ITEM = re.compile(r"^[ \t]*(?:[-+]|\d+[.)])(?:[ \t]+|$)|^[ \t]+\*[ \t]")
_LATEX = re.compile(r"^[ \t]*\\begin\{([^{}\n]+)\}")
_FOOTNOTE = re.compile(r"^\[fn:[^\]\s]+\][ \t]*")
#: Blocks whose lines are no Org text.
_RAW = ("src", "example", "export", "comment", "verse")
_DONE = ("DONE",)
_TODO = ("TODO",)


@dataclass
class Heading:
    level: int
    title: str
    position: int
    todo: str | None = None
    priority: str | None = None
    tags: list[str] = field(default_factory=list)
    own: dict[str, str] = field(default_factory=dict)
    body: str = ""
    parent: Heading | None = None

    def path(self) -> list[str]:
        return [*(self.parent.path() if self.parent else []), self.title]

    def properties(self, of_file: dict[str, str]) -> dict[str, str]:
        """The file's properties, overlaid by the ancestors', the nearest last."""
        return {**(self.parent.properties(of_file) if self.parent else of_file), **self.own}


@dataclass
class Parsed:
    title: str
    body: str
    properties: dict[str, str]
    headings: list[Heading]
    done: tuple[str, ...]


def paragraphs(lines: list[str]) -> str:
    """Trimmed paragraphs of a section's lines, one after another."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            out.append("\n".join(held).strip())
            held.clear()

    endless: set[str] = set()  # ends that don't come any more

    def end_of(pattern: str, start: int) -> int | None:
        if pattern in endless:
            return None
        end = re.compile(pattern, re.I)
        stop = next((k for k in range(start, len(lines)) if end.match(lines[k])), None)
        if stop is None:
            endless.add(pattern)
        return stop

    i, marks = 0, set()  # marks: lines that only end a block or drawer
    while i < len(lines):
        line = lines[i]
        stop, inside = None, False
        if m := _BEGIN.match(line):
            stop, inside = end_of(rf"^[ \t]*#\+end_{re.escape(m.group(1))}[ \t]*$", i + 1), m.group(1).lower() not in _RAW
        elif m := _LATEX.match(line):
            stop = end_of(rf"^[ \t]*\\end\{{{re.escape(m.group(1))}\}}[ \t]*$", i)
        elif (m := _DRAWER.match(line)) and not _END.match(line):
            stop, inside = end_of(_END.pattern, i + 1), m.group(1).upper() != "PROPERTIES"
        if stop is not None or i in marks:
            close()
            if inside:
                marks.add(stop)
            i = i + 1 if inside or stop is None else stop + 1
            continue
        if m := _FOOTNOTE.match(line):
            close()
            line = line[m.end() :]
        s = line.strip()
        if not s or _KEYWORD.match(line) or s.startswith("|") or re.match(r"^#(?: |$)", s) or re.match(r"^:(?: |$)", s) or re.match(r"^-{5,}$", s) or s.startswith("CLOCK:"):
            close()
        elif m := _ITEM.match(line):
            close()
            held.append(re.sub(r"^\[[ xX-]\][ \t]+", "", line[m.end() :]))
        else:
            held.append(line.strip())
        i += 1
    close()
    return "\n".join(p for p in out if p)


def parse(text: str, name: str) -> Parsed:
    """A file's records from its text and base name."""
    lines = text.split("\n")
    todo, done = list(_TODO), list(_DONE)
    title, of_file = None, {}
    own_words = False
    for line in lines:
        if m := _KEYWORD.match(line):
            key, value = m.group(1).upper(), m.group(2)
            if key == "TITLE" and title is None:
                title = value
            elif key in ("TODO", "SEQ_TODO", "TYP_TODO"):
                left, bar, right = value.partition("|")
                words = [re.sub(r"\(.*?\)$", "", w) for w in left.split()]
                if not own_words:
                    todo, done, own_words = [], [], True
                if bar:
                    todo += words
                    done += [re.sub(r"\(.*?\)$", "", w) for w in right.split()]
                else:
                    todo += words[:-1]
                    done += words[-1:]
    headings: list[Heading] = []
    sections: list[list[str]] = [[]]
    at = 1
    stack: list[Heading] = []
    in_block = None
    for line in lines:
        if in_block is None and (m := _BEGIN.match(line)):
            in_block = re.compile(rf"^[ \t]*#\+end_{re.escape(m.group(1))}[ \t]*$", re.I)
        elif in_block is not None and in_block.match(line):
            in_block = None
        if m := _HEAD.match(line):
            in_block = None
            h = Heading(len(m.group(1)), m.group(2).strip(), at)
            rest = h.title
            word = rest.split(" ", 1)[0]
            if word in todo or word in done:
                h.todo, rest = word, rest[len(word) :].lstrip()
            if p := _PRIORITY.match(rest):
                h.priority, rest = p.group(1), rest[p.end() :]
            if t := _TAGS.search(rest):
                h.tags = [x for x in t.group(1).split(":") if x]
                rest = rest[: t.start()]
            h.title = rest.strip()
            while stack and stack[-1].level >= h.level:
                stack.pop()
            h.parent = stack[-1] if stack else None
            stack.append(h)
            headings.append(h)
            sections.append([])
        else:
            sections[-1].append(line)
            k = _KEYWORD.match(line)
            if k and k.group(1).upper() == "PROPERTY" and in_block is None:
                key, _, value = k.group(2).partition(" ")
                if key and value.strip():
                    of_file.setdefault(key, value.strip())
        at += len(line) + 1
    for h, section in zip(headings, sections[1:]):
        i = 0
        while i < len(section) and _PLANNING.match(section[i]):
            i += 1
        if i < len(section) and section[i].strip().upper() == ":PROPERTIES:":
            for k in range(i + 1, len(section)):
                if _END.match(section[k]):
                    i = k + 1
                    break
                if p := _PROPERTY.match(section[k]):
                    h.own[p.group(1).upper()] = p.group(2) or ""
        h.body = paragraphs(section[i:])
    return Parsed(title if title is not None else os.path.splitext(name)[0], paragraphs(sections[0]), of_file, headings, tuple(done))


def records(path: str, digest: str, text: str) -> list[dict]:
    """Target rows of one file."""
    p = parse(text, os.path.basename(path))
    base = {"path": path, "digest": digest}
    out = [base | {"key": f"{path}#file", "kind": "file", "title": p.title, "body": p.body, "org_id": None, "position": 1, "level": 0, "outline_path": [], "properties": p.properties}]
    for n, h in enumerate(p.headings, 1):
        out.append(base | {"key": f"{path}@{digest}#heading:{n}", "kind": "heading", "title": h.title, "body": h.body, "org_id": h.own.get("ID"), "position": h.position, "level": h.level, "outline_path": h.path(), "properties": h.properties(p.properties)})
    return out


def outline(path: str, text: str, most: int = 500, max_level: int | None = None) -> dict:
    """One file's headings; the count and the cap are those of the whole file."""
    p = parse(text, os.path.basename(path))
    shown = [
        {"level": h.level, "title": h.title, "todo_keyword": h.todo, "closed": h.todo in p.done if h.todo else False, "priority": h.priority, "tags": h.tags, "org_id": h.own.get("ID"), "outline_path": h.path(), "properties": h.properties(p.properties)}
        for h in p.headings[:most]
    ]
    shown = [h for h in shown if max_level is None or h["level"] <= max_level]
    return {"path": path, "title": p.title, "properties": p.properties, "headings": shown, "heading_count": len(p.headings), "truncated": len(p.headings) > most, "error": None}


def _text(content) -> str:
    return bytes(content).decode("utf-8", "replace").replace("\r\n", "\n")


def project(files: DataFrame) -> DataFrame:
    """Target rows of (path, content, digest) files, and for a file that can't be parsed one row with kind 'error'."""

    names = schema.target().fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[dict] = []
            for path, content, digest in zip(pdf["path"], pdf["content"], pdf["digest"]):
                try:
                    rows += records(path, digest, _text(content))
                except Exception as e:  # one bad file must not stop the others
                    rows.append(dict.fromkeys(names) | {"key": f"{path}#error", "path": path, "kind": "error", "title": str(e), "digest": digest})
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "digest").mapInPandas(run, schema.target())


def outlines(files: DataFrame, most: int = 500, max_level: int | None = None) -> DataFrame:
    """Outline rows of (path, content) files; a bad file gives a row with an error."""

    names = schema.outline().fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append(outline(path, _text(content), most, max_level))
                except Exception as e:
                    rows.append(dict.fromkeys(names) | {"path": path, "error": str(e)})
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema.outline())
