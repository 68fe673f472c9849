"""JSON tools: search and outline, as functions from a dict to a JSON string. They never fail, an error is part of the answer."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from loomseek.errors import QueryError
from loomseek.operators.filters import Filters, PropertyFilter
from loomseek.plans.search import Corpus, default_modes, search_api
from loomseek.sources import discover, orgfile

#: What the two tools take, as callers know it.
SEARCH_INPUT = {
    "type": "object",
    "properties": {
        "query": {"type": "string"},
        "limit": {"type": "integer", "minimum": 1, "maximum": 100},
        "max_heading_level": {"type": "integer", "minimum": 1},
        "property_filters": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "key": {"type": "string"},
                    "op": {"type": "string", "enum": ["equals", "not_equals", "in", "not_in", "exists", "missing"]},
                    "value": {"type": "string"},
                    "values": {"type": "array", "items": {"type": "string"}},
                },
                "required": ["key", "op"],
            },
        },
        "exclude_titles": {"type": "array", "items": {"type": "string"}},
        "property_key": {"type": "string"},
        "property_value": {"type": "string"},
        "modes": {"type": "array", "items": {"type": "string", "enum": ["exact", "lexical", "fuzzy", "semantic"]}},
    },
    "required": ["query"],
}
OUTLINE_INPUT = {
    "type": "object",
    "properties": {"file": {"type": "string"}, "files": {"type": "array", "items": {"type": "string"}}, "max_heading_level": {"type": "integer", "minimum": 1}},
    "required": [],
}


def to_json(value) -> str:
    """JSON with hyphens in the keys and names that callers know."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k).replace("_", "-"): plain(x) if k != "properties" else x for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return v

    return json.dumps(plain(value), ensure_ascii=False)


def filters_from(args: dict, roots: list[str]) -> Filters:
    """Filters of tool arguments; an empty single property is ignored."""
    single = ((args["property_key"], args["property_value"]),) if args.get("property_key") and args.get("property_value") else ()
    many = tuple(PropertyFilter(e.get("key"), (e.get("op") or "").replace("_", "-"), e.get("value"), tuple(e.get("values") or ())) for e in args.get("property_filters") or ())
    return Filters(tuple(roots), single, many, args.get("max_heading_level"), tuple(args.get("exclude_titles") or ()), on_disk=True)


def search_tool(corpus: Corpus, allowed: list[str] | None = None) -> Callable[[dict], str]:
    """The search tool; without any allowed root it refuses."""

    def run(args: dict) -> str:
        try:
            roots = allowed or [r.path for r in corpus.config.roots]
            if not isinstance(args.get("query"), str):
                raise QueryError("`query' string is required")
            if not roots:
                raise QueryError("no root is allowed for search")
            modes = args.get("modes") or default_modes(corpus)
            return to_json(search_api(corpus, args["query"], args.get("limit"), "fuzzy" in modes, filters_from(args, roots), modes).to_dict())
        except Exception as e:
            return to_json({"schema_version": 1, "error": str(e).split("\n")[0]})

    return run


def outline_files(paths: list[str], max_level: int | None = None, most: int = 500) -> dict:
    """Outlines of files read anew; a bad one is listed and the others go on."""
    outlines, errors = [], []
    for path in paths:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                o = orgfile.outline(path, f.read().replace("\r\n", "\n"), most, max_level)
            outlines.append({k: v for k, v in o.items() if k != "error"})
        except OSError as e:
            errors.append({"path": path, "message": str(e)})
    return {"outlines": outlines, "errors": errors}


def outline_tool(allowed: list[str], most: int = 500) -> Callable[[dict], str]:
    """The outline tool; a file outside the allowed roots is an error of its own."""

    def run(args: dict) -> str:
        try:
            files = args.get("files") or ([args["file"]] if args.get("file") else [])
            if not files:
                raise QueryError("`file' or `files' is required")
            if not allowed:
                raise QueryError("no root is allowed for outlines")
            inside = [f for f in files if discover.in_roots(f, allowed)]
            got = outline_files(inside, args.get("max_heading_level"), most)
            got["errors"] += [{"path": f, "message": "Path is outside every allowed root"} for f in files if f not in inside]
            for o in got["outlines"]:
                for h in o["headings"]:
                    h["closed"] = h["closed"] or None  # false is null at this boundary
            return to_json(got)
        except Exception as e:
            return to_json({"error": str(e).split("\n")[0]})

    return run
