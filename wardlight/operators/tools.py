"""Lookups by name: what an investigation may ask, with errors as answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tool:
    """A table function under a name: ``run(**arguments)`` gives a DataFrame. arguments: name to (JSON type, whether it is required)."""

    name: str
    about: str
    arguments: dict[str, tuple[str, bool]]
    run: Callable[..., DataFrame]

    def schema(self) -> dict:
        """The JSON schema of its arguments."""
        kinds = {n: {"type": kind} for n, (kind, _) in self.arguments.items()}
        return {"name": self.name, "description": self.about, "input_schema": {"type": "object", "properties": kinds, "required": [n for n, (_, needed) in self.arguments.items() if needed]}}


@dataclass(frozen=True)
class Answer:
    tool: str
    success: bool
    rows: DataFrame | None = None
    error: str | None = None
    callers_fault: bool = False


class Tools:
    """A fixed set of tools in order; changes give a new set."""

    def __init__(self, *tools: Tool):
        self.by_name = {t.name: t for t in tools}
        if len(self.by_name) < len(tools):
            raise ValueError("a name is taken twice")

    def schemas(self) -> list[dict]:
        return [t.schema() for t in self.by_name.values()]

    def without(self, *names: str) -> Tools:
        """The set without these; a name that isn't there is an error."""
        if unknown := sorted(set(names) - set(self.by_name)):
            raise ValueError(f"no such tools: {unknown}")
        return Tools(*(t for n, t in self.by_name.items() if n not in names))

    def replacing(self, *tools: Tool) -> Tools:
        """The set with these in the places of tools of their names, new ones at the end."""
        return Tools(*(self.by_name | {t.name: t for t in tools}).values())

    def ask(self, name: str, arguments: dict) -> Answer:
        """The answer of a tool. An unknown name, wrong arguments and a failure are answers too, never exceptions."""
        tool = self.by_name.get(name)
        if tool is None:
            return Answer(name, False, error=f"unknown tool: {name}", callers_fault=True)
        lacking = [n for n, (_, needed) in tool.arguments.items() if needed and n not in arguments]
        if lacking or not set(arguments) <= set(tool.arguments):
            return Answer(name, False, error=f"{name} takes {sorted(tool.arguments)}, needs {lacking}, got {sorted(arguments)}", callers_fault=True)
        try:
            return Answer(name, True, rows=tool.run(**arguments))
        except Exception as e:
            return Answer(name, False, error=f"{name} failed: {type(e).__name__}: {e}")


def renamed(tool: Tool, name: str) -> Tool:
    return replace(tool, name=name)


_FENCE = re.compile(r"\A```[^\n]*\n(.*?)(?:\n```[^\n]*)?\Z", re.S)


def json_in(text: str, key: str = "alert_id") -> dict:
    """The JSON object that a free text ends in: the whole text, fenced or not, or else the last top-level object that has ``key``, or the last one at all."""
    bare = (text or "").strip()
    if fenced := _FENCE.match(bare):
        bare = fenced[1].strip()
    reader, found, at = json.JSONDecoder(strict=False), [], 0
    while (at := bare.find("{", at)) >= 0:
        try:
            value, end = reader.raw_decode(bare, at)
        except ValueError:
            at += 1
            continue
        found.append(value)
        at = end
    if not found:
        raise ValueError("no JSON object in the text")
    return next((v for v in reversed(found) if key in v), found[-1])
