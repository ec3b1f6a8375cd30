"""Closed JSON schemas read from a folder, by document type and version."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame

from plyforge.operators.reconcile import schema_violations

#: What the compiled checks understand; a schema with anything else is refused.
KEYWORDS = {"type", "enum", "required", "properties", "additionalProperties", "items", "minLength", "pattern", "format", "minimum"}
FORMATS = {"sha256-hex", "utc-iso8601", "relative-neutral-path"}


class UnknownSchema(LookupError):
    """No schema of that type and version."""


def _walk(schema: Mapping) -> Iterator[Mapping]:
    yield schema
    for sub in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        yield from _walk(sub)


class Schemas:
    """``<root>/<version>/<type>.schema.json``, read once and checked for what can't be compiled."""

    def __init__(self, root: str):
        self.root = root
        self._held: dict[tuple[str, str], Mapping] = {}

    def types(self) -> list[tuple[str, str]]:
        out = []
        for version in sorted(os.listdir(self.root)):
            at = os.path.join(self.root, version)
            if os.path.isdir(at):
                out += [(f.removesuffix(".schema.json"), version) for f in sorted(os.listdir(at)) if f.endswith(".schema.json")]
        return out

    def get(self, kind: str, version: str) -> Mapping:
        if (kind, version) not in self._held:
            path = os.path.join(self.root, version, f"{kind}.schema.json")
            if not os.path.isfile(path):
                raise UnknownSchema(f"{kind} {version}")
            with open(path, encoding="utf-8") as f:
                schema = json.load(f)
            odd = {k for s in _walk(schema) for k in s} - KEYWORDS
            formats = {s["format"] for s in _walk(schema) if "format" in s} - FORMATS
            if odd or formats:
                raise ValueError(f"{path}: not understood: {sorted(odd | formats)}")
            self._held[kind, version] = schema
        return self._held[kind, version]

    def violations(self, docs: DataFrame, key: str, text: str, kind: str, version: str) -> DataFrame:
        return schema_violations(docs, key, text, self.get(kind, version))
