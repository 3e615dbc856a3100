"""Source URIs and the registry of loaders."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import parse_qsl

from tidewell.plans.dialect import QueryError

STDIN, FILE, SQLITE, PARQUET = "stdin", "file", "sqlite", "parquet"


@dataclass(frozen=True)
class SourceSpec:
    """A named source. ``format`` is csv, json, sqlite, parquet or stdin."""

    name: str
    format: str
    path: str = ""
    table: str = ""

    @property
    def streaming(self) -> bool:
        return self.format == STDIN


def parse_uri(name: str, uri: str) -> SourceSpec:
    """``stdin`` or nothing, ``file://path`` or a path (csv, json, jsonl, parquet), ``sqlite://path[?table=t]``."""
    if uri in ("", STDIN):
        return SourceSpec(name, STDIN)
    scheme, parted, rest = uri.partition("://")
    if not parted:
        scheme, rest = FILE, uri
    if scheme == SQLITE:
        path, _, query = rest.partition("?")
        return SourceSpec(name, SQLITE, path, dict(parse_qsl(query)).get("table") or name)
    if scheme == FILE:
        suffix = PurePosixPath(rest.rstrip("/")).suffix.lower()
        known = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": PARQUET}
        if suffix not in known:
            raise QueryError(f"unsupported file type: {suffix or rest}")
        return SourceSpec(name, known[suffix], rest)
    raise QueryError(f"unsupported source: {scheme}://")


def parse_binding(text: str) -> SourceSpec:
    """``name=uri`` as given on the command line."""
    name, given, uri = text.partition("=")
    if not given or not name:
        raise QueryError(f"a source is given as name=uri, not {text!r}")
    return parse_uri(name, uri)
