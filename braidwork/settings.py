"""Settings from an INI file: where the graph store, the cache and the results lie."""

from __future__ import annotations

import os
from collections.abc import Mapping
from configparser import ConfigParser
from pathlib import Path

from .plans.store import DEFAULT_GRAPH

#: Section -> option -> value, for what a file doesn't say.
DEFAULTS: dict[str, dict[str, str]] = {"store": {"path": "braidwork-store", "default_graph": DEFAULT_GRAPH}, "results": {"path": "braidwork-results"}}


def places(environment: Mapping[str, str] = os.environ) -> list[Path]:
    """Files that are looked for, the first that is there counting: the working folder's, and the user's."""
    home = environment.get("XDG_CONFIG_HOME") or Path(environment.get("HOME", "~")).expanduser() / ".config"
    return [Path("braidwork.ini"), Path(home) / "braidwork.ini"]


def settings(paths: list[Path] | None = None) -> dict[str, dict[str, str]]:
    """All sections; without a file, or for what it leaves out, the defaults. Nothing is written."""
    parser = ConfigParser(interpolation=None)
    parser.read_dict(DEFAULTS)
    for path in places() if paths is None else paths:
        if parser.read(path):
            break
    return {s: dict(parser[s]) for s in parser.sections()}
