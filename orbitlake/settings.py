"""Settings of the command line, from layers: the environment, then the user's file, the system's, and the defaults."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

#: Name of each setting and its default.
DEFAULTS = {"store": "", "sets": ".", "window_days": "60", "lookback_days": "7"}
PREFIX = "ORBITLAKE_"
USER, SYSTEM = Path("~/.config/orbitlake.json"), Path("/etc/orbitlake.json")


def _layer(path: Path) -> dict:
    at = path.expanduser()
    return json.loads(at.read_text()) if at.is_file() else {}


def settings(env: Mapping[str, str] | None = None, user: Path = USER, system: Path = SYSTEM) -> dict[str, tuple[str, str]]:
    """Each setting with where it comes from; the first layer that has a value holds."""
    env = os.environ if env is None else env
    layers = [("environment", {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)}), (str(user), _layer(user)), (str(system), _layer(system))]
    out = {}
    for name, default in DEFAULTS.items():
        out[name] = next(((str(d[name]), where) for where, d in layers if d.get(name) not in (None, "")), (default, "default"))
    return out
