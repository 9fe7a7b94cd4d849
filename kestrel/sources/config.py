"""Settings from a ``.env`` file; what the process environment already holds wins."""

from __future__ import annotations

import os


def load_env(path: str = ".env") -> dict[str, str]:
    """Read ``name=value`` lines into the environment and return them; blank lines, comments and other lines are skipped."""
    found: dict[str, str] = {}
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        return found
    for line in map(str.strip, lines):
        if line and not line.startswith("#") and "=" in line:
            name, _, value = line.partition("=")
            found[name.strip()] = value.strip().strip("\"'")
    for name, value in found.items():
        os.environ.setdefault(name, value)
    return found
