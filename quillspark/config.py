"""Settings with their origin: command line, configuration file, base directories, defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

NAME = "quillspark"
KEYS = ("catalogue", "downloads", "cache", "provider")


@dataclass(frozen=True)
class Setting:
    value: str | None
    origin: str


def expanded(path: str, home: str | None = None) -> str:
    home = home or os.path.expanduser("~")
    return home if path == "~" else f"{home}/{path[2:]}" if path.startswith("~/") else path


def compacted(path: str, home: str | None = None) -> str:
    home = home or os.path.expanduser("~")
    return "~" if path == home else f"~/{path[len(home) + 1 :]}" if path.startswith(f"{home}/") else path


def default_file(env: dict | None = None) -> Path:
    env = os.environ if env is None else env
    return Path(env.get("XDG_CONFIG_HOME") or expanded("~/.config", env.get("HOME")), NAME, "config.yaml")


def load(path: Path) -> dict[str, str]:
    """``key: value`` lines; a missing file is empty."""
    if not path.exists():
        return {}
    rows = (line.split("#", 1)[0].partition(":") for line in path.read_text().splitlines())
    return {k.strip(): v.strip().strip("'\"") for k, colon, v in rows if colon}


def resolved(given: dict | None = None, file: dict | None = None, env: dict | None = None) -> dict[str, Setting]:
    """Blank strings count as unset."""
    env = os.environ if env is None else env
    data = env.get("XDG_DATA_HOME") or expanded("~/.local/share", env.get("HOME"))
    based = {"catalogue": f"{data}/{NAME}/catalogue", "cache": f"{data}/{NAME}/expansions"}
    defaults = {"downloads": expanded("~/Downloads", env.get("HOME"))}
    out = {}
    for key in KEYS:
        for origin, source in (("command_line", given), ("config_file", file), ("xdg", based), ("default", defaults)):
            value = (source or {}).get(key)
            if value and value.strip():
                out[key] = Setting(expanded(value.strip(), env.get("HOME")), origin)
                break
        else:
            out[key] = Setting(None, "default")
    return out


def write_starter(path: Path, force: bool = False) -> None:
    if path.exists() and not force:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"# {k}:\n" for k in KEYS))
