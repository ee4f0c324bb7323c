"""Where a project is, and its settings."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from pathlib import Path

#: A line KEY=value, perhaps exported, perhaps in quotes; comments and other lines are no settings.
SETTING = re.compile(r"""^[^\S\n]*(?:export[^\S\n]+)?(?!\#)(?P<key>[^=\n]+?)[^\S\n]*=[^\S\n]*(?:(?P<mark>['"])(?P<quoted>[^\n]*)(?P=mark)|(?P<bare>[^\n]*?))[^\S\n]*$""", re.M)


def settings(path: str | Path, env: dict[str, str] | None = None) -> Callable[[str, bool], str | None]:
    """A look-up of KEY=value settings: the environment before the file, empty as missing."""
    text = Path(path).read_text(encoding="utf-8") if Path(path).is_file() else ""
    written = {m["key"]: m["bare"] if m["mark"] is None else m["quoted"] for m in SETTING.finditer(text)}
    sources = (os.environ if env is None else env, written)

    def get(key: str, required: bool = False) -> str | None:
        found = next(filter(None, (s.get(key) for s in sources)), None)
        if required and found is None:
            raise LookupError(f"{key} is not set; put it in the environment or {path}")
        return found

    return get


def project_root(marker: str, named: str | None = None, checkout: str | Path | None = None, here: str | Path | None = None) -> Path:
    """The folder that holds the marker: the named one without a look, else the checkout, the current folder, or the nearest above it."""
    if named:
        return Path(named).resolve()
    current = Path(here or Path.cwd())
    places: Iterable[Path] = [*([Path(checkout)] if checkout else []), current, *current.parents]
    for place in places:
        if (place / marker).is_file():
            return place
    raise FileNotFoundError(f"{marker} is in none of the folders from {current} up; name the project's folder")
