"""Configuration and ignore rules, on the driver."""

from __future__ import annotations

import json
import os
from pathlib import Path

# What a configuration has, and its defaults.
DEFAULTS: dict[str, list[str]] = {
    "radici": [str(Path.home() / "Documents")],
    "estensioni_attive": [
        ".pdf", ".docx", ".xlsx", ".pptx", ".numbers", ".doc", ".html", ".htm",
        ".eml", ".msg", ".txt", ".md", ".xml", ".csv",
        ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".heic",
    ],
    "esclusioni": [
        "wp-admin/", "wp-includes/", "wp-content/", "public_html/", "public_html 2/",
        "node_modules/", "vendor/", ".venv/", "venv/", "__pycache__/", ".build/",
        "DerivedData/", "Pods/", ".git/", ".svn/", ".hg/", ".cache/", "Caches/",
        ".Trash/", "Library/", "*.app/",
    ],
}


def load(path: str | Path) -> dict[str, list[str]]:
    """Defaults overlaid by known keys of the file; an unreadable file gives the defaults."""
    try:
        given = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        given = {}
    given = given if isinstance(given, dict) else {}
    return {k: list(given[k]) if isinstance(given.get(k), list) else list(v) for k, v in DEFAULTS.items()}


def save(path: str | Path, config: dict) -> dict[str, list[str]]:
    """Write known keys at once (beside, then renamed); missing ones get their default."""
    kept = {k: [str(x) for x in config[k]] if isinstance(config.get(k), list) else list(v) for k, v in DEFAULTS.items()}
    beside = Path(f"{path}.nuovo")
    beside.write_text(json.dumps(kept, ensure_ascii=False, indent=2), "utf-8")
    os.replace(beside, path)
    return kept


def ignore_rules(path: str | Path, config: list[str]) -> list[str]:
    """Rules of a file (blank lines and comments dropped), then those of the configuration, each once and in order."""
    lines = [x.strip() for x in Path(path).read_text("utf-8").splitlines()] if Path(path).exists() else []
    return list(dict.fromkeys([*(x for x in lines if x and not x.startswith("#")), *config]))
