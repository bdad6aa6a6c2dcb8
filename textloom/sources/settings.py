"""Settings from a user's and a project's JSON file."""

from __future__ import annotations

import json
import os

CHOICES = {"syntax_validation": {"warn", "block", "off"}, "image_mode": {"auto", "caption", "objects", "ocr", "all", "off"}}
POSITIVE = {"timeout_ms"}
GREP = {"max_lines", "max_bytes"}


def _positive(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0


def validate(raw, source: str) -> tuple[dict, list[str]]:
    """(settings, warnings); unknown names and bad values are left out, each with a warning."""
    if not isinstance(raw, dict):
        return {}, [f"{source}: not a JSON object"]
    out, warnings = {}, []
    for key, value in raw.items():
        if key in CHOICES and value in CHOICES[key] or key in POSITIVE and _positive(value):
            out[key] = value
        elif key == "grep" and isinstance(value, dict):
            out[key] = {k: v for k, v in value.items() if k in GREP and _positive(v)}
            warnings += [f"{source}: grep.{k} is unknown or invalid" for k in value if k not in out[key]]
        else:
            warnings.append(f"{source}: {key} is unknown or invalid")
    return out, warnings


def load(*paths: str) -> tuple[dict, list[str]]:
    """Files merged in order, later ones first; a missing file counts as empty."""
    merged: dict = {}
    warnings: list[str] = []
    for path in paths:
        if not os.path.exists(path):
            continue
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
        except ValueError as e:
            warnings.append(f"{path}: {e}")
            continue
        found, said = validate(raw, path)
        merged |= found | {"grep": merged.get("grep", {}) | found["grep"]} if "grep" in found else found
        warnings += said
    return merged, warnings
