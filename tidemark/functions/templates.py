"""User metrics are SQL text with ``{{name}}`` slots."""

from __future__ import annotations

import re

_SLOT = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def render(template: str, **values: str) -> str:
    def fill(match: re.Match) -> str:
        if match[1] not in values:
            raise ValueError(f"unknown slot {match[0]} in {template!r}")
        return values[match[1]]

    return _SLOT.sub(fill, template)
