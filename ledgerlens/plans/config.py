"""Settings: defaults overlaid by a JSON file, if there is one that can be read."""

from __future__ import annotations

import json

DEFAULTS: dict[str, object] = {"batch_size": 20, "follow_up_days": 7, "min_cluster_size": 2, "min_shared": 2, "report_rows": 50}


def load(path: str | None = None, defaults: dict[str, object] | None = None) -> dict[str, object]:
    found = dict(DEFAULTS if defaults is None else defaults)
    try:
        with open(path or "", encoding="utf-8") as f:
            return found | json.load(f)
    except (OSError, ValueError):
        return found
