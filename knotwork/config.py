"""Settings files of ``key = value`` lines (``#`` and ``//`` begin comments), with lists in brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def read_settings(text: str) -> dict[str, str | list[str]]:
    """Keys and values; quotes are dropped, ``key: value`` counts too, nested braces join keys by a dot."""
    out: dict[str, str | list[str]] = {}
    prefix: list[str] = []
    for line in text.splitlines():
        line = re.sub(r"(?:^|\s)(?:#|//).*", "", line).strip().rstrip(",")
        if line == "}":
            prefix.pop()
        elif m := re.fullmatch(r"([\w.-]+)\s*[=:]?\s*\{", line):
            prefix.append(m[1])
        elif m := re.fullmatch(r"([\w.-]+)\s*[=:]\s*(.*)", line):
            value = m[2].strip()
            plain = lambda x: x.strip().strip("\"'")
            key = ".".join([*prefix, m[1]])
            out[key] = [plain(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else plain(value)
    return out


@dataclass
class PatternSettings:
    """Of the pattern tools: where the edges, labels and index lie, and which pattern is sought."""

    input_dir: str = "."
    target_graph: str = ""
    default_label: bool = True
    labels: list[str] = field(default_factory=lambda: ["_"])
    query_sample: str = "q1"
    index_dir: str = "index"

    @staticmethod
    def of(text: str) -> PatternSettings:
        s = read_settings(text)
        labels = s.get("labels", ["_"])
        return PatternSettings(
            str(s.get("inputDir", ".")),
            str(s.get("targetGraph", "")),
            str(s.get("defaultLabel", "true")).lower() == "true",
            labels if isinstance(labels, list) else labels.split(),
            str(s.get("querySample", "q1")).lower(),
            str(s.get("indexDir", "index")),
        )
