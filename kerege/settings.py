"""What a user can set, read from a JSON file: priorities, rules, totals, aliases, sections, groups."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from kerege.functions import fixed


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the current profile. Keys that have no effect are accepted and ignored."""

    priority: dict[str, int] = field(default_factory=lambda: dict(fixed.PRIORITY))
    show_values: bool = True
    checksum: bool = True
    allow_equal_bins: bool = False
    max_gap: int = 140
    total_labels: tuple[str, ...] = tuple(fixed.TOTAL_LABELS)
    prefer_total: str = "gross"
    header_share: float = 0.82
    header_aliases: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.HEADER_ALIASES))
    prefer_section: bool = True
    section_headers: tuple[str, ...] = tuple(fixed.SECTION_HEADERS)
    details: bool = False
    group_prefixes: dict[str, list[str]] = field(default_factory=dict)
    group_titles: dict[str, str] = field(default_factory=dict)
    group_order: dict[str, int] = field(default_factory=dict)
    group_best: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, told: dict) -> Settings:
        """From a configuration object; what it doesn't say keeps its default."""
        known = cls()
        bins, totals, sections, groups = (told.get(k) or {} for k in ("bin_rules", "totals", "sections", "groups"))
        labels = totals.get("labels")
        aliases = {k: v for k, v in (told.get("aliases") or {}).items() if k in known.header_aliases}
        return cls(
            priority={k: int(v) for k, v in told.get("rule_priority", known.priority).items()},
            show_values=bool(told.get("debug_show_values", known.show_values)),
            checksum=bool(bins.get("bin_checksum_enabled", known.checksum)),
            allow_equal_bins=bool(bins.get("allow_equal_bins", known.allow_equal_bins)),
            max_gap=int(totals.get("max_gap", known.max_gap)),
            total_labels=tuple(dict.fromkeys([*labels, *fixed.BROKEN_TOTAL_LABELS])) if labels else known.total_labels,
            prefer_total=str(totals.get("prefer_total", known.prefer_total)).lower(),
            header_share=float(told.get("header_fuzzy_threshold", known.header_share)),
            header_aliases=known.header_aliases | aliases,
            prefer_section=bool(sections.get("prefer_esf_section", known.prefer_section)),
            section_headers=tuple(sections.get("esf_headers", known.section_headers)),
            details=str(told.get("mode") or "user").lower() != "user" or bool(told.get("show_group_details_in_user_mode", False)),
            group_prefixes={k: list(v.get("prefixes", [])) for k, v in groups.items()},
            group_titles={k: v["title"] for k, v in groups.items() if v.get("title")},
            group_order={k: int(v["order"]) for k, v in groups.items() if "order" in v},
            group_best={k: list(v) for k, v in (told.get("group_priorities") or {}).items()},
        )


def load(*paths: str) -> Settings:
    """Settings from the first of the paths on the driver that holds a JSON object; the defaults without one."""
    for path in paths:
        try:
            told = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        if isinstance(told, dict):
            return Settings.of(told)
    return Settings()
