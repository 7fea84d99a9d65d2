"""Settings of a run, with the shipped defaults; a mapping (as any configuration file gives one) may override them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Repair:
    temperature: float = 0.0
    max_retries: int = 3
    concurrency: int = 5


@dataclass(frozen=True)
class Adoption:
    strip_level: int = 1
    patch_tool: str = "patch"


@dataclass(frozen=True)
class Paths:
    """Where each stage finds and leaves its report."""

    vanir_source_report: str = "reports/vanir_output.json"
    parsed_vanir_report: str = "reports/parsed_report.json"
    fetched_patches_dir: str = "patches/vanir"
    fetch_failures_report: str = "reports/fetch_failures.json"
    vanir_patch_application_report: str = "reports/vanir_patch_application_report.json"
    llm_input_report: str = "reports/failed_patch.json"
    llm_generated_patches_dir: str = "patches/llm_generated"
    llm_successful_patches_report: str = "reports/successful_llm_patches.json"
    llm_detailed_output_report: str = "reports/llm_output_detailed.json"
    llm_patch_application_report: str = "reports/llm_patch_application_report.json"
    final_summary_report: str = "reports/final_summary_report.json"


@dataclass(frozen=True)
class Config:
    llm_runner: Repair = field(default_factory=Repair)
    patch_adopter: Adoption = field(default_factory=Adoption)
    paths: Paths = field(default_factory=Paths)


def load(given: Mapping[str, Mapping[str, Any] | None] | None) -> Config:
    """The defaults with what is given; sections and settings that are not known here are left alone."""
    config = Config()
    for section in fields(config):
        own = getattr(config, section.name)
        known = {f.name for f in fields(own)}
        said = {k: v for k, v in ((given or {}).get(section.name) or {}).items() if k in known and v is not None}
        config = replace(config, **{section.name: replace(own, **said)})
    return config
