"""Configuration: strict YAML, discovery, validation."""

from __future__ import annotations

import glob
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from lathe.operators.policy import check_rules, glob_regex

NAME = ".lathe.yaml"
KEYS = {"include", "exclude", "exclude_files", "post_process", "links"}


@dataclass
class Config:
    base: str = "."
    include: list = field(default_factory=list)  # (globs, rules)
    exclude: list = field(default_factory=list)
    exclude_files: list = field(default_factory=list)
    post_process: list = field(default_factory=list)  # (command, extensions)
    least: int | None = None
    by_extension: dict = field(default_factory=dict)


def _known(node, keys: set[str], where: str) -> dict:
    if not isinstance(node, dict):
        raise ValueError(f"{where} must be a mapping")
    extra = set(node) - keys
    if extra:
        raise ValueError(f"unknown key {sorted(extra)[0]!r} in {where}")
    return node


def _groups(nodes, where: str) -> list:
    out = []
    for node in nodes or []:
        node = _known(node, {"files", "rules"}, where)
        globs, rules = list(node.get("files") or []), list(node.get("rules") or [])
        check_rules(rules, where)
        for g in globs:
            glob_regex(g)
        out.append((globs, rules))
    return out


def parse(text: str, base: str = ".") -> Config:
    """A Config, or ValueError: unknown keys and rules, both lists at once, thresholds below 1."""
    top = _known(yaml.safe_load(text) or {}, KEYS, "the configuration")
    links = _known(top.get("links") or {}, {"min_occurrences", "by_extension"}, "links")
    out = Config(base, _groups(top.get("include"), "include"), _groups(top.get("exclude"), "exclude"), list(top.get("exclude_files") or []))
    if out.include and out.exclude:
        raise ValueError("include and exclude can't both be set")
    for g in out.exclude_files:
        glob_regex(g)
    for step in top.get("post_process") or []:
        step = _known(step, {"command", "extensions"}, "post_process")
        command = step.get("command")
        command = command.split() if isinstance(command, str) else list(command or [])
        if not command:
            raise ValueError("a post_process step needs a command")
        out.post_process.append((command, list(step.get("extensions") or [])))
    out.least, out.by_extension = links.get("min_occurrences"), dict(links.get("by_extension") or {})
    for n in [out.least, *out.by_extension.values()]:
        if n is not None and (not isinstance(n, int) or n < 1):
            raise ValueError("min_occurrences must be 1 or more")
    return out


def find(start: str, explicit: str | None = None, none: bool = False) -> str | None:
    """The path of the configuration: none if none is set; else the explicit one; else the nearest above, up to a repository's top."""
    if none:
        return None
    if explicit:
        return explicit
    at = Path(start).resolve()
    for folder in [at, *at.parents]:
        if (folder / NAME).is_file():
            return str(folder / NAME)
        if (folder / ".git").exists():
            break
    return None


def check_alive(config: Config) -> None:
    """ValueError if a pattern of the configuration matches no file or folder below its own folder."""
    patterns = [*config.exclude_files, *(g for globs, _ in [*config.include, *config.exclude] for g in globs)]
    for pattern in patterns:
        tries = _without_braces(pattern)
        if not any(True for p in tries for _ in glob.iglob(p, root_dir=config.base, recursive=True, include_hidden=True)):
            raise ValueError(f"config pattern {pattern!r} matched no files under {config.base}")


def _without_braces(pattern: str) -> list[str]:
    """The patterns that the alternatives in braces stand for."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    if not found:
        return [pattern]
    return [x for part in found[1].split(",") for x in _without_braces(pattern[: found.start()] + part + pattern[found.end() :])]


def load(path: str) -> Config:
    """A configuration file, whose every pattern is valid and matches something; else ValueError."""
    out = parse(Path(path).read_text(), str(Path(path).resolve().parent))
    check_alive(out)
    return out


def discover(start: str, explicit: str | None = None, none: bool = False) -> Config | None:
    path = find(start, explicit, none)
    return load(path) if path else None


def crate_root(start: str) -> str | None:
    """The root file of the crate that owns a path: lib.rs, else main.rs, or what the manifest names."""
    import tomllib

    at = Path(start).resolve()
    for folder in [at, *at.parents] if at.is_dir() else at.parents:
        manifest = folder / "Cargo.toml"
        if manifest.is_file():
            spec = tomllib.loads(manifest.read_text())
            lib = (spec.get("lib") or {}).get("path", "src/lib.rs")
            if (folder / lib).is_file():
                return str(folder / lib)
            for bin_ in [*(b.get("path", "") for b in spec.get("bin", [])), "src/main.rs"]:
                if bin_.endswith("main.rs") and (folder / bin_).is_file():
                    return str(folder / bin_)
            return None
    return None
