"""Configuration: dataclasses, reading, validation."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field, fields
from urllib.parse import urlsplit

SECTIONS = {"version", "secrets", "identity", "code", "behavior", "filters"}


@dataclass(frozen=True)
class Identity:
    company: str | None = None
    domains: tuple[str, ...] = ()
    people: tuple[str, ...] = ()


@dataclass(frozen=True)
class Code:
    language: str = "unknown"
    domain_terms: tuple[str, ...] = ()
    preserve: tuple[str, ...] = ()
    sensitive_paths: tuple[str, ...] = ()
    redact_bodies: tuple[str, ...] = ()


@dataclass(frozen=True)
class Behavior:
    aggression: str = "medium"
    audit_failure: str = "permit"
    preset: str | None = None
    upstream: str | None = None


@dataclass(frozen=True)
class Config:
    identity: Identity = field(default_factory=Identity)
    code: Code = field(default_factory=Code)
    behavior: Behavior = field(default_factory=Behavior)
    secret_patterns: tuple[dict, ...] = ()
    disabled_types: tuple[str, ...] = ()


def _part(kind, values: dict):
    names = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names})


def validate(tree: dict) -> tuple[list[str], list[str]]:
    """Errors and warnings of a configuration tree."""
    if not isinstance(tree, dict):
        return ["the configuration is not a mapping"], []
    errors, warnings = [], [f"unknown section: {k}" for k in tree if k not in SECTIONS]
    for section, kind in (("identity", Identity), ("code", Code), ("behavior", Behavior)):
        part = tree.get(section) or {}
        if not isinstance(part, dict):
            errors.append(f"{section} is not a mapping")
            continue
        known = {f.name for f in fields(kind)}
        warnings += [f"unknown key: {section}.{k}" for k in part if k not in known]
    behavior = tree.get("behavior") if isinstance(tree.get("behavior"), dict) else {}
    if behavior.get("aggression", "medium") not in ("low", "medium", "high"):
        errors.append("behavior.aggression is low, medium or high")
    if behavior.get("audit_failure", "permit") not in ("block", "permit"):
        errors.append("behavior.audit_failure is block or permit")
    if url := behavior.get("upstream"):
        errors += check_upstream(url)
    return errors, warnings


def check_upstream(url: str) -> list[str]:
    """Only https, without user data, to a public host name."""
    parts = urlsplit(url)
    out = [] if parts.scheme == "https" else ["upstream must be https"]
    if parts.username or parts.password:
        out.append("upstream has user data")
    try:
        if not ipaddress.ip_address(parts.hostname or "").is_global:
            out.append("upstream is not public")
    except ValueError:
        if not parts.hostname or "." not in parts.hostname:
            out.append("upstream has no public host name")
    return out


def from_tree(tree: dict) -> Config:
    errors, _ = validate(tree)
    if errors:
        raise ValueError("; ".join(errors))
    behavior = dict(tree.get("behavior") or {})
    preset = str(behavior.get("preset") or "").lower()
    if preset in ("hipaa", "pci-dss") and "audit_failure" not in behavior:
        behavior["audit_failure"] = "block"
    secrets = (tree.get("secrets") or {}).get("patterns") or []
    disabled = (tree.get("filters") or {}).get("disable") or []
    return Config(_part(Identity, tree.get("identity") or {}), _part(Code, tree.get("code") or {}), _part(Behavior, behavior), tuple(secrets), tuple(disabled))


def load(path: str) -> Config:
    """From a YAML file, or JSON where no YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return from_tree(json.loads(text))
    return from_tree(yaml.safe_load(text) or {})
