"""A project's configuration: lenient, with defaults; an unreadable one is none."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from .. import constants as k


@dataclass
class Config:
    max_depth: int = 10
    min_tokens: int = k.MIN_TOKENS
    ignore: list[str] = field(default_factory=list)
    provider: str | None = None
    model: str | None = None
    verify: dict[str, dict] = field(default_factory=dict)


def load(path: str) -> Config | None:
    """The file's known settings of the right type over the defaults; None where it is missing or isn't a mapping."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
    except (OSError, yaml.YAMLError):
        return None
    if not isinstance(raw, dict):
        return None
    out = Config()
    for f_ in fields(Config):
        value, default = raw.get(f_.name), getattr(out, f_.name)
        if value is not None and (default is None and isinstance(value, str) or default is not None and type(value) is type(default)):
            setattr(out, f_.name, value)
    return out


def commands(config: Config) -> list[tuple[str, str, str]]:
    """(scope, kind, command) of the verification commands, a string or a mapping with one."""
    out = []
    for scope, by_kind in config.verify.items():
        for kind, c in (by_kind or {}).items():
            command = c if isinstance(c, str) else (c or {}).get("command")
            if command:
                out.append((scope, kind, command))
    return out
