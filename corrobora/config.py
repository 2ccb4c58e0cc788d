"""Settings: defaults, then a file, then flags; bad values go back to their defaults with a warning."""

from __future__ import annotations

import json
from copy import deepcopy
from pathlib import Path

#: The settings, their defaults and what they may be (a type, bounds, or choices).
DEFAULTS: dict = {
    "cataloguePath": "data/catalogue.json",
    "docsPath": None,
    "workDir": "./output",
    "chunk": {"size": 1200, "overlap": 200},
    "embeddings": {"provider": "mock", "model": None, "batchSize": 64},
    "llm": {"provider": "lexical", "model": None, "temperature": 0, "maxTokens": 1024, "senders": 8, "perMinute": 0},
    "retrieval": {"topK": 6},
    "analysis": {"confidenceThreshold": 0.6, "critique": False, "strict": False},
    "review": {"showAll": False},
    "acceptAll": False,
    "decisionsPath": None,
    "envPath": ".env",
    "report": {"evidenceQuoteMaxChars": 300},
    "identity": None,
    "fixedNow": None,
    "force": False,
    "trustTimes": True,
    "local": False,
    "logLevel": "info",
}
RULES: dict = {
    "embeddings.provider": {"mock", "openai"},
    "llm.provider": {"lexical", "mock", "openai", "ollama"},
    "chunk.size": (int, 100, 100_000),
    "chunk.overlap": (int, 0, 99_999),
    "embeddings.batchSize": (int, 1, 2048),
    "llm.temperature": (float, 0, 2),
    "llm.maxTokens": (int, 1, 200_000),
    "llm.senders": (int, 1, 10_000),
    "llm.perMinute": (float, 0, 1_000_000),
    "retrieval.topK": (int, 1, 50),
    "analysis.confidenceThreshold": (float, 0, 1),
    "report.evidenceQuoteMaxChars": (int, 20, 100_000),
    "logLevel": {"debug", "info", "warn", "error", "quiet"},
}


class ConfigError(ValueError):
    """A settings file that is no JSON object."""


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, object by object; arrays and scalars replace, missing flags (None) do not."""
    out = deepcopy(base)
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        elif value is not None:
            out[key] = deepcopy(value)
    return out


def _fits(path: str, value, default) -> bool:
    rule = RULES.get(path)
    if isinstance(rule, set):
        return value in rule
    if rule:
        kind, low, high = rule
        number = isinstance(value, int) or (kind is float and isinstance(value, float))
        return number and not isinstance(value, bool) and low <= value <= high
    if isinstance(default, bool):
        return isinstance(value, bool)
    return value is None or isinstance(value, str) or not isinstance(default, str | None)


def repaired(config: dict, defaults: dict = DEFAULTS, at: str = "") -> tuple[dict, list[str]]:
    """The settings with unknown keys removed and bad values reset, and a warning for each."""
    out, warnings = {}, []
    for key, default in defaults.items():
        path, value = f"{at}{key}", config.get(key, default)
        if isinstance(default, dict):
            if not isinstance(value, dict):
                warnings.append(f"{path}: must be an object, using the defaults")
                value = {}
            out[key], more = repaired(value, default, f"{path}.")
            warnings += more
        elif _fits(path, value, default):
            out[key] = value
        else:
            warnings.append(f"{path}: {value!r} is not allowed, using {default!r}")
            out[key] = default
    warnings += [f"{at}{key}: unknown, ignored" for key in config if key not in defaults]
    return out, warnings


def load(path: str | None = None, flags: dict | None = None) -> tuple[dict, list[str]]:
    """(settings, warnings) of an optional file and flags; an overlap is kept below the size, ``local`` comes last."""
    file: dict = {}
    if path and Path(path).exists():
        try:
            file = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        except ValueError as error:
            raise ConfigError(f"{path}: {error}") from error
        if not isinstance(file, dict):
            raise ConfigError(f"{path}: not an object")
    flags = flags or {}
    config = merged(merged(DEFAULTS, file), flags)
    for part in ("embeddings", "llm"):
        chosen, given = flags.get(part, {}), file.get(part, {})
        if chosen.get("provider") and chosen["provider"] != given.get("provider") and not chosen.get("model"):
            config[part]["model"] = None  # a model of the provider that was replaced
    config, warnings = repaired(config)
    if config["chunk"]["overlap"] >= config["chunk"]["size"]:
        config["chunk"]["overlap"] = config["chunk"]["size"] - 1
        warnings.append("chunk.overlap: kept below chunk.size")
    if config["local"]:
        config["embeddings"]["provider"], config["llm"]["provider"] = "mock", "lexical"
    return config, warnings


def load_env(path: str, environment: dict[str, str]) -> list[str]:
    """Adds a file's KEY=value lines to ``environment``, which keeps what it has; returns the names added.

    Blank lines and lines that start with # are passed over, an ``export`` before the name and one pair of
    quotes around the value are dropped. A missing file adds nothing.
    """
    added = []
    if not Path(path).exists():
        return added
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if line.lstrip().startswith("#") or not equals or not name or name in environment:
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        environment[name] = value
        added.append(name)
    return added
