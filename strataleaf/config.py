"""Settings: defaults, then a TOML file, then the command line."""

from __future__ import annotations

import tomllib
from pathlib import Path

FILE_NAMES = ("strataleaf.toml", ".strataleaf.toml")
#: Options of each command; the first two are also global, but not for extract-text.
GLOBAL = ("model_identifier", "show_token_usage")
COMMANDS = {
    "generate-toc": (*GLOBAL, "force", "request_delay", "ocr", "ocr_language", "ocr_dpi", "ocr_output", "postprocess", "inplace"),
    "extract-text": ("ocr_language", "ocr_dpi", "force", "inplace"),
    "rename": (*GLOBAL, "query", "yes", "request_delay"),
}


#: Kinds of values; a whole number may stand for a number.
KINDS = {
    **dict.fromkeys(("model_identifier", "ocr_language", "query"), str),
    **dict.fromkeys(("show_token_usage", "force", "ocr", "ocr_output", "postprocess", "inplace", "yes"), bool),
    "ocr_dpi": int,
    "request_delay": float,
}


class ConfigError(ValueError):
    """A settings file that cannot be read or names unknown settings."""


def find_config(start: Path | None = None) -> Path | None:
    """The first settings file in the working folder, the home folder or its .config/strataleaf."""
    home = Path.home()
    for folder in (start or Path.cwd(), home, home / ".config" / "strataleaf"):
        for name in FILE_NAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def defaults_of(settings: dict) -> dict[str, dict]:
    """Defaults of each command from the sections of a file; a command's own section goes before global."""
    for section in settings:
        if section != "global" and section not in COMMANDS:
            raise ConfigError(f"unknown section: {section}")
    plain = {s: {k.replace("-", "_"): v for k, v in settings.get(s, {}).items()} for s in ("global", *COMMANDS)}
    out = {}
    for command, options in COMMANDS.items():
        for section, allowed in (("global", GLOBAL), (command, options)):
            if unknown := set(plain[section]) - set(allowed):
                raise ConfigError(f"unknown setting in {section}: {min(unknown)}")
            for name, value in plain[section].items():
                if type(value) is not KINDS[name] and not (KINDS[name] is float and type(value) is int):
                    raise ConfigError(f"{name} in {section} is to be of type {KINDS[name].__name__}: {value!r}")
        merged = {k: v for k, v in plain["global"].items() if k in options} | plain[command]
        if merged:
            out[command] = merged
    return out


def load_defaults(path: Path | None = None, existing: dict[str, dict] | None = None) -> dict[str, dict] | None:
    """Defaults by command from a given or found file; what exists already goes before them. None if there is no file."""
    path = path or find_config()
    if path is None:
        return existing
    try:
        with path.open("rb") as f:
            found = defaults_of(tomllib.load(f))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    for command, options in (existing or {}).items():
        found[command] = found.get(command, {}) | options
    return found


def setting(name: str, command: str, given: dict, defaults: dict[str, dict] | None, fallback=None):
    """Command line, then file (own section, then global), then the built-in default."""
    if given.get(name) is not None:
        return given[name]
    return (defaults or {}).get(command, {}).get(name, fallback)
