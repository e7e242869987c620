"""Which databases and schemas are scanned: a small driver-side configuration with ${NAME} taken from the environment."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

_NAME = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def interpolate(value, env: dict[str, str] | None = None):
    """value with ${NAME} replaced in all its strings; a name that isn't set is an error."""
    env = os.environ if env is None else env
    if isinstance(value, str):

        def named(m: re.Match) -> str:
            if m[1] not in env:
                raise KeyError(f"{m[1]} is not set")
            return env[m[1]]

        return _NAME.sub(named, value)
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    return value


class ConfigError(ValueError):
    """What is wrong with a configuration, and where."""


@dataclass(frozen=True)
class Connection:
    name: str
    url: str
    databases: dict[str, list[str]] = field(default_factory=dict)
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    query_timeout: int = 300
    fetch_size: int = 10_000

    def properties(self) -> dict[str, str]:
        """What Spark's JDBC source takes beside the address."""
        given = {"user": self.user, "password": self.password, "queryTimeout": str(self.query_timeout), "fetchsize": str(self.fetch_size)}
        return {k: v for k, v in given.items() if v is not None}

    def selected(self) -> list[tuple[str, str]]:
        return [(db, s) for db, schemas in self.databases.items() for s in schemas]


def connections(raw: dict, env: dict[str, str] | None = None) -> dict[str, Connection]:
    """Connections by lower-case name; names that differ in case only are an error."""
    out: dict[str, Connection] = {}
    for c in interpolate(raw, env)["connections"]:
        if c["name"].lower() in out:
            raise ValueError(f"connection {c['name']} is there twice")
        out[c["name"].lower()] = Connection(c["name"], c["url"], {d["name"]: list(d["schemas"]) for d in c["databases"]})
    return out


@dataclass(frozen=True)
class Options:
    """What a scan does beside reading the catalog."""

    follow_foreign_keys: bool = True
    triggers_of_cascaded: bool = True
    statistics: bool = True
    lineage: bool = True


@dataclass(frozen=True)
class Config:
    connections: dict[str, Connection]
    options: Options
    store: str

    def connection(self, name: str) -> Connection:
        if name.lower() not in self.connections:
            raise ConfigError(f"no connection {name}; there are: {', '.join(c.name for c in self.connections.values())}")
        return self.connections[name.lower()]


def environment(dotenv: Path) -> dict[str, str]:
    """NAME=value lines of a file, if it is there, under the process's own environment, which wins. Comments and `export` are passed over."""
    found: dict[str, str] = {}
    for line in dotenv.read_text(encoding="utf-8").splitlines() if dotenv.is_file() else ():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            value = value.strip()
            found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found | dict(os.environ)


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        raise ConfigError("YAML files need the package yaml; JSON and TOML files don't") from None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ConfigError(str(error)) from error


_READERS: dict[str, Callable[[str], object]] = {".json": json.loads, ".toml": tomllib.loads, ".yaml": _yaml, ".yml": _yaml}


def load(path: str | Path, env: dict[str, str] | None = None) -> Config:
    """The configuration of a JSON, TOML or YAML file, with ${NAME} taken from the environment and a `.env` file beside it.

    Every fault is a ConfigError: no file, a file that can't be read, names that aren't set, no connection, no database, no schema,
    equal names, options that aren't known or no booleans, and numbers outside their bounds (query_timeout 1 to 86400, fetch_size 1 to 1000000).
    """
    path = Path(path)
    if not path.is_file() or path.suffix.lower() not in _READERS:
        raise ConfigError(f"{path}: no JSON, TOML or YAML file")
    try:
        raw = _READERS[path.suffix.lower()](path.read_text(encoding="utf-8"))
        raw = interpolate(raw, environment(path.parent / ".env") if env is None else env)
    except (ValueError, KeyError) as error:
        raise ConfigError(f"{path}: {error}") from error
    if not isinstance(raw, dict) or not isinstance(raw.get("connections"), list) or not raw["connections"]:
        raise ConfigError(f"{path}: connections: a list of one or more is needed")
    found: dict[str, Connection] = {}
    for i, c in enumerate(raw["connections"]):
        at = f"{path}: connections[{i}]"
        if not isinstance(c, dict) or not all(isinstance(c.get(k), str) and c[k] for k in ("name", "url")):
            raise ConfigError(f"{at}: name and url are needed")
        if c["name"].lower() in found:
            raise ConfigError(f"{at}: {c['name']} is there twice")
        databases = c.get("databases")
        if not isinstance(databases, list) or not databases or not all(isinstance(d, dict) and d.get("name") and isinstance(d.get("schemas"), list) and d["schemas"] for d in databases):
            raise ConfigError(f"{at}.databases: one or more with a name and one or more schemas are needed")
        if (c.get("user") is None) != (c.get("password") is None):
            raise ConfigError(f"{at}: user and password go together")
        numbers = {}
        for name, most in (("query_timeout", 86_400), ("fetch_size", 1_000_000)):
            if name in c:
                if not isinstance(c[name], int) or isinstance(c[name], bool) or not 1 <= c[name] <= most:
                    raise ConfigError(f"{at}.{name}: a number from 1 to {most} is needed")
                numbers[name] = c[name]
        found[c["name"].lower()] = Connection(c["name"], c["url"], {d["name"]: list(d["schemas"]) for d in databases}, c.get("user"), c.get("password"), **numbers)
    scan = raw.get("scan") or {}
    if not isinstance(scan, dict) or not set(scan) <= set(Options.__dataclass_fields__) or not all(isinstance(v, bool) for v in scan.values()):
        raise ConfigError(f"{path}: scan: true or false for {', '.join(Options.__dataclass_fields__)}")
    return Config(found, Options(**scan), str(raw.get("store") or path.parent / "snapshots"))
