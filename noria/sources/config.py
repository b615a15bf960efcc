"""Settings: documents of nested keys with variables, checked against a schema, overridden by dotted paths.

Config files are small and read on the driver through Spark's file systems; the same overrides and
expansions exist as columns, for tables that carry settings.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any, TypeVar, get_type_hints

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_VARIABLE = re.compile(r"\$\{(\w+)\}|\$(\w+)")


def expand_variables(value: str, values: Mapping[str, str] | None = None) -> str:
    """$NAME and ${NAME} replaced; an error if a braced one has no value."""
    values = os.environ if values is None else values

    def put(m: re.Match) -> str:
        if m[1] and m[1] not in values:
            raise ValueError(f"unresolved variable {m[1]!r} in {value!r}")
        return values.get(m[1] or m[2], m[0])

    return _VARIABLE.sub(put, value)


def variables_expanded(text: Column, values: Mapping[str, str]) -> Column:
    """As expand_variables, for a column: longer names first; a row with a braced name left over fails the query."""
    for name in sorted(values, key=lambda n: (-len(n), n)):
        text = F.replace(F.replace(text, F.lit("${" + name + "}"), F.lit(values[name])), F.lit("$" + name), F.lit(values[name]))
    return F.when(text.contains("${"), F.raise_error(F.concat(F.lit("unresolved variable in "), text))).otherwise(text)


def settings(nested: Mapping[str, Any], sections: Callable[[str], bool] = lambda path: True) -> dict[str, Any]:
    """A table of dotted path to value. Mappings at paths that are ``sections`` are gone into; an empty one is a value."""
    table: dict[str, Any] = {}
    todo = [("", nested)]
    while todo:
        prefix, section = todo.pop(0)
        for key, value in section.items():
            path = f"{prefix}{key}"
            if isinstance(value, Mapping) and value and sections(path):
                todo.append((path + ".", value))
            else:
                table[path] = value
    return table


def nested(table: Mapping[str, Any]) -> dict[str, Any]:
    """The inverse of ``settings``."""
    tops = dict.fromkeys(path.partition(".")[0] for path in table)
    below = {top: {p[len(top) + 1 :]: v for p, v in table.items() if p.startswith(top + ".")} for top in tops}
    return {top: nested(below[top]) if below[top] else table[top] for top in tops}


def schema(kind: type) -> dict[str, type]:
    """A table of dotted path to type of a dataclass's settings, those of dataclasses in it among them, and of these sections themselves."""
    types = get_type_hints(kind)
    inner = {f"{name}.{path}": t for name, own in types.items() if dataclasses.is_dataclass(own) for path, t in schema(own).items()}
    return types | inner


def _cast(value: Any, want: type, values: Mapping[str, str] | None) -> Any:
    """A setting as its type wants it: variables expanded, numbers from text or other numbers, lists as tuples."""
    read = expand_variables(value, values) if isinstance(value, str) else value
    return {int: int, float: float}.get(want, lambda v: tuple(v) if isinstance(v, list) else v)(read)


def coerced(kind: type[T], data: Mapping[str, Any] | None, values: Mapping[str, str] | None = None) -> T:
    """A dataclass from nested mappings, by the table of its schema: unknown keys are an error, missing ones keep their defaults."""
    types = schema(kind)
    given = settings(data or {}, lambda path: dataclasses.is_dataclass(types.get(path)))
    unknown = sorted(set(given) - set(types))
    if unknown:
        raise ValueError(f"unknown key {', '.join(unknown)} for {kind.__name__}")
    read = {path: _cast(value, types[path], values) for path, value in given.items() if not dataclasses.is_dataclass(types[path])}

    def made(section: type, prefix: str):
        own = {f.name: prefix + f.name for f in dataclasses.fields(section)}
        parts = {name: made(types[path], path + ".") for name, path in own.items() if dataclasses.is_dataclass(types[path]) and any(p.startswith(path + ".") for p in read)}
        return section(**parts, **{name: read[path] for name, path in own.items() if path in read})

    return made(kind, "")


def overridden(data: Mapping[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    """A copy of nested mappings with values, or whole sections, replaced by dotted path; a path that isn't there is an error."""
    table = settings(data)
    for path, value in changes.items():
        replaced = {p for p in table if p == path or p.startswith(path + ".")}
        if not replaced:
            raise KeyError(f"nothing at {path!r} to override")
        table = {p: v for p, v in table.items() if p not in replaced} | {path: value}
    return json.loads(json.dumps(nested(table)))


def fields_overridden(setting: Column, changes: Mapping[str, Column]) -> Column:
    """As overridden, for a struct column; Spark rejects a path whose parents aren't there."""
    for path, value in changes.items():
        setting = setting.withField(path, value)
    return setting


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON document, or a YAML one where PyYAML is installed."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def plain(value: Any) -> Any:
    """Dataclasses, mappings and sequences as JSON has them."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        value = dataclasses.asdict(value)
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, Sequence) and not isinstance(value, str):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def dump(value: Any) -> str:
    """Indented JSON (which is YAML, too), keys in their order, text as it is."""
    return json.dumps(plain(value), ensure_ascii=False, indent=2)


def model_config(base: Mapping[str, Any], vocabulary: int, root: str = "", size: str = "model.vocab_size", paths: Sequence[str] = ()) -> dict[str, Any]:
    """``base`` for a vocabulary of so many tokens, with the values at ``paths`` relative to ``root``."""
    table, folder = settings(base), root.rstrip("/") + "/"
    return overridden(base, {size: vocabulary} | {path: str(table[path]).removeprefix(folder) for path in paths})
