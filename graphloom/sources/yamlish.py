"""YAML for front matter: the installed library if there is one, else maps, lists and scalars by indentation."""

from __future__ import annotations

import json
import re
from typing import Any

try:
    import yaml
except ImportError:
    yaml = None
#: The parser in C, where it is there, reads the same and takes a tenth of the time.
_LOADER = yaml and getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def load_yaml(text: str) -> Any:
    if yaml is None:
        return _load(text)
    try:
        return yaml.load(text, _LOADER)
    except yaml.YAMLError as e:
        raise ValueError(f"bad YAML: {e}") from e


def _scalar(text: str) -> Any:
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text[0] == '"' and text[-1] == '"' and len(text) > 1:
        return json.loads(text)
    if text[0] == "'" and text[-1] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x) for x in re.split(r",\s*", text[1:-1]) if x.strip()]
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _load(text: str) -> Any:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int) -> tuple[Any, int]:
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out: Any = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if re.match(r"[^\s'\"\[{][^:]*:(\s|$)", rest):
                    lines[i] = (indent + 2, rest)
                    value, i = block(i, indent + 2)
                elif rest:
                    value, i = _scalar(rest), i + 1
                else:
                    value, i = block(i + 1, lines[i + 1][0])
                out.append(value)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == indent:
            m = re.match(r"([^:]+):(?:\s+(.*))?$", lines[i][1])
            if not m:
                raise ValueError(f"bad YAML: {lines[i][1]}")
            i += 1
            if m[2]:
                out[_scalar(m[1])] = _scalar(m[2])
            elif i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and lines[i][1].startswith("-")):
                out[_scalar(m[1])], i = block(i, lines[i][0])
            else:
                out[_scalar(m[1])] = None
        if i < len(lines) and lines[i][0] > indent:
            raise ValueError("bad YAML: indentation")
        return out, i

    return block(0, lines[0][0])[0] if lines else None
