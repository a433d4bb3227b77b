"""YAML of rule files and front matter: the installed library where there is one, else its common subset."""

from __future__ import annotations

import re

try:
    import yaml as _library
except ImportError:
    _library = None

#: Fixed value: what the library's loader in C (where it was built with it) reads otherwise than its own: tabs, byte order marks,
#: escapes of lone surrogates, comments glued to a block's mark.
_APART = re.compile(r"[\t\ufeff\\]|[|>][-+0-9]*#")

_NUMBER = re.compile(r"[-+]?[0-9]+")
_FLOAT = re.compile(r"[-+]?[0-9]*\.[0-9]+(?:[eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "~": None, "": None}


def load_yaml(text: str):
    """The document as Python values; a ValueError if it is broken."""
    if _library is None:
        return parse(text)
    try:
        fast = None if _APART.search(text) else getattr(_library, "CSafeLoader", None)
        return _library.load(text, Loader=fast or _library.SafeLoader)
    except _library.YAMLError as e:
        raise ValueError(str(e)) from e


def parse(text: str):
    """Block and flow lists and mappings, quoted and plain scalars, folded and literal blocks."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in _uncommented(text) if x.strip() and x.strip() != "---"]
    value, rest = _block(lines, 0)
    if rest != len(lines):
        raise ValueError(f"unexpected line: {lines[rest][1]}")
    return value


def _uncommented(text: str) -> list[str]:
    return [re.sub(r"(^|\s)#(?=(?:[^'\"]*(?:'[^']*'|\"[^\"]*\"))*[^'\"]*$).*$", "", x) for x in text.splitlines()]


def _block(lines: list[tuple[int, str]], at: int):
    if at >= len(lines):
        return None, at
    depth, first = lines[at]
    out = [] if first == "-" or first.startswith("- ") else {}
    if isinstance(out, dict) and not _key(first):
        return _scalar(first), at + 1
    while at < len(lines) and lines[at][0] == depth:
        line = lines[at][1]
        if isinstance(out, list):
            if not (line == "-" or line.startswith("- ")):
                break
            body = line[1:].strip()
            if body and _key(body) and not body.startswith(("{", "[", '"', "'")):
                # An entry that is a mapping: its first key stands on the dash's line.
                lines[at] = (depth + len(line) - len(body), body)
                value, at = _block(lines, at)
            else:
                value, at = _value(lines, at, depth, body)
            out.append(value)
        else:
            key = _key(line)
            if not key:
                raise ValueError(f"no key: {line}")
            out[_scalar(key[1])], at = _value(lines, at, depth, key[2])
    return out, at


def _key(line: str) -> re.Match | None:
    return re.match(r"""("[^"]*"|'[^']*'|[^\s:#\[{"'][^:]*?)\s*:(?:\s+(.*))?$""", line)


def _value(lines: list[tuple[int, str]], at: int, depth: int, body: str | None):
    if body in ("|", ">", "|-", ">-"):
        end = at + 1
        while end < len(lines) and lines[end][0] > depth:
            end += 1
        text = ("\n" if body[0] == "|" else " ").join(x for _, x in lines[at + 1 : end])
        return text + ("" if body.endswith("-") else "\n"), end
    if body:
        return _scalar(body), at + 1
    following = lines[at + 1] if at + 1 < len(lines) else (-1, "")
    if following[0] > depth or (following[0] == depth and following[1].startswith("- ") and not lines[at][1].startswith("-")):
        return _block(lines, at + 1)
    return None, at + 1


def _scalar(text: str):
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in _split(text[1:-1])]
    if text[:1] == "{" and text[-1:] == "}":
        return {_scalar(k): _scalar(v) for k, _, v in (x.partition(":") for x in _split(text[1:-1]))}
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r'\\(.)', lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    return int(text) if _NUMBER.fullmatch(text) else float(text) if _FLOAT.fullmatch(text) else text


def _split(text: str) -> list[str]:
    """The parts between commas outside quotes and brackets."""
    out, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        depth += (c in "[{") - (c in "]}") if not quote else 0
        if c == "," and not depth and not quote:
            out.append(part)
            part = ""
        else:
            part += c
    return [x for x in [*out, part] if x.strip()]
