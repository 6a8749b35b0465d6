"""Run configurations: the subset of YAML that they use (nested maps, lists, scalars, comments), without a YAML library."""

from __future__ import annotations

import re
from pathlib import Path

from tesselon.sources.tables import AreaConfig

# Words that YAML reads as something other than text.
WORDS = {"true": True, "false": False, "null": None, "~": None, "": None}


def scalar(text: str):
    """A number, truth value, null, quoted or plain text, or a list or map in brackets."""
    text = text.strip()
    if text[:1] in ("[", "{"):
        if text[-1] != {"[": "]", "{": "}"}[text[0]]:
            raise ValueError(f"unclosed {text!r}")
        items = _split(text[1:-1])
        if text[0] == "[":
            return [scalar(i) for i in items]
        return {k.strip().strip("'\""): scalar(v) for k, _, v in (i.partition(":") for i in items)}
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in WORDS:
        return WORDS[text.lower()]
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


def _split(text: str) -> list[str]:
    """Items between commas that no bracket or quote encloses."""
    out, depth, quote, item = [], 0, None, ""
    for c in text:
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item] if item.strip() else out


def _bare(line: str) -> str:
    """The line without its comment."""
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"" and (i == 0 or line[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def parse(text: str) -> dict:
    """A document of nested maps; lists are in brackets or have one scalar a dashed line.  Tabs can't indent."""
    lines = [(len(bare) - len(bare.lstrip(" ")), bare.strip()) for raw in text.splitlines() if (bare := _bare(raw)).strip() and bare.strip() != "---"]

    def block(at: int, indent: int):
        out = [] if lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            at += 1
            if isinstance(out, list):
                if not line.startswith("- "):
                    raise ValueError(f"list ends at {line!r}")
                out.append(scalar(line[2:]))
                continue
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no key in {line!r}")
            key = key.strip().strip("'\"")
            nested = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ")))
            if not value.strip() and nested:
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = scalar(value)
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"unexpected indentation of {lines[at][1]!r}")
        return out, at

    if not lines:
        return {}
    out, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"unexpected indentation of {lines[at][1]!r}")
    return out


def load_config(path: str) -> dict:
    return parse(Path(path).read_text(encoding="utf-8"))


def area(config: dict) -> AreaConfig:
    """The area of interest that a configuration describes; another coordinate system raises ValueError."""
    aoi, imagery = config["aoi"], config.get("imagery") or {}
    return AreaConfig(
        name=aoi["name"],
        crs=aoi.get("crs", "EPSG:2056"),
        bbox=tuple(float(v) for v in aoi["bbox_lv95"]),
        tile_size_px=imagery.get("tile_size_px", 1024),
        overlap_px=imagery.get("tile_overlap_px", 128),
        res_m=imagery.get("res_m", 0.1),
        paths=config.get("paths") or {},
    )
