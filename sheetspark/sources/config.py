"""Settings: a small YAML subset (maps, sequences, scalars, quotes, comments), typed with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


def _strip(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def scalar(text: str):
    """Quoted text, true/false words, numbers, empty flow collections, null, else the text."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t.lower() in ("true", "yes", "on"):
        return True
    if t.lower() in ("false", "no", "off"):
        return False
    if t in ("", "~", "null"):
        return None
    if t == "[]":
        return []
    if t == "{}":
        return {}
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def _colon(text: str) -> int:
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ":" and (i + 1 == len(text) or text[i + 1].isspace()):
            return i
    return -1


def parse_yaml(text: str):
    """The value of a document in the subset; indentation nests, tabs are an error."""
    lines = [(len(s) - len(s.lstrip(" ")), s.strip()) for s in map(_strip, text.splitlines()) if s.strip() and s.strip() != "---"]
    value, at = _block(lines, 0, lines[0][0]) if lines else ({}, 0)
    if at < len(lines):
        raise ValueError(f"unexpected indentation at {lines[at][1]!r}")
    return value


def _block(lines, at, indent):
    if lines[at][1].startswith("-") and (lines[at][1] == "-" or lines[at][1][1] == " "):
        out = []
        while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
            rest = lines[at][1][1:].strip()
            if not rest:
                value, at = _block(lines, at + 1, lines[at + 1][0]) if at + 1 < len(lines) and lines[at + 1][0] > indent else (None, at + 1)
            elif _colon(rest) >= 0:
                inner = indent + len(lines[at][1]) - len(rest)
                lines[at] = (inner, rest)
                value, at = _block(lines, at, inner)
            else:
                value, at = scalar(rest), at + 1
            out.append(value)
        return out, at
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        key, rest = lines[at][1], ""
        c = _colon(key)
        if c < 0:
            raise ValueError(f"expected a key at {key!r}")
        key, rest = str(scalar(key[:c])), key[c + 1 :].strip()
        if rest:
            value, at = scalar(rest), at + 1
        elif at + 1 < len(lines) and lines[at + 1][0] > indent:
            value, at = _block(lines, at + 1, lines[at + 1][0])
        else:
            value, at = None, at + 1
        out[key] = value
    return out, at


@dataclass
class Meshing:
    cell_um: float = 2.0
    max_cells: int = 30
    via_group_um: float = 0.5
    per_layer_cell_um: dict = field(default_factory=dict)
    adaptive: bool = False
    max_level: int = 3
    max_nodes: int = 400_000
    iterations: int = 8
    marking: float = 0.5


@dataclass
class Solver:
    tolerance: float = 1e-8
    max_iterations: int = 20_000
    bias_tolerance: float = 1e-3
    bias_iterations: int = 20
    missing_model: str = "error"


@dataclass
class Settings:
    paths: dict = field(default_factory=dict)
    temperature_c: float = 25.0
    meshing: Meshing = field(default_factory=Meshing)
    solver: Solver = field(default_factory=Solver)
    terminals: list = field(default_factory=list)


def _fill(cls, given):
    made = cls()
    for k, v in (given or {}).items():
        if hasattr(made, k) and v is not None:
            default = getattr(made, k)
            setattr(made, k, type(default)(v) if isinstance(default, (int, float, str)) and not isinstance(default, bool) else v)
    return made


#: Other names of two mesh settings.
MESHING_NAMES = {"sheet_cell_um": "cell_um", "sheet_cap": "max_cells"}


def settings(text: str) -> Settings:
    """Typed settings of a document; what is absent keeps its default."""
    doc = parse_yaml(text) or {}
    mesh = {MESHING_NAMES.get(k, k): v for k, v in (doc.get("meshing") or {}).items()}
    out = Settings(paths=doc.get("project") or {}, meshing=_fill(Meshing, mesh), solver=_fill(Solver, doc.get("solver")), terminals=doc.get("terminals") or [])
    given = [(doc.get(part) or {}).get("temperature_c") for part in ("solver", "project")]
    out.temperature_c = float(next((t for t in given if t is not None), 25.0))
    if out.solver.missing_model not in ("error", "open"):
        raise ValueError("missing_model is error or open")
    return out


def layer_overrides(text: str) -> dict[str, float]:
    """``Layer lateral_um`` lines; # starts a comment; sizes that are not positive are ignored."""
    out = {}
    for line in text.splitlines():
        parts = line.split("#")[0].split()
        if len(parts) >= 2:
            try:
                size = float(parts[1])
            except ValueError:
                continue
            if size > 0:
                out[parts[0]] = size
    return out
