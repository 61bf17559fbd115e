"""Results as text: trees, tables, JSON."""

from __future__ import annotations

import json


def as_json(result: object) -> str:
    return json.dumps(result, indent=2, ensure_ascii=False, default=str)


def label(e: dict) -> str:
    place = f" ({e['file']}:{e['line']})" if e.get("file") and e.get("line") is not None else ""
    kind = f" [{e['refType']}]" if e.get("refType") else ""
    on = f" on {e['on']}" if e.get("on") else ""
    return f"{e.get('kind') or '?'} {e.get('fqn') or e.get('id')}{kind}{on}{place}"


def tree(entries: list[dict], indent: str = "") -> list[str]:
    out = []
    for i, e in enumerate(entries):
        last = i == len(entries) - 1
        out.append(f"{indent}{'└─ ' if last else '├─ '}{label(e)}")
        out += tree(e.get("children", []), indent + ("   " if last else "│  "))
    return out


def table(rows: list[dict]) -> list[str]:
    if not rows:
        return ["(none)"]
    cols = list(dict.fromkeys(c for r in rows for c in r))
    text = [[str(r.get(c, "")) for c in cols] for r in rows]
    width = [max(len(c), *(len(t[i]) for t in text)) for i, c in enumerate(cols)]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, width)).rstrip()
    return [line(cols), line(["-" * w for w in width]), *map(line, text)]


def as_text(result: dict) -> str:
    out = []
    head = result.get("target") or result.get("root")
    if head:
        out.append(label(head))
    for name in ("candidates", "chain"):
        if name in result:
            out += table(result[name])
    if "tree" in result:
        out += tree(result["tree"]) or ["(none)"]
    for name, title in (("usedBy", "USED BY"), ("uses", "USES")):
        if name in result:
            out += [title, *(tree(result[name]) or ["(none)"])]
    for name in ("rows", "results", "chunks"):
        if name in result:
            out += table(result[name])
    if "source" in result:
        out.append(result["source"])
    return "\n".join(out) if out else as_json(result)
