"""Bounded graphs as text: one line for each dependency, or a Mermaid flowchart.

Both take rows already ordered and cut by ``operators.graph.truncate``, a few
hundred at most, so they are plain Python on the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

# Markers and styles of each status, and the bytes of a label.
MARKERS = {"removed": "-", "added": "+", "unchanged": " "}
STYLES = {
    "added": "fill:#e6ffed,stroke:#22863a",
    "removed": "fill:#ffeef0,stroke:#cb2431",
    "modified": "fill:#fff5b1,stroke:#b08800",
    "unchanged": "fill:#f6f8fa,stroke:#d1d5db",
}
LABEL_BYTES, CUT = 64, "..."


def clean_label(text: str) -> str:
    """A label that can't be read as structure: no quotes or control characters, one space at most, 64 bytes."""
    flat = " ".join("".join(" " if unicodedata.category(c) == "Cc" else c for c in text.replace('"', "")).split())
    raw = flat.encode()
    return flat if len(raw) <= LABEL_BYTES else raw[:LABEL_BYTES].decode(errors="ignore") + CUT


def confidence_text(value: float) -> str:
    return "~" + re.sub(r"\.?0*$", "", f"{value:.2f}")


def place(node: Mapping) -> str:
    """How a line names a node: a module by path, a function by path and name, a group by label."""
    return {"function": f"{node['path']}::{node['label']}", "group": clean_label(node["label"])}.get(node["kind"], node["path"])


def dependency_lines(nodes: Iterable[Mapping], edges: Iterable[Mapping]) -> str:
    """A line for each edge whose ends are both there; imports go unnamed."""
    by_id = {n["id"]: n for n in nodes}
    out = []
    for e in edges:
        if e["from_id"] in by_id and e["to_id"] in by_id:
            link = "->" if e["relation"] == "imports" else f"-[{e['relation']}]->"
            out.append(f"{MARKERS[e['status']]} {place(by_id[e['from_id']])} {link} {place(by_id[e['to_id']])}\n")
    return "".join(out)


class _Chart:
    def __init__(self, nodes: list[Mapping]):
        self.by_id, self.named = {n["id"]: n for n in nodes}, set()

    def box(self, node_id: str) -> str:
        """The key, with its label on first mention."""
        n = self.by_id[node_id]
        if node_id in self.named:
            return n["key"]
        self.named.add(node_id)
        suffix = "" if n["status"] == "unchanged" else f" · {n['status']}"
        return f'{n["key"]}["{clean_label(n["label"])}{suffix}"]'


def _arrow(edge: Mapping) -> str:
    if edge["status"] == "removed":
        return '-. "removed" .->'
    if edge["confidence"] < 1:
        return f'-. "{confidence_text(edge["confidence"])}" .->'
    return '-- "re_exports" -->' if edge["relation"] == "re_exports" else "-->"


def mermaid(nodes: list[Mapping], edges: Iterable[Mapping], cycles: Iterable[tuple[str, list[str]]] = ()) -> str:
    """A flowchart: styles, a box for each cycle of two nodes or more, edges, lone nodes, classes."""
    chart = _Chart(nodes)
    lines = ["flowchart LR", *(f"    classDef {k} {v}" for k, v in STYLES.items())]
    for key, members in cycles:
        inside = [m for m in members if m in chart.by_id]
        if len(inside) > 1:
            lines += [f'    subgraph {key}["cycle · {len(members)} nodes"]', *(f"        {chart.box(m)}" for m in inside), "    end"]
    lines += [f"    {chart.box(e['from_id'])} {_arrow(e)} {chart.box(e['to_id'])}" for e in edges if e["from_id"] in chart.by_id and e["to_id"] in chart.by_id]
    lines += [f"    {chart.box(n['id'])}" for n in nodes if n["id"] not in chart.named]
    lines += [f"    class {n['key']} {n['status']}" for n in nodes]
    return "\n".join(lines) + "\n"
