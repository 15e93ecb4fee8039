"""Graphviz texts of one target's graph."""

from __future__ import annotations

from ..operators.local import SINK, SOURCE, Graph

COLORS = ("red", "blue", "green", "orange", "purple", "brown")


def short(kmer: str) -> str:
    return f"{kmer[:5]}...{kmer[-5:]}" if len(kmer) > 15 else kmer


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def node_line(graph: Graph, x: str, color: str | None = None) -> str:
    if x in (SOURCE, SINK):
        return f"  {quoted(x)} [shape=diamond, style=filled, fillcolor=gray];"
    known = x in graph.reference
    look = "style=filled, fillcolor=lightblue" if known else "style=filled, fillcolor=lightyellow"
    return f"  {quoted(x)} [label={quoted(f'{short(x)}\\n{graph.counts[x]}').replace(chr(92) * 2 + 'n', chr(92) + 'n')}, {look}{f', color={color}, penwidth=2' if color else ''}];"


def nodes_of(graph: Graph) -> list[str]:
    ends = [x for x in (SOURCE, SINK) if graph.out.get(x) or graph.into.get(x)]
    return ends + sorted(graph.counts)


def graph_dot(graph: Graph, name: str, routes: list[list[str]] = (), legend: bool = False) -> str:
    """All live nodes and edges; nodes and edges of the given paths (after the first) are coloured."""
    paint: dict = {}
    for i, path in enumerate(routes):
        color = "black" if i == 0 else COLORS[(i - 1) % len(COLORS)]
        for x in path:
            paint.setdefault(x, color)
        for pair in zip([SOURCE, *path], [*path, SINK]):
            paint.setdefault(pair, color)
    out = [f"digraph {quoted(name)} {{", "  rankdir=LR;"]
    out += [node_line(graph, x, paint.get(x)) for x in nodes_of(graph)]
    for a, b, w, known in graph.edges():
        look = "style=solid" if known else "style=dashed"
        color = paint.get((a, b))
        out.append(f"  {quoted(a)} -> {quoted(b)} [label={quoted(f'{w:g}')}, {look}{f', color={color}, penwidth=2' if color else ''}];")
    if legend:
        out += ["  subgraph cluster_legend {", '    label="Legend";', "    legend_ref [label=reference, style=filled, fillcolor=lightblue];", "    legend_alt [label=variant, style=filled, fillcolor=lightyellow];", "    legend_end [label=end, shape=diamond, style=filled, fillcolor=gray];", "  }"]
    return "\n".join([*out, "}"]) + "\n"


def simplified_dot(graph: Graph, name: str) -> str:
    """Chains of two or more nodes with one way in and out are one node."""
    inner = lambda x: x in graph.counts and len(graph.out.get(x, ())) == 1 and len(graph.into.get(x, ())) == 1
    of: dict[str, str] = {}
    labels: dict[str, str] = {}
    for x in sorted(graph.counts):
        if x in of or not inner(x):
            continue
        chain = [x]
        while inner(before := next(iter(graph.into[chain[0]]))) and before not in chain:
            chain.insert(0, before)
        while inner(after := next(iter(graph.out[chain[-1]]))) and after not in chain:
            chain.append(after)
        if len(chain) > 1:
            head = chain[0]
            counts = [graph.counts[y] for y in chain]
            labels[head] = f"{short(chain[0])} .. {short(chain[-1])} ({len(chain)} k-mers, {min(counts)}-{max(counts)})"
            of.update(dict.fromkeys(chain, head))
    out = [f"digraph {quoted(name)} {{", "  rankdir=LR;"]
    for x in nodes_of(graph):
        if of.get(x, x) == x:
            out.append(f"  {quoted(x)} [label={quoted(labels[x])}, shape=box];" if x in labels else node_line(graph, x))
    for a, b in sorted({(of.get(a, a), of.get(b, b)) for a, b, _, _ in graph.edges()}):
        if a != b or a not in labels:
            out.append(f"  {quoted(a)} -> {quoted(b)};")
    return "\n".join([*out, "}"]) + "\n"


def filter_flow_dot(counts: dict[str, int], name: str = "filter") -> str:
    """From all expected variants over the criteria that rejected some to those found.

    counts: total, not_detected, coverage, VAF, expression, type, found; a variant that
    fails several criteria counts under each.
    """
    out = [f"digraph {quoted(name)} {{", "  rankdir=TB;", f'  all [label="expected: {counts.get("total", 0)}"];']
    last = "all"
    for step in ("not_detected", "coverage", "VAF", "expression", "type"):
        out += [f'  {step} [label="{step}", shape=box];', f"  {last} -> {step};"]
        if n := counts.get(step, 0):
            out += [f'  {step}_out [label="rejected: {n}", style=filled, fillcolor=mistyrose];', f"  {step} -> {step}_out;"]
        last = step
    return "\n".join([*out, f'  found [label="found: {counts.get("found", 0)}", style=filled, fillcolor=palegreen];', f"  {last} -> found;", "}"]) + "\n"
