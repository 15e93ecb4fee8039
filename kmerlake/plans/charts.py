"""Charts as SVG texts; figures are aggregated by Spark, only those are gathered."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics
from ..schemas import VARIANT_TYPES

WIDTH, HEIGHT, EDGE = 800, 500, 60
PALETTE = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#b279a2")
CHARTS = ("vaf-histogram", "detection-bar", "type-distribution", "summary-pie")


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def label(x: float, y: float, text: str, anchor: str = "middle", size: int = 12, turn: bool = False) -> str:
    rotate = f' transform="rotate(-45 {x:.1f} {y:.1f})"' if turn else ""
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="{anchor}"{rotate}>{escape(text)}</text>'


def page(title: str, body: list[str]) -> str:
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif">', f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>', label(WIDTH / 2, 30, title, size=18), *body, "</svg>"]) + "\n"


def bars(title: str, names: list[str], values: list[list[float]], x_title: str, y_title: str) -> str:
    """Stacked bars; values has a list of layers for each name."""
    top = max((sum(v) for v in values), default=0) or 1
    wide, high = WIDTH - 2 * EDGE, HEIGHT - 2.5 * EDGE
    step = wide / max(1, len(names))
    base = HEIGHT - 1.5 * EDGE
    out = [f'<line x1="{EDGE}" y1="{base}" x2="{WIDTH - EDGE}" y2="{base}" stroke="black"/>', f'<line x1="{EDGE}" y1="{base - high}" x2="{EDGE}" y2="{base}" stroke="black"/>']
    for i in range(5):
        out.append(label(EDGE - 6, base - high * i / 4 + 4, f"{top * i / 4:g}", "end", 10))
    for i, (name, layers) in enumerate(zip(names, values)):
        y = base
        for k, v in enumerate(layers):
            tall = high * v / top
            y -= tall
            out.append(f'<rect x="{EDGE + i * step + step * 0.1:.1f}" y="{y:.1f}" width="{step * 0.8:.1f}" height="{tall:.1f}" fill="{PALETTE[k % len(PALETTE)]}"/>')
        out.append(label(EDGE + (i + 0.5) * step, base + 16, name, "end" if len(names) > 8 else "middle", 10, len(names) > 8))
    return page(title, [*out, label(WIDTH / 2, HEIGHT - 12, x_title), label(16, 50, y_title, "start")])


def pie(title: str, parts: list[tuple[str, float]]) -> str:
    total = sum(v for _, v in parts) or 1
    x, y, r, at = WIDTH / 2 - 100, HEIGHT / 2 + 15, 160, -math.pi / 2
    out = []
    for i, (name, v) in enumerate(parts):
        color = PALETTE[i % len(PALETTE)]
        turn = 2 * math.pi * v / total
        if v == total:
            out.append(f'<circle cx="{x}" cy="{y}" r="{r}" fill="{color}"/>')
        elif v:
            a, b = (x + r * math.cos(at), y + r * math.sin(at)), (x + r * math.cos(at + turn), y + r * math.sin(at + turn))
            out.append(f'<path d="M{x},{y} L{a[0]:.2f},{a[1]:.2f} A{r},{r} 0 {int(turn > math.pi)} 1 {b[0]:.2f},{b[1]:.2f} Z" fill="{color}"/>')
        at += turn
        out += [f'<rect x="{x + r + 40}" y="{y - 40 + 24 * i}" width="14" height="14" fill="{color}"/>', label(x + r + 60, y - 28 + 24 * i, f"{name}: {v:g} ({100 * v / total:.1f}%)", "start")]
    return page(title, out)


def chart(calls: DataFrame, kind: str) -> str:
    """One of CHARTS; an error for calls without what it shows."""
    if kind not in CHARTS:
        raise ValueError(f"charts are {', '.join(CHARTS)}")
    if calls.isEmpty():
        raise ValueError("no calls to plot")
    if kind == "detection-bar":
        rows = metrics.detection_bars(calls).collect()
        return bars("Detected calls by target", [r["target"] for r in rows], [[r["detected"], r["reference"]] for r in rows], "target", "calls")
    if kind == "summary-pie":
        r = metrics.summary(calls).first()
        return pie("Detection summary", [("Detected", r["detected"]), ("Reference", r["total_targets"] - r["detected"])])
    if calls.filter(F.col("type") != "Reference").isEmpty():
        raise ValueError("no variant calls to plot")
    if kind == "type-distribution":
        found = {r["type"]: r["n"] for r in metrics.type_histogram(calls).collect()}
        names = [t for t in VARIANT_TYPES if t in found]
        return bars("Variant types", names, [[found[t]] for t in names], "type", "calls")
    rows = {r["bin"]: r for r in metrics.vaf_histogram(calls).collect()}
    some = next(iter(rows.values()))
    width = some["high"] - some["low"]
    return bars("Allele frequencies", [f"{width * i:.3f}" for i in range(20)], [[rows[i]["n"] if i in rows else 0] for i in range(20)], "rVAF", "calls")
