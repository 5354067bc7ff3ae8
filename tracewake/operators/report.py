"""Reports for people, from the few rows that a limit leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(value: float | None) -> str:
    """Four decimals; nothing smaller than half the last one, and no negative zero."""
    if value is None:
        return "–"
    return f"{0.0 if abs(value) < 5e-5 else value:.4f}"


def investigation(candidates: DataFrame, evidence: DataFrame, description: str, changed: list[str], limit: int = 20) -> dict:
    """The report as a document: the ``limit`` best candidates (``eligible_rank, path, version_id``) with their evidence in order."""
    best = candidates.orderBy("eligible_rank").limit(limit)
    lines = evidence.join(F.broadcast(best.select("version_id")), "version_id", "left_semi").orderBy("version_id", "ordinal").collect()
    by: dict = {}
    for r in lines:
        by.setdefault(r["version_id"], []).append({"id": r["id"], "type": r["type"], "text": r["sentence"]})
    rows = [{"rank": r["eligible_rank"], "path": r["path"], "version_id": r["version_id"], "evidence": by.get(r["version_id"], [])} for r in best.collect()]
    return {"description": description, "changed": changed, "candidates": rows}


def markdown(report: dict) -> str:
    out = [f"# Files to look at\n\n{report['description']}\n", "Changed: " + ", ".join(f"`{p}`" for p in report["changed"]) + "\n"]
    for c in report["candidates"]:
        out.append(f"## {c['rank']}. `{c['path']}`\n")
        out += [f"- {e['text']}" for e in c["evidence"]]
        out.append("")
    return "\n".join(out)


def metrics_table(rows: list[dict], metrics: list[str]) -> str:
    """A Markdown table of macro averages by method."""
    head = "| method | " + " | ".join(metrics) + " |\n|---|" + "---|" * len(metrics)
    return "\n".join([head, *["| " + " | ".join([r["method"], *[cell(r[m]) for m in metrics]]) + " |" for r in rows]])


def pack_batches(sizes: list[int], budget: int) -> list[list[int]]:
    """Positions of candidates packed in order into batches under a budget of characters; one over it is an error."""
    out: list[list[int]] = []
    held = budget + 1
    for i, size in enumerate(sizes):
        if size > budget:
            raise ValueError(f"candidate {i} alone exceeds the budget")
        if held + size > budget:
            out.append([])
            held = 0
        out[-1].append(i)
        held += size
    return out


def evaluation(statistics: list[dict], status: list[dict], decision: dict, metrics: list[str], scale: int) -> str:
    """An evaluation as Markdown, from its results alone.

    ``statistics`` are rows with ``stratum, series, population`` and of each metric its exact sum and both ends of its interval; ``status`` counts by ``method, status``.
    Strata without members are named as such by having no table.
    """
    out = ["# Evaluation\n", f"Decision: **{decision['outcome']}** (rule {decision['rule']}).\n", "| method | status | commits |", "|---|---|---|"]
    out += [f"| {r['method']} | {r['status']} | {r['n_commits']} |" for r in sorted(status, key=lambda r: (r["method"], r["status"]))]
    by: dict = {}
    for r in statistics:
        by.setdefault(r["stratum"], []).append(r)
    for stratum, rows in by.items():
        out += ["", f"## {stratum} ({rows[0]['population']} commits)\n", "| series | " + " | ".join(metrics) + " |", "|---|" + "---|" * len(metrics)]
        for r in sorted(rows, key=lambda r: (" - " in r["series"], r["series"])):
            rate = lambda m: r[f"{m}_sum"] / (scale * r["population"])  # noqa: B023, E731
            out.append(f"| {r['series']} | " + " | ".join(f"{cell(rate(m))} [{cell(r[f'{m}_lower'])}, {cell(r[f'{m}_upper'])}]" for m in metrics) + " |")
    return "\n".join(out) + "\n"
