"""Texts for small results: tables, JSON, CSV and Markdown."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from .operators.compare import METRICS
from .plans.pipeline import ITEM

# The columns shown and their headings.
COLUMNS = {"recommendation": "RECOMMENDATION", "recommendation_score": "SCORE", "title": "TITLE", "provider": "PROVIDER", "asking_price": "ASKING", "estimated_market_price": "MARKET", "net_profit": "NET", "roi_percentage": "ROI%", "confidence_score": "CONF"}
CSV_COLUMNS = ("recommendation", "recommendation_score", "title", "provider", "currency", "asking_price", "estimated_market_price", "gross_profit", "net_profit", "roi_percentage", "margin_percentage", "confidence_score", "risk_score", "comparable_count", "group_size", "reasons")
RUN_COLUMNS = {"run_id": "RUN", "created_at": "CREATED", "query": "QUERY", "total_listings_scanned": "SCANNED", "total_groups": "GROUPS", "total_opportunities": "OPPS", "config_summary": "CONFIG"}
SHOW_COLUMNS = {"rank": "RANK"} | COLUMNS | {"risk_score": "RISK"}
METRIC_HEADS = {"recommendation_score": "SCORE", "roi_percentage": "ROI%", "net_profit": "NET", "confidence_score": "CONF", "risk_score": "RISK"}
DELTA_COLUMNS = ["category", "key", "provider", "title", "reason", *(f"{m}_{x}" for m, _ in METRICS for x in ("old", "new", "delta"))]

Record = Mapping[str, Any]


def cell(value: object) -> str:
    return "-" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value)


def table(head: Sequence[str], rows: Iterable[Sequence[str]]) -> str:
    """Fixed-width columns, with a rule below the headings."""
    grid = [list(head), *map(list, rows)]
    width = [max(map(len, column)) for column in zip(*grid, strict=True)]
    lines = ["  ".join(x.ljust(w) for x, w in zip(row, width, strict=True)) for row in grid]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def markdown(head: Sequence[str], rows: Iterable[Sequence[str]]) -> str:
    return "\n".join("| " + " | ".join(row) + " |" for row in [head, ["---"] * len(head), *rows])


def as_csv(head: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([head, *rows])
    return out.getvalue().removesuffix("\n")


def _cells(columns: Mapping[str, str], rows: Sequence[Record]) -> list[list[str]]:
    return [[cell(r[k]) for k in columns] for r in rows]


def scan_result(form: str, query: str, rows: Sequence[Record], *, scanned: int, groups: int, counts: Mapping[str, int]) -> str:
    """The shown rows of a scan; ``groups`` is the number of all items."""
    if form == "json":
        items = [{k: r[k] for k in ITEM} for r in rows]
        return json.dumps({"query": query, "total_listings_scanned": scanned, "total_groups": groups, "counts_by_recommendation": dict(counts), "items": items, "shown": len(rows)}, indent=2)
    if form == "csv":
        return as_csv(CSV_COLUMNS, [[";".join(r[k]) if k == "reasons" else r[k] for k in CSV_COLUMNS] for r in rows])
    heads = list(COLUMNS.values())
    if form == "markdown":
        top = f"# Opportunities for {query!r}\n\n- Scanned **{scanned}** listings into **{groups}** groups\n- Showing **{len(rows)}** of **{groups}** opportunities\n\n"
        return top + (markdown(heads, _cells(COLUMNS, rows)) if rows else "_No opportunities._")
    top = f"query: {query!r}\nscanned {scanned} listings -> {groups} groups\nshowing {len(rows)} of {groups} opportunities\ncounts: " + ", ".join(f"{k}={v}" for k, v in counts.items())
    return f"{top}\n\n{table(heads, _cells(COLUMNS, rows))}" if rows else f"{top}\n(no opportunities)"


def runs(form: str, rows: Sequence[Record]) -> str:
    if form == "json":
        return json.dumps([{k: r[k] for k in RUN_COLUMNS} for r in rows], indent=2)
    return table(list(RUN_COLUMNS.values()), _cells(RUN_COLUMNS, rows)) if rows else "(no saved runs)"


def stored_run(form: str, run: Record, rows: Sequence[Record]) -> str:
    if form == "json":
        return json.dumps({"run": dict(run), "opportunities": [dict(r) for r in rows]}, indent=2)
    if form == "csv":
        return as_csv(list(SHOW_COLUMNS), [[r[k] for k in SHOW_COLUMNS] for r in rows])
    top = f"run {run['run_id']}: {run['query']!r} @ {run['created_at']}\nscanned {run['total_listings_scanned']} listings -> {run['total_groups']} groups, {run['total_opportunities']} opportunities ({run['config_summary']})"
    return f"{top}\n\n{table(list(SHOW_COLUMNS.values()), _cells(SHOW_COLUMNS, rows))}" if rows else f"{top}\n(no opportunities)"


def delta_cell(delta: float) -> str:
    return "=" if delta == 0 else f"{delta:+.2f}"


def comparison(form: str, old: Record, new: Record, deltas: Sequence[Record], counts: Mapping[str, int]) -> str:
    metrics = [m for m, _ in METRICS]
    if form == "json":
        rows = [{k: d[k] for k in ("category", "key", "provider", "title", "reason")} | {"metrics": [{"name": m, "old": d[f"{m}_old"], "new": d[f"{m}_new"], "delta": d[f"{m}_delta"], "higher_is_better": up} for m, up in METRICS]} for d in deltas]
        return json.dumps({"old_run": dict(old), "new_run": dict(new), "counts": dict(counts), "deltas": rows}, indent=2)
    if form == "csv":
        return as_csv(DELTA_COLUMNS, [[d[k] for k in DELTA_COLUMNS] for d in deltas])
    top = [f"compare run {old['run_id']} ({old['created_at']}) -> run {new['run_id']} ({new['created_at']})", f"old query: {old['query']!r} | new query: {new['query']!r}", "counts: " + ", ".join(f"{k}={v}" for k, v in counts.items())]
    heads = ["CATEGORY", "PROVIDER", "TITLE", *METRIC_HEADS.values()]
    rows = [[d["category"], d["provider"], d["title"], *(delta_cell(d[f"{m}_delta"]) for m in metrics)] for d in deltas]
    if form == "markdown":
        start = "\n".join([f"# Comparison: run {old['run_id']} -> run {new['run_id']}", "", *(f"- {x}" for x in top[1:]), "", ""])
        return start + (markdown(heads, rows) if rows else "_No opportunities in either run._")
    return "\n".join(top) + (f"\n\n{table(heads, rows)}" if rows else "\n(no opportunities in either run)")
