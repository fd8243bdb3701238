"""Reports from rollups, which are small: JSON, SARIF, text and HTML."""

from __future__ import annotations

import html
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from .. import fixed

LEVELS = {"high": "error", "medium": "warning"}


def rows_of(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """Rows of a rollup as dicts; more than ``limit`` is no rollup and an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report takes rollups, not records")
    return [r.asDict(recursive=True) for r in rows]


def without(value, name: str):
    """``value`` without every key of that name."""
    if isinstance(value, dict):
        return {k: without(v, name) for k, v in value.items() if k != name}
    return [without(v, name) for v in value] if isinstance(value, list) else value


def report_json(sections: dict[str, DataFrame]) -> str:
    """SNK8: sections as JSON, without any ``confidence``."""
    return json.dumps(without({k: rows_of(v) for k, v in sections.items()}, "confidence"), indent=2, default=str, ensure_ascii=False)


SARIF = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}


def report_sarif(findings: DataFrame, tool: str = "meterlark", deployments: DataFrame | None = None) -> str:
    """SNK9: findings (rule_id, severity, affected, impact_min_percent, impact_max_percent, ...) as SARIF: high is an error, medium a warning, else a note.

    Rules carry their titles; ``deployments`` (deployment_name, model_name, total_tokens) are summed up in the run's properties.
    """
    titles = {rule: title for rule, title, _, _ in fixed.RULES}
    rows = rows_of(findings)

    def message(r: dict) -> str:
        share = r.get("impact_max_percent")
        return f"{titles.get(r['rule_id'], r['rule_id'])}: {r.get('affected')} affected" + (f", up to {share} percent" if share is not None else "")

    results = [{"ruleId": r["rule_id"], "level": LEVELS.get(r.get("severity"), "note"), "message": {"text": message(r)}, "properties": {k: v for k, v in r.items() if k not in ("rule_id", "severity")}} for r in rows]
    rules = [{"id": i, "shortDescription": {"text": titles.get(i, i)}} for i in sorted({r["rule_id"] for r in rows})]
    about = [{k: r.get(k) for k in ("deployment_name", "model_name", "total_tokens")} for r in rows_of(deployments)] if deployments is not None else []
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "properties": {"deployments": [r["deployment_name"] for r in about], "deployment_summaries": about}, "results": results}
    return json.dumps({**SARIF, "runs": [run]}, indent=2, default=str)


def task_sarif(cohorts: DataFrame, tool: str = "meterlark task economics") -> str:
    """SNK10: a warning for each cohort (see ``tasks.cohorts``) with billable events that have no price."""
    rows = rows_of(cohorts)
    rule = {"id": "ECO-PRICING", "shortDescription": {"text": "Billable events of tasks without a price"}}
    results = [
        {"ruleId": rule["id"], "level": "warning", "message": {"text": f"{r['task_type']}: {r['unresolved_events']} billable events have no price"}, "properties": {"task_type": r["task_type"], "pricing_coverage_percent": r["coverage_percent"], "unresolved_tasks": r["unresolved_tasks"]}}
        for r in rows
        if r["unresolved_events"]
    ]
    totals = {"total_attempted_tasks": sum(r["attempted_tasks"] for r in rows), "total_solved_tasks": sum(r["solved_tasks"] for r in rows)}
    return json.dumps({**SARIF, "runs": [{"tool": {"driver": {"name": tool, "rules": [rule]}}, "properties": totals, "results": results}]}, indent=2, default=str)


def report_text(sections: dict[str, DataFrame]) -> str:
    """SNK13 to SNK15: sections as aligned text."""
    out = []
    for name, df in sections.items():
        rows = rows_of(df)
        cells = [df.columns, *[["-" if r[c] is None else str(r[c]) for c in df.columns] for r in rows]]
        widths = [max(len(row[i]) for row in cells) for i in range(len(df.columns))]
        out += [name, *["  " + "  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells], ""]
    return "\n".join(out)


def report_html(sections: dict[str, DataFrame], title: str = "Usage report") -> str:
    """SNK11, SNK12: sections as plain tables."""
    parts = []
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{'' if r[c] is None else html.escape(str(r[c]))}</td>" for c in df.columns) + "</tr>" for r in rows_of(df))
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(parts)}"


def timestamped_path(folder: str, kind: str, now: datetime | None = None) -> Path:
    """SNK17: a name with the time that no file has yet."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%d-%H%M%S")
    path, n = Path(folder) / f"report-{stamp}.{kind}", 1
    while path.exists():
        path, n = Path(folder) / f"report-{stamp}-{n}.{kind}", n + 1
    return path


def write_private(content: str, path: str | Path) -> None:
    """SNK16: write a report in one step, readable by its owner alone."""
    part = Path(f"{path}.part")
    fd = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(part, path)
