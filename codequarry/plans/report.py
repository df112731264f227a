"""Reports: small results of an analysis as JSON and Markdown, findings also as Parquet."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators import contracts as C
from codequarry.operators import findings as N
from codequarry.sources import store as S

if TYPE_CHECKING:
    from codequarry.plans.project import Project
    from codequarry.policy import Policy

VERSION = "1.0"
DEAD = ("unused_import", "unused_method", "unused_property", "abandoned_class")
HARD = ("magic_string", "repeated_literal", "hardcoded_entity", "hardcoded_ip_url", "env_outside_config")
#: Rows of each Markdown section.
CAPS = {"circular_dependencies": 20, "layer_violations": 30, "coupling_metrics": 15, "god_classes": 20, "bottleneck_files": 10, "orphan_files": 30, "findings": 30}
COVERED = {"dead_code": {"javascript", "php", "python", "rust", "typescript", "vue"}, "hardwiring": {"javascript", "php", "python", "ruby", "rust", "typescript", "vue"}}


def health(cycles: int, god: int, violations: int, partial: bool) -> str:
    issues = 3 * cycles + 2 * god + violations
    if not issues:
        return "partial coverage" if partial else "healthy"
    return ("needs attention" if issues < 10 else "critical") + (" (partial coverage)" if partial else "")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def collect(project: Project, policy: Policy, graph: dict[str, DataFrame], findings: DataFrame, excluded: int, review: dict | None, inventory: DataFrame, runs: list[dict], external: DataFrame | None) -> dict[str, Any]:
    """Everything a report tells, as plain values. Findings come whole, as their tables are the report."""
    g = {k: _rows(graph[k]) for k in ("circular_dependencies", "strong_circular_dependencies", "coupling_metrics", "god_classes", "bottleneck_files", "layer_violations")}
    g |= {k: [r.path for r in graph[k].collect()] for k in ("orphan_files", "runtime_entry_candidates")} | graph["density"].first().asDict()
    files = project.store.read("files")
    languages = {r.language: r.n for r in S.language_breakdown(files).collect()}
    unsupported = {r.language: r.n for r in S.unsupported_of(project.tree()).collect()}
    partial = {d: sorted(set(languages) - known) for d, known in COVERED.items() if set(languages) - known}
    rows = _rows(findings.orderBy("category", "file_path", "line", "name", "value"))
    by = {c: [r for r in rows if r["category"] == c] for c in (*DEAD, *HARD)}
    hard = findings.filter(F.col("category").isin(*HARD))
    confirmed = sum(v["verdict"] == "true_positive" and v["category"] in ("hardcoded_ip_url", "env_outside_config") for v in (review or {}).get("verdicts", []))
    s = N.security_summary(hard).first()
    security = {"total_findings": s.total, "hardcoded_network": s.hardcoded_network, "env_outside_config": s.env_outside_config, "high_severity": s.high, "ai_confirmed": confirmed, "top_findings": [{"file": r.file_path, **{k: r[k] for k in ("line", "category", "value", "severity", "confidence")}} for r in N.security_top(hard).collect()]}
    cycles = len(g["strong_circular_dependencies"]) or len(g["circular_dependencies"])
    items = _rows(inventory)
    metrics = {"files": files.count(), "symbols": project.store.read("symbols").count(), "dependencies": project.store.read("dependencies").count(), "envelopes": project.store.read("envelopes").count(), "cycles": cycles, "violations": len(g["layer_violations"]), "god_classes": len(g["god_classes"]), "orphans": len(g["orphan_files"]), "dead_code": sum(len(by[c]) for c in DEAD), "hardwiring": sum(len(by[c]) for c in HARD)}
    data = {
        "version": VERSION, "project_path": project.root, "generated_at": datetime.now().isoformat(), "metrics": metrics, "health": health(cycles, metrics["god_classes"], metrics["violations"], bool(unsupported or partial)),
        "summary": {"files_indexed": metrics["files"], "symbols_extracted": metrics["symbols"], "dependencies_found": metrics["dependencies"], "envelopes_generated": metrics["envelopes"], "language_breakdown": languages, "unsupported_source_files": sum(unsupported.values()), "unsupported_language_breakdown": unsupported, "detector_coverage": partial},
        "policy": policy.to_dict(), "graph_analysis": g, "graph": {"nodes": g["node_count"], "edges": g["edge_count"], "density": g["density"]}, **{k: g[k] for k in ("circular_dependencies", "strong_circular_dependencies", "coupling_metrics", "god_classes", "layer_violations", "orphan_files", "runtime_entry_candidates")},
        "bottlenecks": g["bottleneck_files"], "dead_code": {"total": metrics["dead_code"], **{c: by[c] for c in DEAD}}, "hardwiring": {"total": metrics["hardwiring"], **{c: by[c] for c in HARD}}, "security": security, "review": review,
        "contracts": {"summary": {r["category"]: r["count"] for r in _rows(C.summary(inventory))}, **{c: [{k: i[k] for k in ("value", "count", "locations")} for i in items if i["category"] == c] for c in C.CATEGORIES if any(i["category"] == c for i in items)}},
        "external_analysis": {"tool_runs": runs, "findings": _rows(external) if external is not None else []}, "rules_prefiltered": excluded, "extensions": {},
    }
    verdicts = {k: (review or {}).get(k, 0) for k in ("true_positive", "false_positive", "needs_context")}
    shown = len(rows)
    data["feedback_loop"] = N.feedback_loop(shown + excluded, excluded, verdicts, (review or {}).get("rules_generated", 0)) | {"informational_visible": sum(bool(r.get("informational")) for r in rows), "external_visible": len(data["external_analysis"]["findings"]), "next_run_should_improve": bool((review or {}).get("rules_generated"))}
    data["recommendations"] = recommendations(data)
    data["agent_handoff"] = {
        "summary": f"{data['health']}: {shown} findings, {cycles} cycles", "priorities": [r["title"] for r in data["recommendations"]], "accepted_noise": excluded, "needs_context": verdicts["needs_context"],
        "next_steps": [r["description"] for r in data["recommendations"][:3]], "verification_commands": ["python -m codequarry report ."], "coverage_warnings": [f"{d}: {', '.join(x)}" for d, x in partial.items()] + [f"unsupported: {k} ({n})" for k, n in unsupported.items()],
    }
    return data


def recommendations(data: dict[str, Any], most: int = 7) -> list[dict]:
    """What to do first, from a fixed order of rules."""
    g, m, out = data["graph_analysis"], data["metrics"], []
    add = lambda title, text, priority: out.append({"title": title, "description": text, "priority": priority})
    if m["cycles"]:
        loaded = len(g["circular_dependencies"]) - m["cycles"]
        add("Break Circular Dependencies", f"{m['cycles']} cycles" + (f" ({loaded} more only by loading)" if loaded > 0 else "") + "; move what both sides need to a place of its own.", "high")
    if g["god_classes"]:
        worst = g["god_classes"][0]
        add("Refactor God Classes", f"{m['god_classes']} oversized classes, first {worst['name']} in {worst['file_path']} with {worst['method_count']} methods.", "high")
    if m["violations"]:
        add("Fix Layer Violations", f"{m['violations']} dependencies run from a deeper layer to a shallower one.", "medium")
    if g["bottleneck_files"]:
        worst = g["bottleneck_files"][0]
        add("Reduce Coupling on Bottleneck Files", f"{worst['path']} lies on most shortest paths ({worst['score']}).", "medium")
    if g["orphan_files"]:
        add("Review Potentially Dead Code", f"{m['orphans']} files use others and are used by none.", "low")
    if g["runtime_entry_candidates"]:
        add("Audit Runtime Entry Surfaces", f"{len(g['runtime_entry_candidates'])} files look like entry points; tell the policy about stable ones.", "low")
    sure = lambda cs: sum(v["verdict"] == "true_positive" and v["category"] in cs for v in (data["review"] or {}).get("verdicts", []))
    for title, total, cs in (("Clean Up Dead Code", m["dead_code"], DEAD), ("Reduce Hardwiring", m["hardwiring"], HARD)):
        if total:
            part = data["dead_code" if cs is DEAD else "hardwiring"]
            add(title, f"{total} findings" + (f" ({sure(cs)} confirmed)" if sure(cs) else "") + ": " + ", ".join(f"{len(part[c])} {c}" for c in cs if part[c]) + ".", "medium")
    if data["security"]["total_findings"]:
        add("Prioritize Security Hardwiring Cleanup", f"{data['security']['hardcoded_network']} addresses and {data['security']['env_outside_config']} environment reads outside of configuration.", "high" if data["security"]["high_severity"] else "medium")
    if not out:
        add("Maintain Current Standards", "No structural problem found.", "info")
    return out[:most]


def _table(rows: list[dict], columns: list[str], cap: int) -> list[str]:
    cell = lambda v: " → ".join(v) if isinstance(v, list) else str(v if v is not None else "").replace("|", "\\|").replace("\n", " ")[:120]
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)] + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows[:cap]]
    return out + ([f"... and {len(rows) - cap} more"] if len(rows) > cap else []) + [""]


def markdown(data: dict[str, Any]) -> str:
    g, out = data["graph_analysis"], [f"# Code-base report: {data['project_path']}", "", f"Generated {data['generated_at'][:19]}. Health: {data['health']}.", ""]
    out += ["## Overview", "", *_table([{"metric": k, "value": v} for k, v in data["metrics"].items()], ["metric", "value"], 99), "## Languages", "", *_table([{"language": k, "files": n} for k, n in data["summary"]["language_breakdown"].items()], ["language", "files"], 99)]
    for title, key, columns in (("Circular dependencies", "circular_dependencies", ["length", "cycle"]), ("God classes", "god_classes", ["name", "file_path", "method_count", "dependency_count", "line_count"]), ("Layer violations", "layer_violations", ["source_file", "target_name", "violation"]), ("Coupling", "coupling_metrics", ["module", "afferent", "efferent", "instability"]), ("Bottlenecks", "bottleneck_files", ["path", "score"])):
        if g[key]:
            out += [f"## {title}", "", *_table(g[key], columns, CAPS[key])]
    for title, key in (("Orphan files", "orphan_files"), ("Runtime entry candidates", "runtime_entry_candidates")):
        if g[key]:
            out += [f"## {title}", "", *_table([{"path": p} for p in g[key]], ["path"], CAPS["orphan_files"])]
    for section, categories in (("dead_code", DEAD), ("hardwiring", HARD)):
        for c in categories:
            if data[section][c]:
                out += [f"## {c.replace('_', ' ').capitalize()}", "", *_table(data[section][c], ["file_path", "line", "name" if section == "dead_code" else "value", "confidence"], CAPS["findings"])]
    if data["external_analysis"]["tool_runs"]:
        out += ["## Scanners", "", *_table(data["external_analysis"]["tool_runs"], ["tool", "status", "exit_code", "summary"], 99)]
    out += ["## Recommendations", "", *(f"{n}. **{r['title']}** ({r['priority']}): {r['description']}" for n, r in enumerate(data["recommendations"], 1)), ""]
    return "\n".join(out)


def handoff(data: dict[str, Any]) -> str:
    h = data["agent_handoff"]
    return "\n".join(["# Handoff", "", h["summary"], "", *(f"- {k}: {'; '.join(v) if isinstance(v, list) else v}" for k, v in h.items() if k != "summary"), ""])


def write(data: dict[str, Any], folder: str, run_id: str) -> list[str]:
    """Report and handoff in the folder, and copies of this run in reports/; a run id that is taken gets a number."""
    base = Path(folder)
    (base / "reports").mkdir(parents=True, exist_ok=True)
    unique, n = run_id, 1
    while (base / "reports" / f"{unique}-report.json").exists():
        n += 1
        unique = f"{run_id}_{n}"
    texts = {"report.json": json.dumps(data, indent=2, ensure_ascii=False, default=str), "report.md": markdown(data), "handoff.json": json.dumps(data["agent_handoff"], indent=2, ensure_ascii=False), "handoff.md": handoff(data)}
    out = []
    for name, text in texts.items():
        for path in (base / name, base / "reports" / f"{unique}-{name}"):
            path.write_text(text, encoding="utf-8")
            out.append(str(path))
    return out
