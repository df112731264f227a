"""Steps that a language model may take: prompts with bounded excerpts, readers of what comes back, and chains of backends.

A backend is a function from a prompt to a text, or None if it can't answer; the first answer counts. None is built in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Backend = Callable[[str], str | None]
#: Rows of each part that a synthesis prompt shows.
SHOWN = {"circular_dependencies": 20, "layer_violations": 20, "god_classes": 15, "coupling_metrics": 10, "bottleneck_files": 10, "orphan_files": 30}
ENVELOPES_A_LAYER = 10
VERDICTS = ("true_positive", "false_positive", "needs_context")


def ask(backends: Iterable[Backend], prompt: str) -> str | None:
    """The first answer; a backend that fails is passed over."""
    for backend in backends:
        try:
            answer = backend(prompt)
        except Exception:  # any fault of a foreign backend means the next one's turn
            continue
        if answer:
            return answer
    return None


def agent_messages(events: DataFrame) -> DataFrame:
    """(text) of the finished messages in a model client's event lines (payload string); other lines give nothing."""
    e = F.from_json("payload", "type string, item struct<type: string, text: string>")
    return events.select(e.alias("e")).filter("e.type = 'item.completed' and e.item.type = 'agent_message' and e.item.text is not null").select("e.item.text")


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: from the first brace to the last, without fences around; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "(?m)^```\\w*\\s*$", ""), r"(?s)\{.*\}", 0), F.lit(""))


def read_object(text: str | None) -> dict[str, Any] | None:
    found = re.search(r"\{.*\}", re.sub(r"(?m)^```\w*\s*$", "", text or ""), re.S)
    try:
        value = json.loads(found.group()) if found else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def review_prompt(category: str, findings: list[dict], context: dict[tuple[str, int], str]) -> str:
    rows = [f"{n}. {f['file_path']}:{f['line']} {f.get('name') or f.get('value') or ''}\n{context.get((f['file_path'], f['line']), '')}" for n, f in enumerate(findings)]
    return f"Judge each {category} finding as one of {', '.join(VERDICTS)}. Answer with a JSON object {{\"verdicts\": [{{\"index\": n, \"verdict\": v, \"reason\": r}}]}}.\n\n" + "\n\n".join(rows)


def read_verdicts(answer: str | None, findings: list[dict]) -> list[dict]:
    """A verdict for each finding; those that the answer leaves out, or judges by an unknown word, need context."""
    told = {v.get("index"): v for v in (read_object(answer) or {}).get("verdicts", []) if isinstance(v, dict) and v.get("verdict") in VERDICTS}
    keys = ("file_path", "line", "category", "name", "value")
    return [{**{k: f.get(k) for k in keys}, "verdict": told.get(n, {}).get("verdict", "needs_context"), "reason": told.get(n, {}).get("reason", "no answer")} for n, f in enumerate(findings)]


def reviewer(backends: list[Backend], context: dict[tuple[str, int], str] | None = None) -> Callable[[str, list[dict]], list[dict]]:
    return lambda category, findings: read_verdicts(ask(backends, review_prompt(category, findings, context or {})), findings)


def synthesis_prompt(data: dict[str, Any], envelopes: dict[str, list[dict]] | None = None) -> str:
    """What an architect's summary is asked from: bounded parts of a report."""
    g = data["graph_analysis"]
    out = [f"Summarise the architecture and its risks. {json.dumps(data['metrics'])}"]
    for part, most in SHOWN.items():
        if g.get(part):
            out.append(f"{part} ({len(g[part])}): {json.dumps(g[part][:most], default=str)}")
    for layer, items in sorted((envelopes or {}).items()):
        out.append(f"{layer}: {json.dumps(items[:ENVELOPES_A_LAYER], default=str)}")
    return "\n\n".join(out)


def policy_proposer(backends: list[Backend]) -> Callable[[dict], dict]:
    """For tuning: a policy patch from the metrics; no answer is an empty patch."""
    return lambda metrics: read_object(ask(backends, f"Propose a JSON patch of the analysis policy that lowers noise. Metrics: {json.dumps(metrics)}")) or {}


def triage(findings: list[dict], judge: Callable[[str, list[dict]], list[dict]] | None = None) -> dict[str, list[dict]]:
    """Scanner findings as actionable, accepted_noise or needs_context."""
    names = {"true_positive": "actionable", "false_positive": "accepted_noise", "needs_context": "needs_context"}
    out: dict[str, list[dict]] = {v: [] for v in names.values()}
    for category in sorted({f["category"] for f in findings}):
        own = [f for f in findings if f["category"] == category]
        verdicts = judge(category, own) if judge else [{"verdict": "needs_context"}] * len(own)
        for f, v in zip(own, verdicts, strict=True):
            out[names[v["verdict"]]].append(f)
    return out
