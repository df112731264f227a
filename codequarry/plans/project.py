"""The whole analysis of a code base: index, graph, detectors, rules, review, scanners, report; and the tuning of its policy."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import plugins as P
from codequarry.functions import text as T
from codequarry.operators import contracts as C
from codequarry.operators import deadcode as D
from codequarry.operators import findings as N
from codequarry.operators import graph as G
from codequarry.operators import hardwiring as H
from codequarry.operators import resolve as R
from codequarry.plans import report as W
from codequarry.policy import Policy, load_patch, merge, resolve_policy
from codequarry.session import checkpoint
from codequarry.sources import scanners as E
from codequarry.sources import store as S

#: Findings of either detector in one table; columns a detector lacks are null.
FINDINGS = ["file_path", "line", "category", "name", "value", "context", "detail", "severity", "confidence", "suggestion"]
#: Given a category and sampled findings, verdicts as records (file_path, line, category, name, value, verdict, reason).
Reviewer = Callable[[str, list[dict]], list[dict]]
Summariser = Callable[[str, str, str], dict]


@dataclass
class Project:
    """A tree of sources, and the folder with its index, rules and reports (by default `.codequarry` in the tree)."""

    spark: SparkSession
    root: str
    output: str = ""
    profiles: list[str] = field(default_factory=list)
    plugin_refs: list[str] = field(default_factory=list)
    policy_files: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = str(Path(self.root).resolve())
        self.output = str(Path(self.output).resolve()) if self.output else f"{self.root}/.codequarry"
        self.store = S.Index(self.spark, f"file://{self.output}/index")
        self.plugins = P.load(self.plugin_refs)

    def tree(self) -> DataFrame:
        return S.scan_tree(self.spark, self.root, output_dir=self.output)

    def index(self, reset: bool = False) -> dict[str, int]:
        if reset:
            self.store.reset()
        return self.store.update(S.files_of(self.tree()))

    def policy(self, extra: list[dict] = ()) -> Policy:
        paths = _paths(self.root)
        own = Path(self.output) / "policy.json"
        files = [load_patch(str(own))] if own.exists() else []
        files += [load_patch(f) for f in self.policy_files]
        first = resolve_policy(paths, self.profiles)
        return resolve_policy(paths, self.profiles, [*P.policy_patches(self.plugins, self.root, first.plugins_applied), *files, *extra])

    def graph(self, policy: Policy) -> dict[str, DataFrame]:
        files, symbols, deps, envelopes = (self.store.read(t) for t in ("files", "symbols", "dependencies", "envelopes"))
        resolved = R.resolve(files, symbols, deps, policy.graph.js_import_aliases, policy.graph.js_fuzzy_import_resolution)
        edges = checkpoint(G.fold_edges(resolved))
        paths = files.select("file_id", "path", "language", "size")
        loaders = deps.filter("type = 'load'").select(F.col("source_file_id").alias("file_id")).distinct().join(paths, "file_id").select("path")
        layers = envelopes.join(paths, "file_id").select("path", F.col("architectural_layer").alias("layer"))
        strong = G.strong_edges(edges)
        entries = checkpoint(G.without_importers(paths, edges, loaders, policy.graph.orphan_entry_patterns))
        out = {
            "nodes": G.nodes(paths, symbols), "edges": edges, "circular_dependencies": G.cycles(edges, components=G.strong_components(edges)), "strong_circular_dependencies": G.cycles(strong, components=G.strong_components(strong)),
            "coupling_metrics": G.coupling(paths, edges), "god_classes": G.god_classes(files, symbols, deps), "bottleneck_files": G.betweenness(paths, edges),
            "layer_violations": G.layer_violations(edges, layers, policy.graph.layer_patterns, policy.graph.layer_violation_excludes).orderBy("source_file", "target_name"),
            "orphan_files": entries.filter("not entry").select("path").orderBy("path"), "runtime_entry_candidates": entries.filter("entry").select("path").orderBy("path"), "density": G.density(paths, edges),
        }
        return P.refine(self.all_plugins(policy), "refine_graph_result", out, policy=policy)

    def all_plugins(self, policy: Policy) -> list[P.Plugin]:
        return [*P.built_in(policy.plugins_applied), *self.plugins]

    def findings(self, policy: Policy) -> tuple[DataFrame, DataFrame]:
        """(dead code, hardwiring), after the plugins."""
        files, symbols, deps = (self.store.read(t) for t in ("files", "symbols", "dependencies"))
        plugins = self.all_plugins(policy)
        dead = P.refine(plugins, "refine_dead_code_result", D.dead_code(files, symbols, deps, policy.dead_code), policy=policy)
        contracts = P.refine_contracts(plugins, C.lookup(C.scan(files)), policy=policy)
        hard = P.refine(plugins, "refine_hardwiring_findings", H.hardwiring(files, symbols, contracts, policy.hardwiring), policy=policy, contracts=contracts)
        return dead, P.refine(plugins, "refine_hardwiring_result", hard, policy=policy)

    def ranked(self, policy: Policy) -> DataFrame:
        """All findings in one table, computed once."""
        dead, hard = self.findings(policy)
        return checkpoint(dead.unionByName(hard, allowMissingColumns=True).select(*FINDINGS))

    # -- rules

    def rules(self) -> DataFrame:
        path = Path(self.output) / "rules.json"
        if not path.exists():
            save_rules(path, [{"id": i, "category": c, "checks": [{"type": t, "params": p} for t, p in checks], "reason": r, "created_by": "seed"} for i, c, checks, r in N.SEED_RULES])
        rows = load_rules(path)
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in _RULE_COLUMNS) + (n,) for n, r in enumerate(rows)], N.RULE + ", position int")

    def excluded(self, findings: DataFrame, run_id: str = "") -> tuple[DataFrame, int]:
        """Findings that no rule excludes, and how many are; with a run_id the rules age."""
        rules, before = self.rules(), findings.count()
        layers = self.store.read("envelopes").select("file_id", F.col("architectural_layer").alias("layer"))
        kept, hits = N.apply_rules(findings, rules, files=self.store.read("files"), dependencies=self.store.read("dependencies"), layers=layers)
        kept = checkpoint(kept)
        if run_id:
            aged = N.lifecycle(rules, hits, run_id).orderBy("position").drop("position").collect()
            save_rules(Path(self.output) / "rules.json", [r.asDict(True) for r in aged])
        return kept, before - kept.count()

    # -- model-backed steps, each with a stub

    def review(self, findings: DataFrame, policy: Policy, reviewer: Reviewer | None) -> dict[str, Any]:
        """A sample of each category to the reviewer; without one everything needs context. False positives become rules on probation."""
        sample = N.stratified_sample(findings, policy.review.sample_per_category).orderBy("category", "file_path", "line").collect()
        verdicts: list[dict] = []
        for category in sorted({r.category for r in sample}):
            own = [r.asDict() for r in sample if r.category == category]
            verdicts += reviewer(category, own) if reviewer else [{**{k: f[k] for k in ("file_path", "line", "category", "name", "value")}, "verdict": "needs_context", "reason": "no reviewer"} for f in own]
        schema = "file_path string, line int, category string, name string, value string, verdict string, reason string"
        rows = self.spark.createDataFrame([tuple(v.get(c.split()[0]) for c in schema.split(", ")) for v in verdicts], schema)
        tally = N.verdict_tally(rows).first().asDict()
        new = [r.asDict(True) for r in N.rules_from_verdicts(rows).collect()]
        if new:
            old = load_rules(Path(self.output) / "rules.json")
            seen = {(r["category"], json.dumps(r["checks"], sort_keys=True)) for r in old}
            add = [r for r in new if r["id"] not in {o["id"] for o in old} and (r["category"], json.dumps(r["checks"], sort_keys=True)) not in seen]
            save_rules(Path(self.output) / "rules.json", old + add)
        return {**tally, "verdicts": verdicts, "rules_generated": len(new)}

    def envelopes(self, summarise: Summariser | None = None) -> int:
        """A summary and layer for files that have none. The stub tells the layer by path. At most 15,000 characters go to the model."""
        files, known = self.store.read("files"), self.store.read("envelopes")
        todo = files.join(known.select("file_id"), "file_id", "left_anti")
        if summarise is None:
            none = F.array().cast("array<string>")
            new = todo.select("file_id", F.concat(F.col("language"), F.lit(" file "), "path").alias("summary"), T.layer_of(F.col("path")).alias("architectural_layer"), *(none.alias(c) for c in ("decision_points", "state_mutations", "side_effects", "business_rules")))
        else:
            rows = [(r.file_id, summarise(r.path, r.language, r.head)) for r in todo.select("file_id", "path", "language", F.left("content", F.lit(15_000)).alias("head")).toLocalIterator()]
            new = self.spark.createDataFrame([(i, e.get("summary", ""), e.get("architectural_layer", "unknown"), *(list(e.get(c, [])) for c in ("decision_points", "state_mutations", "side_effects", "business_rules"))) for i, e in rows], S.ENVELOPES)
        new = checkpoint(new)
        self.store.write("envelopes", S.upsert(known, new, "file_id"))
        return new.count()

    # -- commands

    def analyze(self, reset: bool = False, tools: list[str] = (), min_confidence: str | None = None, categories: set[str] | None = None, reviewer: Reviewer | None = None, skip_review: bool = True, summarise: Summariser | None = None, with_envelopes: bool = False, reindex: bool = True) -> dict[str, Any]:
        """Index the tree and report; with reindex=False, report on the index as it is, without ageing rules."""
        run_id = datetime.now().strftime("%Y%m%d_%H%M%S")
        if reindex:
            self.index(reset)
        elif not self.store.exists("files"):
            raise FileNotFoundError(f"no index in {self.output}")
        policy = self.policy()
        graph = self.graph(policy)
        found = self.ranked(policy)
        kept, excluded = self.excluded(found, run_id if reindex else "")
        shown = checkpoint(N.mark_informational(N.by_confidence(kept, min_confidence, categories), policy.hardwiring.informational_path_patterns, policy.hardwiring.informational_values))
        review = None if skip_review else self.review(shown, policy, reviewer)
        if with_envelopes:
            self.envelopes(summarise)
        runs, external = [], None
        for tool in E.select_tools(list(tools)):
            run, rows = E.run_tool(self.spark, tool, self.root, f"{self.output}/reports/raw/{run_id}")
            if rows is not None:
                rows, n = self.filter_external(rows)
                run["summary"] |= {"finding_count": rows.count(), "rules_filtered_count": n}
                external = rows if external is None else external.unionByName(rows)
            runs.append(run)
        inventory = C.inventory(C.scan(self.store.read("files")))
        data = W.collect(self, policy, graph, shown, excluded, review, inventory, runs, external)
        data["extensions"] = P.report_sections(self.all_plugins(policy), data)
        data["artifacts"] = W.write(data, self.output, run_id)
        self.store.append_metrics(run_id, {k: json.dumps(v) for k, v in data["metrics"].items()})
        return data

    def filter_external(self, rows: DataFrame) -> tuple[DataFrame, int]:
        before = rows.count()
        kept, _ = N.apply_rules(rows.withColumn("context", F.col("message")).withColumn("name", F.col("rule_id")), self.rules())
        kept = checkpoint(kept.select(*E.FINDING))
        return kept, before - kept.count()

    def metrics(self, extra: list[dict] = ()) -> DataFrame:
        """One row, what the tuning compares."""
        policy = self.policy(list(extra))
        g = self.graph(policy)
        kept, _ = self.excluded(self.ranked(policy))
        n = lambda df: df.count()
        dead = kept.filter("category in ('unused_import', 'unused_method', 'unused_property', 'abandoned_class')").count()
        row = {"cycles": n(g["strong_circular_dependencies"]) or n(g["circular_dependencies"]), "violations": n(g["layer_violations"]), "dead_code": dead, "hardwiring": n(kept) - dead, "orphans": n(g["orphan_files"]), "god_classes": n(g["god_classes"])}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))

    def tune(self, propose: Callable[[dict], dict], rounds: int = 5) -> dict[str, Any]:
        """Up to five rounds: a proposed patch stays if no metric grows, one falls and the score doesn't grow; the first that fails ends it."""
        state: dict[str, Any] = {}
        history = []
        for _ in range(min(rounds, 5)):
            before = self.metrics([state])
            patch = propose(before.first().asDict())
            candidate = merge(state, patch)
            after = self.metrics([candidate])
            accepted = N.pareto(before, after).first().accepted
            history.append({"before": before.first().asDict(), "after": after.first().asDict(), "accepted": accepted})
            if not accepted:
                break
            state = candidate
        Path(self.output).mkdir(parents=True, exist_ok=True)
        (Path(self.output) / "policy.optimized.json").write_text(json.dumps(state, indent=2), encoding="utf-8")
        return {"patch": state, "rounds": history}


def _paths(root: str) -> list[str]:
    """Relative paths of the tree's files, for telling frameworks by; excluded directories are left out."""
    out = []
    for folder, inner, names in os.walk(root):
        inner[:] = [d for d in inner if not d.startswith(".") and d not in S.EXCLUDED]
        out += [os.path.relpath(os.path.join(folder, n), root) for n in names]
    return out


_RULE_COLUMNS = [c for c in N.RULE.replace(N.CHECK, "checks_type").split(", ")]
_RULE_DEFAULTS = {"id": "", "category": "", "checks": [], "reason": "", "created_by": "human", "created_at": "", "status": "active", "hit_count": 0, "last_hit_run": "", "miss_streak": 0}


def migrate(pattern: str | dict) -> list[dict]:
    """Checks of an old rule's pattern: a glob, or what context and name must hold."""
    if isinstance(pattern, str):
        return [{"type": "file_glob", "params": {"pattern": pattern}}]
    checks = [{"type": k, "params": {"substring": pattern[k]}} for k in ("context_contains", "name_contains") if k in pattern]
    return checks or [{"type": "file_glob", "params": {"pattern": "*"}}]


def load_rules(path: Path) -> list[dict]:
    """Rules of a file, in the present form whatever its version; a missing or broken file has none."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return []
    rows = data.get("rules", []) if isinstance(data, dict) else data
    return [_RULE_DEFAULTS | {k: v for k, v in r.items() if k in _RULE_DEFAULTS and v is not None} | ({"checks": migrate(r["pattern"])} if not r.get("checks") and r.get("pattern") is not None else {}) for r in rows if isinstance(r, dict)]


def save_rules(path: Path, rules: list[dict]) -> None:
    """Write beside and rename, so that the file is whole at any time."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, suffix=".tmp", delete=False, encoding="utf-8") as f:
        json.dump({"version": 2, "rules": [_RULE_DEFAULTS | r for r in rules]}, f, indent=2, ensure_ascii=False)
    os.replace(f.name, path)
