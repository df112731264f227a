"""Findings as rows: filters, deduplication, rules with a life cycle, samples for review, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T

CONFIDENCE = {"low": 0, "medium": 1, "high": 2}
SEVERITY = {"high": 0, "medium": 1, "low": 2}
CHECK = "array<struct<type: string, params: map<string, string>>>"
RULE = f"id string, category string, checks {CHECK}, reason string, created_by string, created_at string, status string, hit_count int, last_hit_run string, miss_streak int"
PROMOTE_AT, STALE_AT, DISABLE_AT = 2, 5, 8


def rank(value: Column, ranks: dict[str, int], other: int) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[value], F.lit(other))


def by_confidence(findings: DataFrame, least: str | None = None, categories: set[str] | None = None) -> DataFrame:
    """At least this confidence, and in one of the categories; an unknown or missing threshold, and no categories, keep all."""
    out = findings.filter(F.col("category").isin(*sorted(categories))) if categories else findings
    threshold = CONFIDENCE.get((least or "").strip().lower())
    return out if threshold is None else out.filter(rank(F.col("confidence"), CONFIDENCE, -1) >= threshold)


def of_domain(findings: DataFrame, domain: str = "security") -> DataFrame:
    return findings.filter(F.col("domain") == domain)


# rules

SEED_RULES = [
    ("seed-sp-inherit", "abandoned_class", [("inherits", {"ancestor": "ServiceProvider"})], "Service providers are discovered at run time"),
    ("seed-attr-import", "unused_import", [("source_regex", {"pattern": r"#\[{name}[\s(]"})], "Attributes use their imports by name"),
    ("seed-di-typehint", "abandoned_class", [("referenced_as_type_hint", {})], "The container injects classes named in constructors"),
]


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern.replace("{name}", "x"))
    except re.error:
        return False
    return True


def check_columns(checks: list[tuple[str, dict[str, str]]]) -> Column:
    """All checks as one condition on prepared findings (see prepare); an unknown check never holds, no checks always do."""
    out = F.lit(True)
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("value"), F.lit(""))
    context = F.coalesce(F.nullif("context", F.lit("")), F.col("detail"), F.lit(""))
    for kind, p in checks:
        value = next(iter(p.values()), "") if kind != "referenced_as_type_hint" else "-"
        if not value:
            return F.lit(False)
        if kind == "file_glob":
            test = F.col("file_path").rlike(T.glob_regex(p["pattern"]))
        elif kind in ("name_contains", "context_contains"):
            test = F.contains(name if kind == "name_contains" else context, F.lit(p["substring"]))
        elif kind == "source_regex":
            head, *rest = p["pattern"].split("{name}")
            quoted = F.concat(F.lit("\\Q"), T.last_segment(name), F.lit("\\E"))
            pattern = F.concat(F.lit(head), *(x for r in rest for x in (quoted, F.lit(r))))
            test = F.coalesce(F.col("content").rlike(p["pattern"]) if not rest else F.regexp_like("content", pattern), F.lit(False)) if _valid(p["pattern"]) else F.lit(False)
        elif kind in ("inherits", "implements"):
            test = F.coalesce(F.array_contains("inherited" if kind == "inherits" else "implemented", value), F.lit(False))
        elif kind == "referenced_as_type_hint":
            test = F.coalesce("hinted", F.lit(False))
        elif kind == "file_in_layer":
            test = F.coalesce(F.lower("layer") == value.lower(), F.lit(False)) | F.contains(F.lower("file_path"), F.lit(value.lower()))
        else:
            return F.lit(False)
        out = out & test
    return out


_OPTIONAL = {"name": "string", "value": "string", "context": "string", "detail": "string", "content": "string", "inherited": "array<string>", "implemented": "array<string>", "hinted": "boolean", "layer": "string"}


def prepare(findings: DataFrame, files: DataFrame | None = None, dependencies: DataFrame | None = None, layers: DataFrame | None = None, contents: bool = False) -> DataFrame:
    """Findings with what structural checks look at: their file's text, ancestors and interfaces, type hints elsewhere, layer."""
    out = findings
    for c, kind in _OPTIONAL.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    if files is None:
        return out
    home = files.select(F.col("path").alias("file_path"), "file_id", *(["content"] if contents else []))
    out = (out.drop("content") if contents else out).join(home, "file_path", "left")
    if dependencies is not None:
        from codequarry.operators.deadcode import suffix_referenced

        near = dependencies.filter("type in ('inherit', 'implement')").groupBy(F.col("source_file_id").alias("file_id")).agg(
            *(F.flatten(F.collect_set(F.when(F.col("type") == t, F.array("target_name", T.last_segment(F.col("target_name")))))).alias(c) for t, c in (("inherit", "inherited"), ("implement", "implemented")))
        )
        out = out.drop("inherited", "implemented", "hinted").join(near, "file_id", "left").withColumn("_short", T.last_segment(F.coalesce("name", F.lit(""))))
        wanted = out.filter("_short <> '' and file_id is not null").select(F.col("_short").alias("name"), "file_id").distinct()
        hinted = suffix_referenced(wanted, dependencies.filter("type = 'import'")).select(F.col("name").alias("_short"), "file_id", F.lit(True).alias("hinted"))
        out = out.join(hinted, ["_short", "file_id"], "left").drop("_short")
    if layers is not None:
        out = out.drop("layer").join(layers.select("file_id", "layer"), "file_id", "left")
    return out.drop("file_id")


def attribute(findings: DataFrame, rules: list[tuple[str, str, list[tuple[str, dict[str, str]]]]]) -> DataFrame:
    """Prepared findings with `rule_id`: the first rule (id, category, checks) of their category that holds, or null.

    One projection, whatever the number of rules: each finding is looked at once, conditions of other categories aren't evaluated.
    """
    by_category: dict[str, list] = {}
    for rule in rules:
        by_category.setdefault(rule[1], []).append(rule)
    chosen = None
    for category, own in by_category.items():
        first = F.coalesce(*(F.when(check_columns(checks), F.lit(rid)) for rid, _, checks in own))
        chosen = F.when(F.col("category") == category, first) if chosen is None else chosen.when(F.col("category") == category, first)
    return findings.withColumn("rule_id", (chosen if chosen is not None else F.lit(None)).cast("string"))


def apply_rules(findings: DataFrame, rules: DataFrame, **structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that no rule excludes, hits (id, findings)). Disabled rules are passed over; rules come in the order of `position`."""
    given = [(r.id, r.category, [(c["type"], dict(c["params"] or {})) for c in r.checks or []]) for r in rules.filter("status <> 'disabled'").orderBy(*[c for c in ("position", "id") if c in rules.columns]).toLocalIterator()]
    contents = any(c[0] == "source_regex" for _, _, checks in given for c in checks)
    told = attribute(prepare(findings, contents=contents, **structure), given)
    kept = told.filter("rule_id is null").select(*findings.columns)
    return kept, told.filter("rule_id is not null").groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("findings"))


def lifecycle(rules: DataFrame, hits: DataFrame, run_id: Column | str) -> DataFrame:
    """Rules after a run. hits (id). Two hits promote a rule on probation, a hit revives a stale one, five misses in a row make an active one stale, eight disable it; probation never ends by misses, disabled is for good."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    r = rules.join(hits.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    live = F.col("status") != "disabled"
    n, misses = F.col("hit_count") + F.when(live & hit, 1).otherwise(0), F.when(~live, F.col("miss_streak")).when(hit, 0).otherwise(F.col("miss_streak") + 1)
    status = (
        F.when(~live, F.col("status"))
        .when(hit & ((F.col("status") == "stale") | (F.col("status") == "probationary") & (n >= PROMOTE_AT)), "active")
        .when(~hit & (misses >= DISABLE_AT) & F.col("status").isin("active", "stale"), "disabled")
        .when(~hit & (misses >= STALE_AT) & (F.col("status") == "active"), "stale")
        .otherwise(F.col("status"))
    )
    changed = {"status": status, "hit_count": n.cast("int"), "last_hit_run": F.when(live & hit, run).otherwise(F.col("last_hit_run")), "miss_streak": misses.cast("int")}
    return r.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in rules.columns))


def append_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules and those of `new` that neither share an id nor category and checks with one already there."""
    key = lambda df: df.withColumn("_key", F.concat_ws("\n", "category", F.to_json("checks")))
    old, add = key(rules), key(new).dropDuplicates(["id"]).dropDuplicates(["_key"])
    add = add.join(old.select("id"), "id", "left_anti").join(old.select("_key"), "_key", "left_anti")
    return rules.unionByName(add.drop("_key"), allowMissingColumns=True)


# review


def stratified_sample(findings: DataFrame, per_category: int = 20, directory: Column | None = None, order: list[str] = ("file_path", "line"), seed: int = 42) -> DataFrame:
    """Up to per_category findings of each category, taken in turn from its directories, which come in a seeded order."""
    place = directory if directory is not None else T.parent(F.col("file_path"))
    w = Window.partitionBy("category", "_dir").orderBy(*order)
    turns = findings.withColumn("_dir", place).withColumn("_turn", F.row_number().over(w))
    pick = Window.partitionBy("category").orderBy("_turn", F.md5(F.concat(F.col("_dir"), F.lit(f":{seed}"))), *order)
    return turns.withColumn("_pick", F.row_number().over(pick)).filter(F.col("_pick") <= per_category).drop("_dir", "_turn", "_pick")


def context_lines(findings: DataFrame, lines: DataFrame, around: int = 5) -> DataFrame:
    """Findings (file_path, line, ...) with the lines (path, no, text) up to `around` from theirs, by an equi-join on blocks of lines."""
    width = 2 * around + 1
    f = findings.withColumn("_block", F.explode(F.sequence(F.floor((F.col("line") - around) / width), F.floor((F.col("line") + around) / width))))
    near = f.join(lines.withColumn("_block", F.floor(F.col("no") / width)).withColumnRenamed("path", "file_path"), ["file_path", "_block"]).filter(F.abs(F.col("no") - F.col("line")) <= around)
    return near.drop("_block")


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    """One row: how many verdicts there are of each kind."""
    kinds = ("true_positive", "false_positive", "needs_context")
    return verdicts.agg(F.count("*").alias("total"), *(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))


def rules_from_verdicts(verdicts: DataFrame) -> DataFrame:
    """A rule on probation for each false positive: this file, and this name where there is one."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("value"), F.lit(""))
    none = F.array().cast(CHECK)
    checks = F.concat(F.array(F.struct(F.lit("file_glob").alias("type"), F.create_map(F.lit("pattern"), F.col("file_path")).alias("params"))), F.when(name != "", F.array(F.struct(F.lit("name_contains").alias("type"), F.create_map(F.lit("substring"), name).alias("params")))).otherwise(none))
    wrong = verdicts.filter("verdict = 'false_positive'")
    return wrong.select(F.concat(F.lit("rule-"), F.left(F.md5(F.concat_ws(":", "category", "file_path", name)), F.lit(8))).alias("id"), "category", checks.alias("checks"), "reason", F.lit("ai").alias("created_by"), F.lit("").alias("created_at"), F.lit("probationary").alias("status"), F.lit(0).alias("hit_count"), F.lit("").alias("last_hit_run"), F.lit(0).alias("miss_streak")).dropDuplicates(["id"])


# summaries

SCORE = {"cycles": 40.0, "violations": 12.0, "dead_code": 3.0, "hardwiring": 1.0, "orphans": 2.0, "god_classes": 5.0}


def score(metrics: dict[str, float] = SCORE) -> Column:
    """Weighted sum of the metric columns; less is better."""
    return sum((F.col(k) * w for k, w in metrics.items()), F.lit(0.0))


def pareto(before: DataFrame, after: DataFrame, metrics: list[str] = list(SCORE)) -> DataFrame:
    """One row: whether `after` is accepted. No metric grows, at least one falls, and the score doesn't grow."""
    b = before.select(*(F.col(m).alias(f"b_{m}") for m in metrics), score({m: SCORE[m] for m in metrics}).alias("b_score"))
    a = after.select(*(F.col(m).alias(f"a_{m}") for m in metrics), score({m: SCORE[m] for m in metrics}).alias("a_score"))
    worse, better = F.lit(False), F.lit(False)
    for m in metrics:
        worse, better = worse | (F.col(f"a_{m}") > F.col(f"b_{m}")), better | (F.col(f"a_{m}") < F.col(f"b_{m}"))
    return b.crossJoin(a).select((~worse & better & (F.col("a_score") <= F.col("b_score"))).alias("accepted"), "b_score", "a_score")


def security_top(hardwiring: DataFrame, most: int = 10) -> DataFrame:
    """The gravest network and environment findings: by severity, then place."""
    s = hardwiring.filter("category in ('hardcoded_ip_url', 'env_outside_config')")
    return s.orderBy(rank(F.col("severity"), SEVERITY, 3), "file_path", "line", "value").limit(most)


def security_summary(hardwiring: DataFrame) -> DataFrame:
    is_ = lambda c: F.count_if(F.col("category") == c)
    s = hardwiring.filter("category in ('hardcoded_ip_url', 'env_outside_config')")
    return s.agg(F.count("*").alias("total"), is_("hardcoded_ip_url").alias("hardcoded_network"), is_("env_outside_config").alias("env_outside_config"), F.count_if(F.col("severity") == "high").alias("high"))


def feedback_loop(detected: int, excluded: int, verdicts: dict[str, int], new_rules: int) -> dict[str, float]:
    """How much the rules and the review of a run took off the findings."""
    reviewed = sum(verdicts.values())
    return {"detected_total": detected, "rules_prefiltered": excluded, "ai_reviewed": reviewed, **verdicts, "rules_generated": new_rules, "accepted_by_policy": detected - excluded, "actionable_visible": detected - excluded - verdicts.get("false_positive", 0)}


def mark_informational(findings: DataFrame, patterns: list[str], values: list[str]) -> DataFrame:
    return findings.withColumn("informational", T.matches_glob(F.col("file_path"), patterns) | (F.col("value").isin(*values) if values else F.lit(False)))
