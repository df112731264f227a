import json

import pytest
from codequarry.operators import findings as N
from codequarry.sources import scanners as E
from helpers import code_base, rows
from pyspark.sql import functions as F


def test_confidence(spark):
    df = spark.createDataFrame([("a", "high"), ("b", "low"), ("a", "odd")], "category string, confidence string")
    assert rows(N.by_confidence(df, "medium", {"a"}), "confidence") == [("high",)]
    assert N.by_confidence(df, "nonsense").count() == 3 and N.by_confidence(df, "low").count() == 2


def tool(spark, name, payload, root=None):
    return E.normalise(spark, name, payload if isinstance(payload, str) else json.dumps(payload), root)


def test_normalisers(spark):
    c = tool(spark, "composer-audit", {"advisories": {"a/b": [{"advisoryId": "PK-1", "title": "Bad", "severity": "Medium"}]}, "abandoned": {"c/d": None}})
    assert rows(c, "category", "rule_id", "severity", "message") == [("abandoned_dependency", "abandoned-package", "medium", "c/d: package is abandoned"), ("sca", "PK-1", "medium", "a/b: Bad")]
    n = tool(spark, "npm-audit", {"vulnerabilities": {"axios": {"severity": "high", "via": ["x", {"source": 1098, "title": "SSRF"}]}, "y": {"via": ["axios"]}}})
    assert rows(n, "rule_id", "severity", "message") == [("1098", "high", "axios: SSRF"), ("y", "medium", "y: y")]
    lines = [{"reason": "other"}, {"reason": "compiler-message", "message": {"message": "m", "level": "warning", "code": {"code": "clippy::x"}, "spans": [{"file_name": "src/b.rs", "line_start": 1, "is_primary": False}, {"file_name": "/p/src/main.rs", "line_start": 7, "is_primary": True}]}}]
    k = tool(spark, "cargo-clippy", "\n".join(map(json.dumps, lines)) + "\nnot json\n", "/p")
    assert rows(k, "domain", "rule_id", "file_path", "line", "severity") == [("quality", "clippy::x", "src/main.rs", 7, "medium")]
    deny = [{"type": "diagnostic", "fields": {"code": "vulnerability", "severity": "error", "message": "v", "advisory": {"id": "RS-1"}}}, {"type": "diagnostic", "fields": {"code": "rejected", "severity": "warning", "message": "l", "labels": [{"line": 3, "file": "x"}]}}, {"type": "diagnostic", "fields": {"code": "banned"}}]
    d = tool(spark, "cargo-deny", "\n".join(map(json.dumps, deny)))
    assert rows(d, "category", "domain", "rule_id", "severity") == [("license", "security", "rejected", "medium"), ("sca", "security", "RS-1", "high"), ("supply_chain_policy", "quality", "banned", "medium")]
    o = tool(spark, "osv-scanner", {"results": [{"packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [{"id": "G-1"}, {"id": ""}]}]}]})
    assert rows(o, "rule_id", "message") == [("G-1", "p 1 is affected by G-1"), ("osv", "p 1 is affected by osv")]
    for payload in ([{"name": "p", "version": "2", "vulns": [{"id": "V"}]}], {"dependencies": [{"name": "p", "version": "2", "vulns": [{"id": "V"}]}, {"name": "q"}]}):
        assert rows(tool(spark, "pip-audit", payload), "rule_id") == [("V",)]
    s = tool(spark, "phpstan", {"files": {"a.php": {"messages": [{"message": " m ", "line": None, "identifier": "i"}]}}})
    assert rows(s, "file_path", "line", "message") == [("a.php", 1, "m")]
    g = tool(spark, "gitleaks", [{"File": "/p/a", "StartLine": 4, "RuleID": "aws", "Fingerprint": "f"}], "/p")
    assert rows(g, "file_path", "line", "rule_id", "fingerprint", "category") == [("a", 4, "aws", "f", "secrets")]
    for name in E.NORMALISERS:
        assert tool(spark, name, "no json at all").count() == 0 and tool(spark, name, "{}").count() == 0


def test_fingerprint_is_json(spark):
    import hashlib

    values = {"name": 'q"\\é', "n": 3}
    want = hashlib.sha256(f"t:{json.dumps(values, sort_keys=True, ensure_ascii=False)}".encode()).hexdigest()
    df = spark.createDataFrame([(values["name"], 3)], "a string, n int")
    assert df.select(E.stable_fingerprint("t", name=E.quoted(F.col("a")), n=F.col("n").cast("string"))).first()[0] == want


def test_refined(spark):
    item = lambda code, path, msg="": {"code": code, "filename": path, "location": {"row": 1}, "message": msg}
    raw = tool(spark, "ruff", [item("S101", "tests/test_t.py"), item("S608", "app/x.py"), item("S608", "app/x.py"), item("S105", "a.py", 'Possible password "token_url"')])
    kept = E.refined(raw)
    assert rows(kept, "rule_id", "severity") == [("S105", "low"), ("S608", "high")]
    assert rows(E.counts(raw, kept), "raw_finding_count", "finding_count", "filtered_count") == [(4, 2, 2)]


def test_tool_runs(spark, tmp_path):
    assert E.run_status("npm-audit", 1, 0)[0] == "failed" and E.run_status("x", 0, 0) == ("passed", None) and E.run_status("x", 1, 2)[0] == "findings"
    assert E.clean_stderr("composer-audit", "Deprecation Notice: a\nDeprecation Notice: b\nreal\n") == ("real", 2)
    assert E.select_tools(["ruff, ruff", "all"])[0] == "ruff" and len(E.select_tools(["all"])) == 9
    assert E.run_tool(spark, "npm-audit", str(tmp_path), str(tmp_path / "raw"))[0]["status"] == "unavailable"


def lookup(spark, tree, found, rules, **kw):
    files, _, deps = code_base(spark, tree)
    findings = spark.createDataFrame(found, "category string, file_path string, name string, context string")
    r = spark.createDataFrame([(i, c, [{"type": t, "params": p} for t, p in checks], s, n) for n, (i, c, checks, s) in enumerate(rules)], f"id string, category string, checks {N.CHECK}, status string, position int")
    kept, hits = N.apply_rules(findings, r, files=files, dependencies=deps, **kw)
    return rows(kept, "name"), rows(hits, "id", "findings")


def test_rules(spark):
    tree = {"app/P.php": "<?php\nclass P extends \\Lib\\ServiceProvider implements Boots {}\n", "app/Q.php": "<?php\nclass Q {}\n", "app/R.php": "<?php\nuse App\\Q;\n#[Mark(1)]\nclass R {}\n"}
    found = [("abandoned_class", "app/P.php", "P", ""), ("abandoned_class", "app/Q.php", "App\\Q", ""), ("unused_import", "app/R.php", "App\\Mark", ""), ("unused_import", "app/R.php", "App\\Gone", "ctx"), ("magic_string", "x/y.php", "V", "")]
    seeds = [(i, c, checks, "active") for i, c, checks, _ in N.SEED_RULES]
    kept, hits = lookup(spark, tree, found, seeds)
    assert kept == [("App\\Gone",), ("V",)] and hits == [("seed-attr-import", 1), ("seed-di-typehint", 1), ("seed-sp-inherit", 1)]
    rules = [("off", "magic_string", [], "disabled"), ("all", "magic_string", [], "active"), ("and", "unused_import", [("context_contains", {"substring": "ctx"}), ("name_contains", {"substring": "nope"})], "active"), ("bad", "unused_import", [("source_regex", {"pattern": "("})], "active"), ("i", "abandoned_class", [("implements", {"interface": "Boots"})], "active"), ("l", "abandoned_class", [("file_in_layer", {"layer": "APP"})], "active"), ("u", "unused_import", [("what", {"a": "b"})], "active")]
    kept, hits = lookup(spark, tree, found, rules)
    assert kept == [("App\\Gone",), ("App\\Mark",)] and hits == [("all", 1), ("i", 1), ("l", 1)]


@pytest.mark.parametrize("before,hit,after", [
    (("probationary", 0, 3), True, ("probationary", 1, 0)), (("probationary", 1, 3), True, ("active", 2, 0)), (("stale", 5, 6), True, ("active", 6, 0)), (("active", 5, 4), False, ("stale", 5, 5)), (("active", 5, 7), False, ("disabled", 5, 8)),
    (("stale", 5, 7), False, ("disabled", 5, 8)), (("probationary", 0, 20), False, ("probationary", 0, 21)), (("disabled", 1, 9), True, ("disabled", 1, 9)), (("active", 1, 0), False, ("active", 1, 1)),
])
def test_lifecycle(spark, before, hit, after):
    r = spark.createDataFrame([("r", *before, "")], "id string, status string, hit_count int, miss_streak int, last_hit_run string")
    got = N.lifecycle(r, spark.createDataFrame([("r",)] if hit else [], "id string"), "run").first()
    assert (got.status, got.hit_count, got.miss_streak) == after and got.last_hit_run == ("run" if hit and before[0] != "disabled" else "")


def test_sample_and_context(spark):
    f = spark.createDataFrame([("c", f"d{i % 3}/f{i:02d}", i) for i in range(30)] + [("e", "x/y", 1)], "category string, file_path string, line int")
    s = N.stratified_sample(f, 6).collect()
    assert len(s) == 7 and sorted(r.file_path.split("/")[0] for r in s if r.category == "c") == ["d0", "d0", "d1", "d1", "d2", "d2"]
    lines = spark.createDataFrame([("d0/f03", n, f"l{n}") for n in range(1, 20)], "path string, no int, text string")
    assert rows(N.context_lines(f.filter("line = 3"), lines), "no") == [(n,) for n in range(1, 9)]


def test_verdicts_and_tuning(spark):
    v = spark.createDataFrame([("false_positive", "c", "a.py", "N"), ("true_positive", "c", "b.py", ""), ("false_positive", "c", "a.py", "N")], "verdict string, category string, file_path string, name string").withColumn("value", F.lit(None).cast("string")).withColumn("reason", F.lit("r"))
    assert tuple(N.verdict_tally(v).first()) == (3, 1, 2, 0)
    new = N.rules_from_verdicts(v)
    assert new.count() == 1 and new.first().status == "probationary"
    assert N.append_rules(new, new).count() == 1
    m = lambda *x: spark.createDataFrame([x], "cycles int, violations int, dead_code int, hardwiring int, orphans int, god_classes int")
    assert N.pareto(m(1, 1, 1, 1, 1, 1), m(1, 1, 1, 0, 1, 1)).first().accepted and not N.pareto(m(1, 1, 1, 1, 1, 1), m(0, 1, 1, 2, 1, 1)).first().accepted and not N.pareto(m(1, 1, 1, 1, 1, 1), m(1, 1, 1, 1, 1, 1)).first().accepted
    h = spark.createDataFrame([("hardcoded_ip_url", "high", "b", 1, "u"), ("env_outside_config", "medium", "a", 1, "e"), ("magic_string", "high", "a", 1, "m")], "category string, severity string, file_path string, line int, value string")
    assert [r.value for r in N.security_top(h).collect()] == ["u", "e"] and tuple(N.security_summary(h).first()) == (2, 1, 1, 1)
