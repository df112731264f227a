"""Plugins: modules whose hooks add policy, contracts and report sections, or refine results.

A hook takes keywords and may return None for no change. One that fails is passed over. Results are DataFrames, so what a hook builds
is checked for its columns at once, and runs with the analysis.
"""

from __future__ import annotations

import importlib
import importlib.util
import logging
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import contracts as C

log = logging.getLogger(__name__)


@dataclass
class Plugin:
    ref: str
    name: str
    module: Any

    def call(self, hook: str, **values: Any) -> Any:
        """What the hook returns, None if there is none or it fails."""
        f = getattr(getattr(self.module, "PLUGIN", None), hook, None) or getattr(self.module, hook, None)
        if not callable(f):
            return None
        try:
            out = f(**values)
            if isinstance(out, DataFrame):
                _ = out.schema
            return out
        except Exception as e:  # a plugin is not ours: its faults are told and passed over
            log.warning("plugin %s: %s failed: %s", self.ref, hook, e)
            return None


def load(refs: Iterable[str]) -> list[Plugin]:
    """Plugins by module name or path; what can't be imported is passed over."""
    out = []
    for ref in refs:
        try:
            if Path(ref).exists():
                spec = importlib.util.spec_from_file_location(f"plugin_{Path(ref).stem}", ref)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
            else:
                module = importlib.import_module(ref)
        except Exception as e:
            log.warning("plugin %s can't be loaded: %s", ref, e)
            continue
        out.append(Plugin(ref, str(getattr(getattr(module, "PLUGIN", None), "name", None) or getattr(module, "PLUGIN_NAME", None) or ref), module))
    return out


def policy_patches(plugins: list[Plugin], project: str, selected: list[str]) -> list[dict]:
    out = []
    for p in plugins:
        patch = p.call("build_policy_patch", project_path=project, selected_plugins=list(selected))
        if isinstance(patch, dict) and patch:
            out.append(patch | {"plugins_applied": [f"module:{p.ref}"]})
    return out


def refine(plugins: list[Plugin], hook: str, result: Any, **values: Any) -> Any:
    """A result passed through a hook of all plugins, in order."""
    for p in plugins:
        new = p.call(hook, result=result, **values)
        result = result if new is None else new
    return result


def refine_contracts(plugins: list[Plugin], lookup: DataFrame, **values: Any) -> DataFrame:
    """Contracts with those that plugins add: a DataFrame (category, value) or {category: values}."""
    for p in plugins:
        lookup = C.merge_lookup(lookup, p.call("refine_contract_lookup", contract_lookup=lookup, **values))
    return lookup


def report_sections(plugins: list[Plugin], report: dict) -> dict:
    out = {}
    for p in plugins:
        section = p.call("build_report_extensions", report=report)
        if isinstance(section, dict) and section:
            out[p.name] = section
    return out


def _any(column: str, words: Iterable[str]):
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.col(column), F.lit(w))
    return out


class Django:
    """Environment reads of the framework's own machinery, and links in documentation, are no findings."""

    name = "django-runtime"
    places = ("django/core/checks/", "django/core/management/", "django/db/backends/base/creation.py", "django/utils/autoreload.py")
    names = ("DJANGO_", "PATH", "PATHEXT", "PYTHONSTARTUP", "RUNNING_DJANGOS_TEST_SUITE")

    def refine_hardwiring_findings(self, result: DataFrame, **_: Any) -> DataFrame:
        r = result.withColumn("_p", T.forward(F.col("file_path"))).withColumn("_c", F.upper("context"))
        env = (F.col("category") == "env_outside_config") & (_any("_p", self.places) | _any("_c", self.names))
        url = (F.col("category") == "hardcoded_ip_url") & (F.col("_p").startswith("docs/") | _any("_p", ("/docs/", "/_ext/")) | _any("value", ("%s",)) | _any("context", ("%s",)))
        return r.filter(~(env | url)).drop("_p", "_c")


class WordPress:
    """Names of admin screens, and links that texts show, are no findings."""

    name = "wordpress-runtime"
    ui = "act action adminpage bulk control format hook_suffix id name page pagenow postbox screen slug speed status tab templateid theme_location view"

    def refine_hardwiring_findings(self, result: DataFrame, **_: Any) -> DataFrame:
        r = result.withColumn("_p", T.forward(F.col("file_path")))
        admin = F.col("_p").rlike(r"^src/wp-admin/|/wp-admin/")
        slug = F.col("value").rlike(r"(?i)^(?:[/a-z0-9]+(?:[_-][/a-z0-9]+)+|\w+:\w+|[\w-]+-)$")
        shown = F.col("context").rlike(rf"(?i)\b(?:{'|'.join(self.ui.split())})\b")
        magic = F.col("value").isin("no-repeat", "waiting-for-directory-sizes") | (admin | F.col("_p").rlike("^src/js/|/src/js/")) & slug & shown | F.col("value").startswith("/wp_") & admin
        files = F.col("_p").isin(*(f"src/{x}.php" for x in ("index", "wp-admin/about", "wp-admin/includes/media")))
        linked = _any("value", ("github.com", "npmjs.com", "wordpress.org")) & _any("context", ("Thank you", "__(", "esc_url("))
        url = files | _any("context", ("$src",)) | _any("value", ("%1$s",)) | linked | F.col("_p").startswith("tools/") & _any("value", ("github.com",))
        return r.filter(~((F.col("category") == "magic_string") & magic | (F.col("category") == "hardcoded_ip_url") & url)).drop("_p")


BUILT_IN = {"django": Django, "wordpress": WordPress}


def built_in(selected: Iterable[str]) -> list[Plugin]:
    return [Plugin(f"builtin:{n}", BUILT_IN[n].name, BUILT_IN[n]()) for n in selected if n in BUILT_IN]
