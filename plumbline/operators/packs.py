"""Rule packs and configuration: layers, namespaces, checks, lock files (small, on the driver)."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import tomllib
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rules import BY_ID, CORE, GAUSS, Rule

API_VERSION = 1
ENGINE_VERSION = (0, 2, 9)
PACKS = {"core": CORE, "gaussdb": GAUSS}


def qualify(namespace: str, rule_id: str) -> str:
    return f"{namespace}:{rule_id}" if namespace and ":" not in rule_id else rule_id


def short_id(rule_id: str) -> str:
    return rule_id.rpartition(":")[2]


def check_pack(pack: dict) -> list[str]:
    """Problems of a [pack] table: name, api_version, engine range, characters of the namespace."""
    out = []
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", pack.get("name", "")):
        out.append(f"bad pack name {pack.get('name')!r}")
    if pack.get("namespace") and not re.fullmatch(r"[a-z0-9_-]+", pack["namespace"]):
        out.append(f"bad namespace {pack['namespace']!r}")
    if pack.get("api_version") != API_VERSION:
        out.append(f"api_version {pack.get('api_version')} is not {API_VERSION}")
    for part in str(pack.get("engine", "")).split():
        m = re.fullmatch(r"(>=|<=|<|>|=)?(\d+(?:\.\d+)*)", part)
        if not m:
            out.append(f"bad engine range {part!r}")
            continue
        want = tuple(map(int, m[2].split(".")))
        have = ENGINE_VERSION[: len(want)]
        if not {">=": have >= want, "<=": have <= want, "<": have < want, ">": have > want, "=": have == want, None: have == want}[m[1]]:
            out.append(f"engine {'.'.join(map(str, ENGINE_VERSION))} is outside {part}")
    return out


def merge(*layers: list[dict]) -> tuple[list[Rule], list[str]]:
    """Layers of settings (id, enabled, severity, params), lowest first: a later one replaces in place; conflicts are noted."""
    rules: dict[str, Rule] = {}
    notes: list[str] = []
    for depth, layer in enumerate(layers):
        for row in layer:
            rule_id = row["id"]
            base = rules.get(rule_id) or BY_ID.get(rule_id)
            if base is None:
                notes.append(f"unknown rule {rule_id}")
                continue
            if rule_id in rules and depth:
                notes.append(f"{rule_id} is replaced by layer {depth}")
            changes = {k: row[k] for k in ("enabled", "severity") if k in row}
            if "applies_to" in row:
                changes["applies_to"] = tuple(row["applies_to"])
            rules[rule_id] = replace(base, **changes, params=base.params | row.get("params", {}))
    return list(rules.values()), notes


def load_config(path: str) -> dict:
    """A TOML configuration with defaults filled in; ValueError for values outside their sets."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    out = {
        "dialect": raw.get("check", {}).get("dialect", "generic"), "fallback": raw.get("check", {}).get("fallback", []), "encoding": raw.get("scan", {}).get("encoding", "utf-8"),
        "exclude": raw.get("scan", {}).get("exclude", [".git", "target", "node_modules", "vendor"]), "structure": raw.get("structure", {}), "classification": raw.get("classification", {}), "mapper": raw.get("mapper", {}),
        "rules": raw.get("rules", []), "rollback": raw.get("rollback", {}), "report": raw.get("report", {"formats": ["plain"]}),
    }
    for r in out["rules"]:
        if r.get("severity", "error") not in ("error", "warning"):
            raise ValueError(f"bad severity {r['severity']!r} of rule {r.get('id')}")
    return out


def lock(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, sha256), for a lock file."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def lock_local(root: str) -> dict[str, str]:
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(root).rglob("*")) if p.is_file()}


def verify(locked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): changed, missing or not in the lock."""
    both = locked.withColumnRenamed("sha256", "want").join(lock(files), "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "not locked").when(F.col("want") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


# --- rules list, vendor, add -----------------------------------------------------------------------------------------------------
def listing(packs: list[dict], rules: list[Rule] | None = None, notices: list[str] = (), as_json: bool = False) -> str:
    """Packs (name, version, namespace, api_version, rule_count) and effective rules as text, or as JSON."""
    rules = [*CORE, *GAUSS] if rules is None else rules
    source = lambda r: next((p["name"] for p in packs if p.get("namespace") and r.id.startswith(p["namespace"] + ":")), "local")
    if as_json:
        rows = [{"id": r.id, "name": r.name, "group": r.group, "severity": r.severity, "enabled": r.enabled, "applies_to": list(r.applies_to), "source": source(r)} for r in rules]
        return json.dumps({"packs": packs, "rule_count": len(rules), "rules": rows, "notices": list(notices)}, ensure_ascii=False, indent=2)
    out = ["Rule packs (later ones win):", *(f"  {p['name']:<24} {p.get('version', '-'):<10} namespace={p.get('namespace') or '-':<10} api_version={p.get('api_version', '-')} rules={p.get('rule_count', 0)}" for p in packs)] if packs else ["No rule packs."]
    wide = max([2, *(len(r.id) for r in rules)])
    group = max([5, *(len(r.group or "-") for r in rules)])
    out += ["", f"{'ID':<{wide}}  {'GROUP':<{group}}  {'SEV':<7}  {'ENABLED':<7}  SOURCE"]
    out += [f"{r.id:<{wide}}  {r.group or '-':<{group}}  {r.severity:<7}  {'yes' if r.enabled else 'no':<7}  {source(r)}" for r in rules]
    return "\n".join([*out, "", f"{len(rules)} rule(s) effective", *(f"note: {n}" for n in notices)])


def read_pack(root: str) -> dict:
    """The [pack] table of a pack's folder, with its rule_count; ValueError if it is not usable."""
    raw = tomllib.loads((Path(root) / "pack.toml").read_text(encoding="utf-8"))
    pack = raw.get("pack", {})
    problems = check_pack(pack)
    if problems:
        raise ValueError("; ".join(problems))
    return pack | {"rule_count": len(raw.get("rules", [])), "rules": raw.get("rules", [])}


def vendor(roots: dict[str, str], config_dir: str, to: str = "vendor/rules") -> list[str]:
    """Copy packs (name -> folder) below the configuration's folder; returns the new folders. ValueError without packs."""
    if not roots:
        raise ValueError("no rule packs to vendor")
    out = []
    for name, root in roots.items():
        target = Path(config_dir) / to / name
        shutil.copytree(root, target, dirs_exist_ok=True)
        out.append(str(target))
    return out


def add(spec: str, config_path: str) -> str:
    """Append a pack, `name`, `name@version` or a folder, to the configuration's pack list; returns the entry. ValueError if it is there."""
    path = Path(config_path)
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    known = tomllib.loads(text).get("rule_packs", {}).get("packs", [])
    if Path(spec).is_dir():
        pack = read_pack(spec)
        entry = {"name": pack["name"], "version": str(pack.get("version", "")), "path": spec}
    else:
        name, _, version = spec.partition("@")
        entry = {"name": name, "version": version}
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", entry["name"]):
        raise ValueError(f"bad pack name {entry['name']!r}")
    if any(p.get("name") == entry["name"] for p in known):
        raise ValueError(f"{entry['name']} is configured already")
    lines = ["[[rule_packs.packs]]", *(f"{k} = {json.dumps(v)}" for k, v in entry.items() if v)]
    path.write_text(text.rstrip("\n") + ("\n\n" if text.strip() else "") + "\n".join(lines) + "\n", encoding="utf-8")
    return "\n".join(lines)


def rules_table(spark, rules=None) -> DataFrame:
    rows = [(r.id, r.name, r.group, r.severity, r.enabled, ",".join(r.applies_to), {k: str(v) for k, v in r.params.items()}) for r in (rules or [*CORE, *GAUSS])]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, rule_group string, severity string, enabled boolean, applies_to string, params map<string,string>")
