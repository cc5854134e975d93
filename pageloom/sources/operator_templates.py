"""Hand-written templates: a strict subset of YAML, its writer, and directories of it.

::

    host: example.org
    description: optional
    version: 2
    rules:
      - role: MainContent
        confidence: 0.9
        selectors:
          - main > article
        chain:
          - tag: article
            id: post
            classes: [entry]
"""

from __future__ import annotations

import re
from pathlib import Path

from ..model import ROLES

_TOP = {"host", "description", "version", "rules", "deterministic"}
_RULE = {"role", "selectors", "confidence", "chain"}
_CLAIM = {"tag", "id", "classes", "role"}
_KEY = re.compile(r"^([A-Za-z_]+):(?:\s+(.*))?$")
_SPECIAL = "#.[]{}*&!|>'\"%@`:,?-"


class TemplateError(ValueError):
    """What is wrong, and in which line."""

    def __init__(self, line: int, message: str):
        super().__init__(f"line {line}: {message}")
        self.line = line


def _scalar(text: str, line: int) -> str:
    text = text.strip()
    if text[:1] in "\"'":
        end = text.find(text[0], 1)
        while end > 0 and text[0] == '"' and text[end - 1] == "\\":
            end = text.find('"', end + 1)
        if end < 0 or text[end + 1 :].strip() and not text[end + 1 :].strip().startswith("#"):
            raise TemplateError(line, "unfinished quotation")
        body = text[1:end]
        return body.replace('\\"', '"').replace("\\\\", "\\") if text[0] == '"' else body
    return re.split(r"\s#", text)[0].strip()


def _list(text: str, line: int) -> list[str]:
    text = text.strip()
    if not (text.startswith("[") and text.endswith("]")):
        raise TemplateError(line, "expected a list in brackets")
    return [_scalar(x, line) for x in text[1:-1].split(",") if x.strip()]


def load(text: str) -> dict:
    """A template, or TemplateError: unknown keys, roles and indentations are errors, and so is a missing host or rule."""
    out: dict = {"host": None, "description": None, "version": 1, "deterministic": False, "rules": []}
    rule: dict | None = None
    where, claim = "top", None
    for number, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        if not raw.strip() or raw.lstrip().startswith("#"):
            continue
        if "\t" in raw[: len(raw) - len(raw.lstrip())]:
            raise TemplateError(number, "tabs cannot indent")
        indent, body = len(raw) - len(raw.lstrip(" ")), raw.strip()
        item = body.startswith("- ") or body == "-"
        if item and where in ("selectors", "chain") and indent > rule_indent:
            content = body[1:].strip()
            if where == "selectors":
                rule["selectors"].append(_scalar(content, number))
                continue
            claim = {"tag": "", "id": None, "classes": [], "role": None}
            rule["chain"].append(claim)
            body, where_key = content, "claim"
        elif item:
            if where == "top":
                raise TemplateError(number, "a list item outside rules")
            rule, rule_indent = {"role": None, "selectors": [], "confidence": 1.0, "chain": []}, indent
            out["rules"].append(rule)
            where, claim, body, where_key = "rule", None, body[1:].strip(), "rule"
        else:
            where_key = "top" if indent == 0 else "claim" if claim is not None and where == "chain" and indent > rule_indent + 2 else "rule"
        if not body:
            continue
        m = _KEY.match(body)
        if not m:
            raise TemplateError(number, f"expected a key: {body!r}")
        key, value = m[1], (m[2] or "").strip()
        allowed = {"top": _TOP, "rule": _RULE, "claim": _CLAIM}[where_key]
        if key not in allowed:
            raise TemplateError(number, f"unknown key {key!r}")
        if where_key == "claim":
            claim[key] = _list(value, number) if key == "classes" else _scalar(value, number)
            continue
        if where_key == "top":
            rule, claim = None, None
            where = "rules" if key == "rules" else "top"
            if key == "version":
                if not _scalar(value, number).isdigit():
                    raise TemplateError(number, "version must be a number")
                out["version"] = int(_scalar(value, number))
            elif key == "deterministic":
                out["deterministic"] = _scalar(value, number).lower() == "true"
            elif key != "rules":
                out[key] = _scalar(value, number)
            continue
        if rule is None:
            raise TemplateError(number, f"{key!r} outside a rule")
        if key == "role":
            rule["role"] = _scalar(value, number)
            if rule["role"] not in ROLES:
                raise TemplateError(number, f"unknown role {rule['role']!r}")
        elif key == "confidence":
            try:
                rule["confidence"] = float(_scalar(value, number))
            except ValueError:
                raise TemplateError(number, "confidence must be a number") from None
            if not 0 <= rule["confidence"] <= 1:
                raise TemplateError(number, "confidence must lie between 0 and 1")
        else:
            where = key
            if value:
                if key == "chain":
                    raise TemplateError(number, "chain must be a block")
                rule["selectors"] = _list(value, number)
    if not out["host"]:
        raise TemplateError(1, "host is missing")
    if not out["rules"]:
        raise TemplateError(1, "rules are missing")
    for r in out["rules"]:
        if r["role"] is None or not (r["selectors"] or r["chain"]):
            raise TemplateError(1, "a rule needs a role and selectors or a chain")
    return out


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"' if not text or text[0] in _SPECIAL or " #" in text or text != text.strip() else text


def dump(template: dict) -> str:
    """The text of a template; ``load`` gives it back. Version 1 and confidence 1 are not written."""
    out = [f"host: {_quoted(template['host'])}"]
    if template.get("description"):
        out.append(f"description: {_quoted(template['description'])}")
    if template.get("version", 1) != 1:
        out.append(f"version: {template['version']}")
    if template.get("deterministic"):
        out.append("deterministic: true")
    out.append("rules:")
    for r in template["rules"]:
        out.append(f"  - role: {r['role']}")
        if r.get("confidence", 1.0) != 1.0:
            out.append(f"    confidence: {r['confidence']:g}")
        if r.get("selectors"):
            out += ["    selectors:", *(f"      - {_quoted(s)}" for s in r["selectors"])]
        if r.get("chain"):
            out.append("    chain:")
            for c in r["chain"]:
                out.append(f"      - tag: {c['tag']}")
                if c.get("id"):
                    out.append(f"        id: {_quoted(c['id'])}")
                if c.get("classes"):
                    out.append(f"        classes: [{', '.join(c['classes'])}]")
                if c.get("role"):
                    out.append(f"        role: {c['role']}")
    return "\n".join(out) + "\n"


def load_folder(folder: str | Path, before: dict[str, dict] | None = None) -> tuple[dict[str, dict], dict[str, str]]:
    """(templates by lower-case host, errors by file name). A host's plain file beats its deterministic snapshot;
    a file that fails keeps what ``before`` had."""
    found: dict[str, dict] = {}
    errors: dict[str, str] = {}
    for path in sorted(Path(folder).glob("*.yaml")):
        try:
            t = load(path.read_text(encoding="utf-8"))
        except (TemplateError, UnicodeDecodeError) as problem:
            errors[path.name] = str(problem)
            stem = path.stem.lower()
            if before and stem in before:
                found.setdefault(stem, before[stem])
            continue
        host = t["host"].lower()
        snapshot = t["deterministic"] or path.stem.endswith("-deterministic")
        t["deterministic"] = snapshot
        if host not in found or (found[host]["deterministic"] and not snapshot):
            found[host] = t
    return found, errors


def snapshot_of(host: str, extractor: dict) -> tuple[str, str]:
    """(file name, text) of a learned extractor as a deterministic template."""
    safe = re.sub(r"[^a-z0-9.-]", "_", host.lower())
    rules = [{"role": r["role"], "selectors": r["css"], "confidence": round(r["confidence"], 4), "chain": []} for r in extractor["rules"] if r["css"]]
    return f"{safe}-deterministic.yaml", dump({"host": host, "deterministic": True, "rules": rules})


def as_extractor(template: dict) -> dict:
    """A hand-written template in the form rules are applied in."""
    rules = [{"rule_id": f"op{k:04d}", "role": r["role"], "css": r["selectors"], "confidence": r["confidence"], "claims": [{"data": {}, "aria": {}, **c} for c in r["chain"]] or None} for k, r in enumerate(template["rules"])]
    return {"rules": rules, "centroid": {}, "drift": 0.0}
