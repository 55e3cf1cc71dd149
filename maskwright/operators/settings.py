"""Settings and lists: stored JSON to checked values, detection options from them, conflicts of lists, small predicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import BLANK
from maskwright.operators.vault import POOLS
from maskwright.schema import GROUPS_ON, TYPES, DetectionConfig, Sensitivity

# Settings with their defaults, and the choices of those that have some.
DEFAULTS = {"minConfidence": 0.5, "contextBoost": 0.15, "contextWindow": 5, "nerProvider": "off", "nerModel": "ai4privacy", "sensitivityMode": "global", "sensitivity": 0.5, "defaultReplacementMode": "placeholder", "identityVaultEnabled": True, "fileScanEnabled": True, "skipCodeBlocks": False, "cancelDetectionBehavior": "ask"}
CHOICES = {"nerProvider": ("off", "fixture", "transformers"), "nerModel": ("ai4privacy", "bardsai", "hikmaai"), "sensitivityMode": ("global", "individual"), "defaultReplacementMode": ("placeholder", "synthetic"), "cancelDetectionBehavior": ("ask", "paste-original", "drop")}
SOURCES = ("manual", "detection")


def _number(value: object, low: float, high: float) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and low <= value <= high


def _entries(raw: object, scopes: tuple[str, ...]) -> list[dict]:
    """List entries that are whole: a pattern, a known scope, a time and a source."""
    rows = raw if isinstance(raw, list) else []
    return [e for e in rows if isinstance(e, dict) and isinstance(e.get("pattern"), str) and e.get("scope") in scopes and _number(e.get("addedAt"), float("-inf"), float("inf")) and e.get("source") in SOURCES]


def checked(raw: object, curated: tuple[str, ...] = ()) -> dict:
    """Settings with every value of the wrong kind, choice or range replaced by its default; unknown ones stay."""
    given = raw if isinstance(raw, dict) else {}
    out = DEFAULTS | given
    for name, default in DEFAULTS.items():
        value = out[name]
        if name in CHOICES:
            good = value in CHOICES[name]
        elif isinstance(default, bool):
            good = isinstance(value, bool)
        elif name == "minConfidence":
            good = _number(value, 0, 1) and value > 0
        else:
            good = _number(value, 0, float("inf"))
        out[name] = value if good else default
    groups, marks = given.get("groupsEnabled"), given.get("groupThresholds")
    groups, marks = (x if isinstance(x, dict) else {} for x in (groups, marks))
    out["groupsEnabled"] = {g: groups[g] if isinstance(groups.get(g), bool) else on for g, on in GROUPS_ON.items()}
    out["groupThresholds"] = {g: marks[g] for g in GROUPS_ON if _number(marks.get(g), 0, 1)}
    out["allowlist"] = _entries(given.get("allowlist"), ("any",))
    out["blocklist"] = _entries(given.get("blocklist"), ("any", *(t[0] for t in TYPES)))
    urls = given.get("curatedUrls")
    out["curatedUrls"] = list(dict.fromkeys([*(urls if isinstance(urls, list) else []), *curated]))
    return out


def sensitivity(settings: dict) -> Sensitivity:
    return Sensitivity(settings["sensitivity"], settings["sensitivityMode"] == "individual", tuple(settings["groupThresholds"].items()))


def options(settings: dict) -> DetectionConfig:
    """Detection options: detection keeps what the lowest threshold of any type can need."""
    return DetectionConfig(sensitivity(settings).lowest(), settings["contextBoost"], int(settings["contextWindow"]))


def config_from_json(text: str) -> DetectionConfig:
    """The default configuration with the fields that a JSON object names; the default itself if it is none or of wrong kinds."""
    default = DetectionConfig()
    try:
        given = json.loads(text) if text else {}
    except json.JSONDecodeError:
        return default
    kinds = {"min_confidence": (int, float), "context_boost": (int, float), "context_window": int}
    if not isinstance(given, dict) or any(k in kinds and v is not None and (isinstance(v, bool) or not isinstance(v, kinds[k])) for k, v in given.items()):
        return default
    values = {k: given[k] for k in kinds if given.get(k) is not None}
    return DetectionConfig(**(default.__dict__ | values))


def config_json(config: DetectionConfig = DetectionConfig()) -> str:
    return json.dumps(config.__dict__)


def list_pattern(pattern: str) -> str:
    """SQL: a list pattern trimmed, white space made single blanks, lower case."""
    return f"lower(regexp_replace(regexp_replace({pattern}, '^{BLANK}+|{BLANK}+$', ''), '{BLANK}+', ' '))"


def conflicts(patterns: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ``patterns`` whose pattern stands in the other list too, whatever its case and blanks."""
    there = others.select(F.expr(list_pattern("pattern")).alias("_pattern")).distinct()
    return patterns.withColumn("_pattern", F.expr(list_pattern("pattern"))).join(there, "_pattern", "left_semi").drop("_pattern")


def curated(url: Column, prefixes: list[str]) -> Column:
    """Whether a URL begins with one of the curated ones."""
    out = F.lit(False)
    for p in prefixes:
        out = out | url.startswith(p)
    return F.coalesce(out, F.lit(False))


def pool_size(kind: Column) -> Column:
    """Size of a type's pool of synthetic values (addresses of mail come from the pool of persons); 0: none."""
    sizes = {k: len(v) for k, v in POOLS.items()} | {"EMAIL": len(POOLS["PERSON"])}
    table = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return F.coalesce(table[kind], F.lit(0))


def notices(scanned: DataFrame) -> DataFrame:
    """Scanned files (path, status, truncated, n_findings) that need attention, with a notice.

    A file without findings is listed only if it could not be scanned.
    """
    # Notices by status.
    text = F.when(F.col("status") == "too-large", "Not checked: the file is too large to scan.").when(F.col("status") == "no-text", "Not checked: the file contains no readable text. Scanned documents and images are not read (no OCR).").when(F.col("status") != "scanned", "Not checked: the file could not be read.").when(F.col("truncated"), "Only the first part of this file was checked.")
    return scanned.withColumn("notice", text).filter((F.col("n_findings") > 0) | (F.col("status") != "scanned"))
