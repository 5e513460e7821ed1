"""Policy: floor, pin list, override, default; failures by channel, category and globally."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORIES
from ..functions.text import keyed_hash

ACTIONS = ("allow", "mask", "block", "tokenize_roundtrip")
STYLES = ("tokenize", "partial", "format_preserving")
#: What each setting may be.
CHOICES = {
    "stage2_fail_action": ("block", "mask_known_only", "open"), "on_infra_failure": ("degrade_to_stage1", "block"), "on_content_failure": ("block", "warn_allow"), "unscannable_action": ("block", "warn_allow", "ocr"),
    "unknown_field_action": ("block", "warn_allow"), "fail_mode": ("open", "closed"),
}


@dataclass
class CategoryPolicy:
    action: str | None = None
    mask_style: str | None = None
    min_confidence: float | None = None
    stage2_fail_action: str | None = None


@dataclass
class Pin:
    hash: str
    category: str
    action: str
    label: str = ""


@dataclass
class Policy:
    categories: dict[str, CategoryPolicy] = field(default_factory=dict)
    pins: list[Pin] = field(default_factory=list)
    channels: dict[str, dict[str, str]] = field(default_factory=dict)
    allow: list[str] = field(default_factory=list)
    settings: dict[str, str] = field(default_factory=dict)
    proximity: dict = field(default_factory=dict)

    # The safe defaults.
    DEFAULTS = {"stage2_fail_action": "block", "on_infra_failure": "degrade_to_stage1", "on_content_failure": "block", "unscannable_action": "block", "unknown_field_action": "block", "fail_mode": "closed"}

    def setting(self, name: str) -> str:
        return self.settings.get(name, self.DEFAULTS[name])


def decide(category: Column, confidence: Column, original: Column, policy: Policy, key: bytes | None = None) -> Column:
    """struct(action, mask_style, effective_min_confidence, reason). The reasons are fixed values, which readers of decisions know."""
    known = {c.name: c for c in CATEGORIES}

    def answer(action, style, floor, reason) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_col(action).alias("action"), as_col(style).alias("mask_style"), as_col(floor).cast("double").alias("effective_min_confidence"), as_col(reason).alias("reason"))

    floors = {n: c.floor for n, c in known.items()} | {n: p.min_confidence for n, p in policy.categories.items() if p.min_confidence is not None}
    floor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in floors.items() for x in kv)), category), F.lit(0.0))
    out = F.when(confidence < floor, answer("allow", "tokenize", floor, "below_min_confidence"))
    if key is not None and policy.pins:
        digest = keyed_hash(original, key)
        for pin in policy.pins:  # the first entry wins
            hit = (category == pin.category) & (digest == pin.hash.removeprefix("sha256:"))
            out = out.when(hit, answer(pin.action, "tokenize", floor, f"pin_list:{pin.label or pin.hash[:12]}"))
    for name, p in policy.categories.items():
        if p.action is not None:
            out = out.when(category == name, answer(p.action, p.mask_style or "tokenize", floor, f"category_override:{name}"))
    actions = F.create_map(*(F.lit(x) for c in CATEGORIES for x in (c.name, c.action)))
    default = F.element_at(actions, category)
    out = out.when(default.isNotNull(), answer(default, "tokenize", floor, F.concat(F.lit("category_default:"), category)))
    return out.otherwise(answer("block", "tokenize", floor, F.concat(F.lit("unknown_category:"), category)))


def apply_policy(dets: Column, policy: Policy, key: bytes | None = None) -> Column:
    """Detections with the decided action and style; what is allowed goes."""
    decided = F.transform(dets, lambda d: F.struct(d.alias("d"), decide(d["category"], d["confidence"], d["original"], policy, key).alias("p")))
    stay = F.filter(decided, lambda x: x["p"]["action"] != "allow")
    return F.transform(stay, lambda x: x["d"].withField("action", x["p"]["action"]).withField("mask_style", x["p"]["mask_style"]))


def enforcement(dets: Column, policy: Policy) -> Column:
    """struct(enforced, suppressed, rate); the rate of none is 0."""
    kept, all_ = F.size(apply_policy(dets, policy)), F.size(dets)
    return F.struct(kept.alias("enforced"), (all_ - kept).alias("suppressed"), F.when(all_ > 0, kept / all_).otherwise(0.0).alias("rate"))


def failure(kind: str, policy: Policy, channel: Column, category: Column | None = None) -> Column:
    """struct(action, reason) for a setting: by channel, then, for stage2_fail_action, by category, then global. on_infra_failure is
    global only."""
    fallback = F.struct(F.lit(policy.setting(kind)).alias("action"), F.lit(f"global.{kind}").alias("reason"))
    out: Column | None = None

    def when(cond: Column, action: str, reason: str) -> None:
        nonlocal out
        value = F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        out = F.when(cond, value) if out is None else out.when(cond, value)

    if kind != "on_infra_failure":
        for name, own in policy.channels.items():
            if kind in own:
                when(channel == name, own[kind], f"channel_override:{name}.{kind}")
    if kind == "stage2_fail_action" and category is not None:
        for name, p in policy.categories.items():
            if p.stage2_fail_action is not None:
                when(category == name, p.stage2_fail_action, f"category_override:{name}.{kind}")
    return fallback if out is None else out.otherwise(fallback)


def scan_options(policy: Policy) -> dict:
    """What a policy says to detect(): its allow list, and its context rules. The names that a policy file has for them ("window" is an older one)."""
    p = policy.proximity
    names = {"window": "window", "window_chars": "window", "account_triggers": "account", "biz_triggers": "business", "password_keywords": "passwords"}
    return {"allow": tuple(policy.allow), "with_proximity": p.get("enabled", True) is not False, "context": {to: p[name] for name, to in names.items() if p.get(name)}}


def channel_action(policy: Policy, kind: str, channel: str | None) -> str:
    """A setting's action for a channel, as failure() decides it, on the driver."""
    return policy.channels.get(channel or "", {}).get(kind) or policy.setting(kind)


def pin_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pins added and removed, by hash: two anti joins."""
    return new.join(old, "hash", "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, "hash", "left_anti").withColumn("change", F.lit("removed")))


def load_policy(raw: dict) -> Policy:
    """From a parsed policy file. Unknown actions, styles, keys and values out of range are errors, so a bad file never replaces a good policy."""
    if not isinstance(raw, dict):
        raise ValueError("a policy is an object")
    unknown = set(raw) - {"version", "categories", "pin_list", "pin_list_approved", "channel_overrides", "allowlist", "proximity", "stage2", *Policy.DEFAULTS}
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")

    def check(values: dict, where: str) -> None:
        for name, value in values.items():
            if name not in CHOICES:
                raise ValueError(f"{where}: unknown key {name!r}")
            if value not in CHOICES[name]:
                raise ValueError(f"{where}{name}: one of {CHOICES[name]}")

    check({k: raw[k] for k in Policy.DEFAULTS if k in raw}, "")
    try:
        categories = {n: CategoryPolicy(**(p or {})) for n, p in (raw.get("categories") or {}).items()}
        pins = [Pin(**p) for p in raw.get("pin_list") or []]
    except (TypeError, AttributeError) as e:
        raise ValueError(str(e)) from e
    for n, p in categories.items():
        if p.action not in (None, *ACTIONS) or p.mask_style not in (None, *STYLES):
            raise ValueError(f"{n}: unknown action or style")
        if p.min_confidence is not None and not (isinstance(p.min_confidence, int | float) and 0 <= p.min_confidence <= 1):
            raise ValueError(f"{n}: min_confidence is from 0 to 1")
        if p.stage2_fail_action is not None:
            check({"stage2_fail_action": p.stage2_fail_action}, f"{n}: ")
    for pin in pins:
        if pin.action not in ACTIONS:
            raise ValueError(f"pin list: unknown action {pin.action!r}")
    channels = raw.get("channel_overrides") or {}
    for name, own in channels.items():
        check(own or {}, f"channel {name}: ")
    proximity = raw.get("proximity") or {}
    if not isinstance(proximity, dict):
        raise ValueError("proximity is an object")
    for name in ("window", "window_chars"):
        window = proximity.get(name, 25)
        if not isinstance(window, int) or isinstance(window, bool) or not 1 <= window <= 200:
            raise ValueError("proximity: window is from 1 to 200")
    for name in ("account_triggers", "biz_triggers", "password_keywords"):
        words = proximity.get(name, [])
        if not isinstance(words, list) or not all(isinstance(w, str) for w in words):
            raise ValueError(f"proximity: {name} is a list of strings")
    if not isinstance(proximity.get("enabled", True), bool):
        raise ValueError("proximity: enabled is true or false")
    memory = (raw.get("stage2") or {}).get("memory_mb", 512)
    if not isinstance(memory, int) or memory < 128:
        raise ValueError("stage2: memory_mb is at least 128")
    allow = [a["pattern"] if isinstance(a, dict) else a for a in raw.get("allowlist") or []]
    for pattern in allow:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"allowlist: {e}") from e
    return Policy(categories, pins, channels, allow, {k: raw[k] for k in Policy.DEFAULTS if k in raw}, proximity)


def pins_digest(pins: list[Pin]) -> str:
    """One hash of a pin list, whatever its order."""
    return hashlib.sha256(json.dumps(sorted((p.hash, p.category, p.action, p.label) for p in pins), ensure_ascii=False).encode()).hexdigest()


@dataclass
class PinChange:
    allowed: bool
    reason: str


def guard_pins(old: list[Pin], new: list[Pin], source: str, approved: bool = False) -> PinChange:
    """Whether a pin list may replace another. An agent's request never does; a change from outside needs its approval."""
    if pins_digest(old) == pins_digest(new):
        return PinChange(True, "unchanged")
    if source == "agent":
        return PinChange(False, "agents may not change the pin list")
    if not approved:
        return PinChange(False, "a changed pin list needs pin_list_approved")
    return PinChange(True, "approved")


class PolicyFile:
    """A policy file (YAML, where its library is installed, or JSON) that is read again when it changes: once per micro-batch, say, as in foreachBatch. A bad file
    keeps the last good policy, and problem says why; a file that is gone means the safe defaults.

    The pin list is guarded from the empty list on: one that differs from the last approved list counts only if the file says pin_list_approved. Without that
    the pins in force stay, the rest of the file counts, and problem says so. Deleting the file doesn't make the next one's pins approved.
    """

    def __init__(self, path: str) -> None:
        self.path, self.policy, self.problem, self.stamp = path, Policy(), None, None
        self.approved = pins_digest([])
        self.reload()

    def _read(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            text = f.read()
        if self.path.endswith(".json"):
            return json.loads(text)
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML needs its library; use a .json file") from e
        try:
            return yaml.safe_load(text) or {}
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e

    def reload(self) -> bool:
        """True if the policy was replaced."""
        try:
            found = os.stat(self.path)
        except FileNotFoundError:
            gone = "no policy file: safe defaults"
            if self.stamp is None and self.problem == gone:
                return False
            self.policy, self.stamp, self.problem = Policy(), None, gone
            return True
        except OSError as e:
            self.problem = str(e)
            return False
        stamp = (found.st_mtime_ns, found.st_size)
        if stamp == self.stamp:
            return False
        self.stamp = stamp
        try:
            raw = self._read()
            policy = load_policy(raw)
        except (ValueError, OSError) as e:
            self.problem = str(e)
            return False
        digest, problem = pins_digest(policy.pins), None
        if digest != self.approved and raw.get("pin_list_approved") is not True:
            policy.pins, problem = list(self.policy.pins), "a changed pin list needs pin_list_approved: the pins in force stay"
        else:
            self.approved = digest
        self.policy, self.problem = policy, problem
        return True


class PinApproval:
    """A proposed pin list on its way into a policy file (JSON): idle, staged, then committed or rejected. Only a staged list can be approved, and only
    while the file's list is the one the proposal was made against."""

    def __init__(self, path: str) -> None:
        self.path, self.state, self.proposed, self.base = path, "idle", [], None

    def _raw(self) -> dict:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _pins(self) -> list[Pin]:
        return [Pin(**p) for p in self._raw().get("pin_list") or []]

    def propose(self, pins: list[Pin]) -> dict[str, list[str]]:
        if self.state == "staged":
            raise ValueError("a proposal is staged already")
        self.base, self.proposed, self.state = pins_digest(self._pins()), list(pins), "staged"
        return self.diff()

    def diff(self) -> dict[str, list[str]]:
        old, new = {p.hash for p in self._pins()}, {p.hash for p in self.proposed}
        return {"added": sorted(new - old), "removed": sorted(old - new)}

    def approve(self) -> None:
        """Writes the list beside the file, and puts it in its place."""
        if self.state != "staged":
            raise ValueError("nothing is staged")
        raw = self._raw()
        if pins_digest(self._pins()) != self.base:
            raise ValueError("the pin list has changed since")
        raw |= {"pin_list": [vars(p) for p in self.proposed], "pin_list_approved": True}
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(raw, f, ensure_ascii=False, indent=1)
        os.replace(f"{self.path}.new", self.path)
        self.state = "committed"

    def reject(self) -> None:
        if self.state != "staged":
            raise ValueError("nothing is staged")
        self.proposed, self.state = [], "rejected"
