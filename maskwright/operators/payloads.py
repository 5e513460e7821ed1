"""Chat payloads of three providers: text fields, masked bodies, coverage of their schemas, tripwire, and restored responses.

Payload trees have no fixed depth, so Arrow-batched functions walk the JSON; everything else is columns. Whatever a payload holds, each ends in
fields, and what can't be walked is one unknown field, which blocks: nothing passes unseen, and no row stops a job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .detect import EMPTY, detect
from .policy import Policy, apply_policy, channel_action, scan_options

_FLAGS = ("is_scannable", "is_unscannable", "is_unknown", "is_listed")
_NAMES = ("location", "scan_field", "text", *_FLAGS, "gap_reason")
FIELD = T.ArrayType(T.StructType([T.StructField(n, T.BooleanType() if n in _FLAGS else T.StringType()) for n in _NAMES]))
LEAF = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("location", "text")]))


def provider_of(path: Column) -> Column:
    bare = F.split(path, r"\?", 2)[0]
    return F.when(bare == "/v1/messages", "claude").when(bare.isin("/v1/chat/completions", "/v1/completions"), "openai").when(path.rlike(r"/models/[^/]+:(generateContent|streamGenerateContent)"), "gemini")


def _at(where: str, key: object) -> str:
    return f"{where}[{key}]" if isinstance(key, int) else f"{where}.{key}" if where else str(key)


def leaves(node: object, where: str, path: tuple = ()) -> Iterator[tuple[str, str, tuple]]:
    """String leaves with their locations and paths, in document order; no recursion, so depth is no limit."""
    stack = [(where, node, path)]
    while stack:
        at, x, p = stack.pop()
        if isinstance(x, str):
            yield at, x, p
        elif isinstance(x, dict | list):
            items = x.items() if isinstance(x, dict) else enumerate(x)
            stack += reversed([(_at(at, k), v, (*p, k)) for k, v in items])


def kind_of(value: object) -> str:
    return type(value).__name__


class _Walk:
    """Fields in visiting order; for each scannable one the path to its text, and the path inside, if that text is JSON itself."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.paths: list[tuple[tuple, tuple | None]] = []

    def _add(self, at: str, kind: str, text: str | None, state: int, reason: str | None, path: tuple = (), inner: tuple | None = None) -> None:
        self.rows.append((at, kind, text, state == 0, state == 1, state >= 2, state == 3, reason))
        self.paths.append((path, inner))

    def text(self, at: str, kind: str, value: object, path: tuple, reason: str | None = None, inner: tuple | None = None) -> None:
        """A missing text is empty; what isn't text is unknown."""
        if value is None or isinstance(value, str):
            self._add(at, kind, value or "", 0, reason, path, inner)
        else:
            self.unknown(at, f"text is of type {kind_of(value)}")

    def closed(self, at: str, kind: str, reason: str) -> None:
        self._add(at, kind, None, 1, reason)

    def unknown(self, at: str, reason: str) -> None:
        self._add(at, "unknown", None, 2, reason)

    def listed(self, at: str, reason: str) -> None:
        """Unknown to a reader of the request, but never a reason to block it."""
        self._add(at, "unknown", None, 3, reason)

    def tree(self, at: str, kind: str, value: object, path: tuple) -> None:
        for where, text, p in leaves(value, at, path):
            self.text(where, kind, text, p)

    def part(self, at: str, holder: dict, key: str, then: Callable[[dict, str], None], reason: str) -> None:
        """holder[key] if it is an object. Nothing is nothing; anything else is unknown."""
        value = holder.get(key)
        if isinstance(value, dict):
            then(value, _at(at, key))
        elif value is not None:
            self.unknown(_at(at, key), f"{reason} is of type {kind_of(value)}")

    def items(self, holder: dict, key: str, at: str, path: tuple, one: Callable[[dict, str, tuple], None], *, odd: bool = False) -> None:
        """The objects of the list holder[key]. odd: other items are listed; else they pass, as they hold no text that is read."""
        value = holder.get(key)
        if isinstance(value, list):
            for k, item in enumerate(value):
                if isinstance(item, dict):
                    one(item, f"{_at(at, key)}[{k}]", (*path, key, k))
                elif odd or isinstance(item, str | list):
                    self.unknown(f"{_at(at, key)}[{k}]", f"an item of {key} is of type {kind_of(item)}")
        elif value is not None:
            self.unknown(_at(at, key), f"{key} is of type {kind_of(value)}, not a list")

    def blocks(self, value: object, at: str, path: tuple, kind: str, one: Callable[[dict, str, tuple], None]) -> None:
        """A string, or a list of typed blocks."""
        if isinstance(value, str):
            self.text(at, kind, value, path)
        elif isinstance(value, list):
            for k, block in enumerate(value):
                if isinstance(block, dict):
                    one(block, f"{at}[{k}]", (*path, k))
                else:
                    self.listed(f"{at}[{k}]", f"a content block is of type {kind_of(block)}")
        elif value is not None:
            self.unknown(at, f"content is of type {kind_of(value)}")

    def claude(self, body: dict) -> None:
        def system(block: dict, at: str, path: tuple) -> None:
            if block.get("type", "") == "text":
                self.text(f"{at}.text", "system_prompt", block.get("text"), (*path, "text"))
            else:
                self.unknown(at, f"system block of unknown type {block.get('type', '')!r}")

        def content(block: dict, at: str, path: tuple) -> None:
            kind = block.get("type", "")
            if kind == "text":
                self.text(f"{at}.text", "message_text", block.get("text"), (*path, "text"))
            elif kind == "tool_use":
                self.tree(f"{at}.input", "tool_use_input", block.get("input"), (*path, "input"))
            elif kind == "tool_result":
                self.blocks(block.get("content"), f"{at}.content", (*path, "content"), "tool_result", result)
            elif kind == "document":
                self.part(at, block, "source", lambda source, where: document(source, where, (*path, "source")), "document source")
            elif kind == "image":
                self.closed(at, "image", "images can't be scanned for text")
            else:
                self.unknown(at, f"content block of unknown type {kind!r}")

        def document(source: dict, at: str, path: tuple) -> None:
            if source.get("type") == "text":
                self.text(f"{at}.data", "document_text", source.get("data"), (*path, "data"))
            else:
                self.closed(at, "document", f"a document of type {source.get('type', '')!r} can't be scanned for text")

        def result(block: dict, at: str, path: tuple) -> None:
            if block.get("type") == "text":
                self.text(f"{at}.text", "tool_result", block.get("text"), (*path, "text"))
            elif block.get("type") == "image":
                self.closed(at, "image", "images can't be scanned for text")
            else:
                self.unknown(at, f"tool result block of unknown type {block.get('type', '')!r}")

        self.blocks(body.get("system"), "system", ("system",), "system_prompt", system)
        self.items(body, "messages", "", (), lambda m, at, path: self.blocks(m.get("content"), f"{at}.content", (*path, "content"), "message_text", content))

    def openai(self, body: dict) -> None:
        kinds = {"system": "system_prompt", "developer": "system_prompt", "tool": "tool_result", "function": "tool_result"}

        def message(m: dict, at: str, path: tuple) -> None:
            role = m.get("role")
            kind = kinds.get(role, "message_text") if isinstance(role, str) else "message_text"

            def part(block: dict, where: str, p: tuple) -> None:
                name = block.get("type", "")
                if name in ("text", "refusal"):
                    self.text(f"{where}.{name}", kind, block.get(name), (*p, name))
                elif name in ("image_url", "input_audio", "file"):
                    self.closed(where, name, f"a part of type {name} can't be scanned for text")
                else:
                    self.unknown(where, f"content part of unknown type {name!r}")

            self.blocks(m.get("content"), f"{at}.content", (*path, "content"), kind, part)
            self.items(m, "tool_calls", at, path, lambda c, where, p: self.part(where, c, "function", lambda f, w: arguments(f, w, (*p, "function")), "function"))

        def arguments(function: dict, at: str, path: tuple) -> None:
            args, where, path = function.get("arguments"), f"{at}.arguments", (*path, "arguments")
            if isinstance(args, str):
                try:
                    inner = json.loads(args)
                    found = list(leaves(inner, where))
                except (ValueError, RecursionError):
                    self.text(where, "tool_call_arguments", args, path, "arguments are not JSON; scanned as text")
                else:
                    for at_, text, p in found:
                        self.text(at_, "tool_call_arguments", text, path, None, p)
            elif args is not None:
                self.listed(where, f"arguments are of type {kind_of(args)}")

        self.items(body, "messages", "", (), message)

    def gemini(self, body: dict) -> None:
        def pick(obj: dict, *names: str) -> str | None:
            return next((n for n in names if n in obj), None)

        def parts(holder: dict, at: str, path: tuple, kind: str) -> None:
            self.items(holder, "parts", at, path, lambda part, where, p: one(part, where, p, kind), odd=True)

        def one(part: dict, at: str, path: tuple, kind: str) -> None:
            if "text" in part:
                self.text(f"{at}.text", kind, part["text"], (*path, "text"))
            elif n := pick(part, "functionCall", "function_call"):
                self.part(at, part, n, lambda x, w: self.tree(f"{w}.args", "function_call_args", x.get("args"), (*path, n, "args")), n)
            elif n := pick(part, "functionResponse", "function_response"):
                self.part(at, part, n, lambda x, w: self.tree(f"{w}.response", "function_response", x.get("response"), (*path, n, "response")), n)
            elif n := pick(part, "executableCode", "executable_code"):
                self.part(at, part, n, lambda x, w: self.text(f"{w}.code", "executable_code", x.get("code"), (*path, n, "code")), n)
            elif n := pick(part, "codeExecutionResult", "code_execution_result"):
                self.part(at, part, n, lambda x, w: self.text(f"{w}.output", "code_execution_result", x.get("output"), (*path, n, "output")), n)
            elif n := pick(part, "inlineData", "inline_data", "fileData", "file_data"):
                self.closed(f"{at}.{n}", "binary", f"{n} can't be scanned for text")
            else:
                self.unknown(at, f"part with unknown keys {sorted(part)}")

        if name := pick(body, "systemInstruction", "system_instruction"):
            value = body[name]
            if isinstance(value, str):
                self.text(name, "system_prompt", value, (name,))
            elif isinstance(value, dict) and isinstance(value.get("parts"), list):
                parts(value, name, (name,), "system_prompt")
            else:
                self.unknown(name, f"{name} is of type {kind_of(value)}, without a list of parts")
        self.items(body, "contents", "", (), lambda c, at, path: parts(c, at, path, "message_text"))


PROVIDERS = ("claude", "openai", "gemini")


def _unicode(text: str) -> str | None:
    """The text; None if it holds half a surrogate pair, which no column can."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return None
    return text


def _walked(provider: str | None, payload: str | None) -> tuple[object, _Walk]:
    walk, body = _Walk(), None
    try:
        body = json.loads(payload or "")
        if provider not in PROVIDERS:
            walk.unknown("", f"provider {provider!r} is not known")
        elif not isinstance(body, dict):
            walk.unknown("", f"payload is of type {kind_of(body)}")
        else:
            getattr(walk, provider)(body)
    except (ValueError, RecursionError):
        walk.unknown("", "payload is not JSON, or too deep")
    except Exception as e:  # noqa: BLE001 - whatever a walk stumbles on must block
        walk = _Walk()
        walk.unknown("", f"payload can't be walked: {kind_of(e)}")
    clean = lambda x: x.encode("utf-8", "backslashreplace").decode() if x else x
    for k, (at, kind, text, *flags, reason) in enumerate(walk.rows):
        if text and _unicode(text) is None:
            kind, text, flags, reason = "unknown", None, [False, False, True, False], "text is not valid Unicode"
        walk.rows[k] = (clean(at), kind, text, *flags, clean(reason))
    return body, walk


@F.pandas_udf(FIELD)
def fields(provider: pd.Series, payload: pd.Series) -> pd.Series:
    """The text, unscannable and unknown fields of a request, in visiting order. What isn't a JSON object of a known provider is one unknown field."""
    return pd.Series([[dict(zip(_NAMES, r)) for r in _walked(p, x)[1].rows] for p, x in zip(provider, payload)])


@F.pandas_udf(LEAF)
def json_string_leaves(payload: pd.Series) -> pd.Series:
    def one(x: str | None) -> list[dict]:
        try:
            return [{"location": a, "text": t} for a, t, _ in leaves(json.loads(x or ""), "") if _unicode(a + t) is not None]
        except (ValueError, RecursionError):
            return []

    return payload.map(one)


def _put(node: object, path: tuple, value: object) -> None:
    for key in path[:-1]:
        node = node[key]
    node[path[-1]] = value


def _masked(style: str | None, original: str, token: str) -> str:
    n = len(original)
    if style == "partial":
        k = min(2, max(1, n // 4))
        return "***" if n <= 4 else original[:k] + "***" + original[n - k :]
    if style == "format_preserving":
        return "".join("X" if c.isupper() else "x" if c.islower() else "0" if c.isdigit() else c for c in original)
    return f"[{token}]"


_EXTRA = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("extra_keys", T.ArrayType(T.StringType()))]))
#: What scrub() knows of a request before its payload is masked.
_ANSWERS = ("request_id", "provider", "own", "n_detections", "gaps")
_FOUND = "array<struct<seq:int,dets:array<struct<start:int,end:int,original:string,category:string,action:string,mask_style:string>>>>"


def _mask(provider: str | None, payload: str | None, found: list[dict] | None) -> tuple[str | None, dict[str, str]]:
    """found: of each scannable field with findings its place in visiting order, and the findings. The payload with them masked, and the
    placeholders. The first sighting of a value in the request fixes its placeholder. None for a payload that isn't a JSON object."""
    body, walk = _walked(provider, payload)
    if not isinstance(body, dict):
        return None, {}
    tokens: dict[str, str] = {}
    counts: dict[str, int] = {}
    inside: dict[tuple, object] = {}
    for seq, dets in sorted((f["seq"], f["dets"]) for f in found or []):
        text, at, out = walk.rows[seq][2], 0, []
        for d in dets:
            value, category = d["original"], d["category"]
            if d["action"] == "allow":
                continue
            if value not in tokens:
                counts[category] = counts.get(category, 0) + 1
                tokens[value] = f"{category}_{counts[category]}" + ("_BLOCKED" if d["action"] == "block" else "")
            out += [text[at : d["start"]], _masked(d["mask_style"], value, tokens[value])]
            at = d["end"]
        path, inner = walk.paths[seq]
        new = "".join(out) + text[at:]
        if inner is None:
            _put(body, path, new)
        else:  # a string of JSON: parsed once, written back below
            if path not in inside:
                node = body
                for key in path:
                    node = node[key]
                inside[path] = json.loads(node)
            if inner:
                _put(inside[path], inner, new)
            else:
                inside[path] = new
    for path, value in inside.items():
        _put(body, path, json.dumps(value, ensure_ascii=False))
    whole = json.dumps(body, ensure_ascii=False)
    return whole if _unicode(whole) is not None else json.dumps(body), {t: v for v, t in tokens.items()}


def _mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with found to rows with masked and restoration_map, both null for a payload that can't be masked, whatever the reason: scrub() blocks it."""

    def one(*row) -> tuple[str | None, dict[str, str]]:
        try:
            return _mask(*row)
        except Exception:  # noqa: BLE001 - whatever goes wrong, nothing passes
            return None, {}

    for batch in batches:
        done = [one(*row) for row in zip(*(batch.column(n).to_pylist() for n in ("provider", "payload", "found")))]
        columns = {n: batch.column(n) for n in _ANSWERS} | {"masked": pa.array([m for m, _ in done], pa.string()), "restoration_map": pa.array([list(r.items()) for _, r in done], pa.map_(pa.string(), pa.string()))}
        yield pa.RecordBatch.from_pydict(columns)


def request_fields(requests: DataFrame) -> DataFrame:
    """requests: request_id, provider, payload. A row per field, with its place in visiting order."""
    found = requests.select("request_id", "provider", fields("provider", "payload").alias("fields"))
    return found.select("request_id", "provider", F.posexplode("fields").alias("seq", "f")).select("request_id", "provider", "seq", "f.*")


def scrub(requests: DataFrame, *, unknown_action: str = "block", unscannable_action: str = "block", policy: Policy | None = None, channel: str | None = None, key: bytes | None = None, **options) -> DataFrame:
    """requests: request_id, provider, payload. A row per row of requests: block, gaps (distinct reasons in order), n_detections, tripwire (the rules on the
    masked payload found something that blocks), masked (the payload with findings replaced) and restoration_map. A scannable field
    without an answer blocks, as do unknown and unscannable fields, if their action is block; listed oddities don't. A request blocks, too, if it has no masked
    payload, or if any of these answers is missing. options: for detect(). A policy decides instead, for the channel: both actions, the allow list, the context rules, and what is
    done with each finding; key: of its pins.

    Each row is a request of its own, from its fields to its masked payload, whatever its id: null and repeated ids meet nothing of other rows, and nothing is
    shuffled.
    """

    if policy is not None:
        unknown_action, unscannable_action = (channel_action(policy, kind, channel) for kind in ("unknown_field_action", "unscannable_action"))
        options = scan_options(policy) | options

    def scanned(f: Column) -> Column:
        dets = detect(f["text"], **options)
        dets = F.when(f["is_scannable"], dets if policy is None else apply_policy(dets, policy, key))
        return F.struct(f["is_scannable"].alias("is_scannable"), f["is_unscannable"].alias("is_unscannable"), f["is_unknown"].alias("is_unknown"), f["is_listed"].alias("is_listed"), f["gap_reason"].alias("gap_reason"), dets.alias("dets"))

    rows = requests.select("request_id", "provider", "payload", fields("provider", "payload").alias("fields"))
    rows = rows.withColumn("scanned", F.transform("fields", scanned)).drop("fields")

    def blocks(f: Column) -> Column:
        failed = f["is_scannable"] & f["dets"].isNull()
        own = F.exists(F.coalesce(f["dets"], F.array().cast(EMPTY)), lambda d: d["action"] == "block")
        return F.coalesce(failed | own | (f["is_unknown"] & ~f["is_listed"] & F.lit(unknown_action == "block")) | (f["is_unscannable"] & F.lit(unscannable_action == "block")), F.lit(True))

    names = ("start", "end", "original", "category", "action", "mask_style")
    found = F.transform("scanned", lambda f, k: F.struct(k.alias("seq"), F.transform(f["dets"], lambda d: F.struct(*(d[n].alias(n) for n in names))).alias("dets")))
    rows = rows.select(
        "request_id", "provider", "payload", F.coalesce(F.exists("scanned", blocks), F.lit(True)).alias("own"),
        F.coalesce(F.aggregate("scanned", F.lit(0).cast("long"), lambda n, f: n + F.coalesce(F.size(f["dets"]), F.lit(0))), F.lit(0).cast("long")).alias("n_detections"),
        F.array_distinct(F.filter(F.transform("scanned", lambda f: f["gap_reason"]), lambda g: g.isNotNull())).alias("gaps"), F.filter(found, lambda f: F.size(f["dets"]) > 0).cast(_FOUND).alias("found"),
    )
    kept = rows.select(*_ANSWERS).schema.add("masked", "string").add("restoration_map", T.MapType(T.StringType(), T.StringType()))
    rows = rows.mapInArrow(_mask_rows, kept)
    alarm = F.coalesce(tripwire(F.col("masked"))["should_block"], F.lit(True))
    out = rows.select("request_id", "provider", "own", "n_detections", F.coalesce("gaps", F.array().cast("array<string>")).alias("gaps"), alarm.alias("alarm"), "masked", "restoration_map")
    missing = F.col("masked").isNull()
    return out.select("request_id", "provider", (F.col("own") | F.col("alarm") | missing).alias("block"), "n_detections", "gaps", (F.col("alarm") & ~missing).alias("tripwire"), "masked", "restoration_map")


def tripwire(payload: Column, **options) -> Column:
    """struct(should_block, hits): the rules alone, on the serialised JSON; only blocking hits act."""
    hits = detect(payload, with_proximity=False, **options)
    return F.struct(F.exists(hits, lambda h: h["action"] == "block").alias("should_block"), hits.alias("hits"))


def unknown_keys(obj: Column, known: Sequence[str]) -> Column:
    """Keys of a JSON object that aren't known, sorted. Null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(obj), F.array(*(F.lit(k) for k in known))))


# The keys that each object of a request may have; "type" tables are by the block's type.
KNOWN_KEYS = {
    "claude": {
        "": ["model", "messages", "max_tokens", "system", "stream", "temperature", "top_p", "top_k", "stop_sequences", "metadata", "tools", "tool_choice", "anthropic_version", "betas"],
        "messages": ["role", "content"],
        "content": ["type", "text", "id", "name", "input", "tool_use_id", "content", "source", "thinking", "signature", "cache_control", "media_type"],
        "system": ["type", "text", "cache_control"],
        "source": ["type", "media_type", "data", "url"],
        "tools": ["name", "description", "input_schema", "cache_control"],
        "type": {
            "text": ["type", "text", "cache_control"],
            "tool_use": ["type", "id", "name", "input", "cache_control"],
            "tool_result": ["type", "tool_use_id", "content", "cache_control", "is_error"],
            "document": ["type", "source", "title", "cache_control", "citations"],
            "image": ["type", "source", "cache_control"],
            "thinking": ["type", "thinking", "signature"],
            "redacted_thinking": ["type", "data"],
        },
    },
    "openai": {
        "": ["model", "messages", "temperature", "top_p", "n", "stream", "stream_options", "stop", "max_tokens", "max_completion_tokens", "presence_penalty", "frequency_penalty", "logit_bias", "logprobs", "top_logprobs", "tools", "tool_choice", "parallel_tool_calls", "function_call", "functions", "response_format", "modalities", "audio", "seed", "service_tier", "metadata", "store", "user", "reasoning_effort", "prediction", "web_search_options"],
        "messages": ["role", "content", "name", "tool_calls", "tool_call_id", "refusal", "audio"],
        "tool_calls": ["id", "type", "function"],
        "tool_calls.function": ["name", "arguments"],
        "content": ["type", "text", "image_url", "input_audio", "file", "refusal"],
        "tools": ["type", "function"],
        "tools.function": ["name", "description", "parameters", "strict"],
        "type": {"text": ["type", "text"], "image_url": ["type", "image_url"], "input_audio": ["type", "input_audio"], "file": ["type", "file"], "refusal": ["type", "refusal"]},
    },
    "gemini": {
        "": ["contents", "systemInstruction", "system_instruction", "tools", "toolConfig", "tool_config", "safetySettings", "safety_settings", "generationConfig", "generation_config", "cachedContent", "cached_content", "model"],
        "contents": ["role", "parts"],
        "instruction": ["role", "parts"],
        "parts": ["text", "functionCall", "function_call", "functionResponse", "function_response", "inlineData", "inline_data", "fileData", "file_data", "executableCode", "executable_code", "codeExecutionResult", "code_execution_result", "thought", "videoMetadata", "video_metadata"],
        "generation": ["stopSequences", "stop_sequences", "responseMimeType", "response_mime_type", "responseSchema", "response_schema", "candidateCount", "candidate_count", "maxOutputTokens", "max_output_tokens", "temperature", "topP", "top_p", "topK", "top_k", "presencePenalty", "presence_penalty", "frequencyPenalty", "frequency_penalty", "responseLogprobs", "response_logprobs", "logprobs", "enableEnhancedCivicAnswers", "enable_enhanced_civic_answers", "speechConfig", "speech_config", "audioTimestamp", "audio_timestamp", "thinkingConfig", "thinking_config", "mediaResolution", "media_resolution"],
    },
}


def _objects(holder: object, key: str, at: str) -> Iterator[tuple[str, dict]]:
    """The objects of the list holder[key], with their locations."""
    value = holder.get(key) if isinstance(holder, dict) else None
    for k, item in enumerate(value if isinstance(value, list) else []):
        if isinstance(item, dict):
            yield f"{_at(at, key)}[{k}]", item


def _known_objects(provider: str, body: dict) -> Iterator[tuple[str, dict, list[str]]]:
    """(location, object, its known keys) of every object whose keys are checked."""
    keys = KNOWN_KEYS[provider]
    yield "", body, keys[""]
    typed = lambda block: keys["type"].get(block.get("type", "") if isinstance(block.get("type", ""), str) else "", keys["content"])
    if provider == "claude":
        for at, block in _objects(body, "system", ""):
            yield at, block, keys["system"]
        for at, message in _objects(body, "messages", ""):
            yield at, message, keys["messages"]
            for where, block in _objects(message, "content", at):
                yield where, block, typed(block)
                if isinstance(block.get("source"), dict):
                    yield f"{where}.source", block["source"], keys["source"]
                if block.get("type") == "tool_result":
                    for below, inner in _objects(block, "content", where):
                        yield below, inner, typed(inner)
        for at, tool in _objects(body, "tools", ""):
            yield at, tool, keys["tools"]
    elif provider == "openai":
        for at, message in _objects(body, "messages", ""):
            yield at, message, keys["messages"]
            for where, block in _objects(message, "content", at):
                yield where, block, typed(block)
            for where, call in _objects(message, "tool_calls", at):
                yield where, call, keys["tool_calls"]
                if isinstance(call.get("function"), dict):
                    yield f"{where}.function", call["function"], keys["tool_calls.function"]
        for at, tool in _objects(body, "tools", ""):
            yield at, tool, keys["tools"]
            if isinstance(tool.get("function"), dict):
                yield f"{at}.function", tool["function"], keys["tools.function"]
    else:
        for at, item in _objects(body, "contents", ""):
            yield at, item, keys["contents"]
            for where, part in _objects(item, "parts", at):
                yield where, part, keys["parts"]
        for name in ("systemInstruction", "system_instruction"):
            if isinstance(body.get(name), dict):
                yield name, body[name], keys["instruction"]
                for where, part in _objects(body[name], "parts", name):
                    yield where, part, keys["parts"]
        for name in ("generationConfig", "generation_config"):
            if isinstance(body.get(name), dict):
                yield name, body[name], keys["generation"]


@F.pandas_udf(_EXTRA)
def extra_keys(provider: pd.Series, payload: pd.Series) -> pd.Series:
    """Objects of a request that have keys its schema doesn't know. Null for what isn't a JSON object of a known provider."""

    def one(p: str | None, x: str | None) -> list[dict] | None:
        try:
            body = json.loads(x or "")
        except (ValueError, RecursionError):
            return None
        if p not in PROVIDERS or not isinstance(body, dict):
            return None
        clean = lambda t: t.encode("utf-8", "backslashreplace").decode()
        return [{"path": at, "extra_keys": extra} for at, obj, known in _known_objects(p, body) if (extra := sorted(clean(k) for k in set(obj) - set(known)))]

    return pd.Series([one(p, x) for p, x in zip(provider, payload)])


def coverage_diff(requests: DataFrame, provider: str) -> DataFrame:
    """(request_id, path, extra_keys) where an object of a request has keys that the schema doesn't know, in visiting order."""
    own = requests.where(F.col("provider") == provider)
    return own.select("request_id", F.explode(extra_keys("provider", "payload")).alias("d")).select("request_id", "d.path", "d.extra_keys")


# The versions that are known.
KNOWN_VERSIONS = {"claude": ["2023-06-01"], "openai": ["v1"], "gemini": ["v1", "v1beta", "v1alpha"]}


def diff_request(requests: DataFrame, provider: str, version: Column | None = None) -> DataFrame:
    """coverage_diff(), and a row (path "version", the version as its only key) for each request whose version isn't known."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider!r}")
    out = coverage_diff(requests, provider)
    if version is None:
        return out
    odd = requests.where((F.col("provider") == provider) & version.isNotNull() & ~version.isin(KNOWN_VERSIONS[provider]))
    return out.unionByName(odd.select("request_id", F.lit("version").alias("path"), F.array(version).alias("extra_keys")))


def coverage_alarms(deltas: DataFrame, action: str = "block") -> DataFrame:
    return deltas.withColumn("alarm_type", F.lit("unknown_fields")).withColumn("should_block", F.lit(action == "block"))


def coverage_policy(deltas: DataFrame, action: str = "block") -> DataFrame:
    """Per request: should_block, number of alarms."""
    return coverage_alarms(deltas, action).groupBy("request_id").agg(F.bool_or("should_block").alias("should_block"), F.count("*").alias("n_alarms"))


# --- responses ------------------------------------------------------------------------------------

def _restored(text: str, pairs: list[tuple[str, str]]) -> tuple[str, int]:
    """The text with placeholders replaced, and how many different ones it held."""
    n = 0
    for token, value in pairs:
        if f"[{token}]" in text:
            n += 1
            text = text.replace(f"[{token}]", value)
    return text, n


def _restore_tree(value: object, pairs: list[tuple[str, str]]) -> tuple[object, int]:
    """Every string leaf restored, in place where it can be."""
    if isinstance(value, str):
        return _restored(value, pairs)
    n = 0
    for _, text, path in list(leaves(value, "")) if isinstance(value, dict | list) else []:
        new, k = _restored(text, pairs)
        if k:
            _put(value, path, new)
            n += k
    return value, n


def _text_slots(provider: str | None, body: dict) -> Iterator[tuple[dict, str]]:
    """(object, key) of each text-bearing value of a response. Of an unknown provider, every value."""
    if provider == "claude":
        for _, block in _objects(body, "content", ""):
            name = {"text": "text", "thinking": "thinking", "tool_use": "input"}.get(block.get("type") if isinstance(block.get("type"), str) else None)
            if name in block:
                yield block, name
    elif provider == "openai":
        for _, choice in _objects(body, "choices", ""):
            for holder in (choice.get("message"), choice.get("delta")):
                if isinstance(holder, dict) and isinstance(holder.get("content"), str if holder is choice.get("delta") else str | list):
                    yield holder, "content"
            message = choice.get("message")
            for _, call in _objects(message, "tool_calls", ""):
                if isinstance(call.get("function"), dict) and isinstance(call["function"].get("arguments"), str):
                    yield call["function"], "arguments"
    elif provider == "gemini":
        for _, candidate in _objects(body, "candidates", ""):
            for _, part in _objects(candidate.get("content"), "parts", ""):
                if isinstance(part.get("text"), str):
                    yield part, "text"
                if isinstance(part.get("functionCall"), dict) and part["functionCall"].get("args") is not None:
                    yield part["functionCall"], "args"
    else:
        yield from ((body, k) for k in body)


def _shown(provider: str | None, body: dict) -> str:
    """What a terminal shows of a response: its texts, a line each."""
    if provider == "claude":
        texts = [b.get(b["type"]) for _, b in _objects(body, "content", "") if b.get("type") in ("text", "thinking")]
    elif provider == "openai":
        held = [c.get("message") or c.get("delta") or {} for _, c in _objects(body, "choices", "")]
        held = [h.get("content") for h in held if isinstance(h, dict)]
        texts = [" ".join(t for _, t, _ in leaves(h, "") if t) if isinstance(h, list) else h for h in held]
    elif provider == "gemini":
        texts = [p.get("text") for _, c in _objects(body, "candidates", "") for _, p in _objects(c.get("content"), "parts", "")]
    else:
        texts = [" ".join(t for _, t, _ in leaves(body, "") if t)]
    return "\n".join(t for t in texts if isinstance(t, str) and t)


def process_response(provider: Column, body: Column, restoration: Column, *, terminal_restore: bool = False) -> Column:
    """struct(agent_body, terminal_text, substitution_count, was_rehydrated): the response with placeholders in its text-bearing fields restored, and what a
    terminal shows, which keeps the placeholders unless terminal_restore. What isn't JSON, and anything with an empty map, passes as it came."""

    def one(p: str | None, x: str | None, known: dict | None) -> tuple:
        pairs = sorted((dict(known) if known is not None else {}).items(), key=lambda kv: -len(kv[0]))
        try:
            parsed = json.loads(x or "")
        except (ValueError, RecursionError):
            return x, "", 0, False
        if not isinstance(parsed, dict):
            return x, x if pairs else "", 0, False
        shown, n = _shown(p, parsed), 0
        if pairs:
            for holder, key in list(_text_slots(p, parsed)):
                holder[key], k = _restore_tree(holder[key], pairs)
                n += k
            x = json.dumps(parsed, ensure_ascii=False)
            if _unicode(x) is None:
                x = json.dumps(parsed)
            if terminal_restore:
                shown = _shown(p, parsed)
        return x, shown.encode("utf-8", "replace").decode(), n, n > 0

    @F.pandas_udf("agent_body string, terminal_text string, substitution_count int, was_rehydrated boolean")
    def run(p: pd.Series, x: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(p, x, r)], columns=["agent_body", "terminal_text", "substitution_count", "was_rehydrated"])

    return run(provider, body, restoration)


@F.pandas_udf(T.StringType())
def rehydrate_json(payload: pd.Series, restoration: pd.Series) -> pd.Series:
    """Placeholders in every string of a JSON document to originals, longer tokens first; other text is restored as it is."""

    def one(x: str | None, known: dict | None) -> str | None:
        if x is None:
            return None
        pairs = sorted((dict(known) if known is not None else {}).items(), key=lambda kv: -len(kv[0]))
        try:
            whole = json.dumps(_restore_tree(json.loads(x), pairs)[0], ensure_ascii=False)
        except (ValueError, RecursionError):
            return _restored(x, pairs)[0]
        return whole if _unicode(whole) is not None else _restored(x, pairs)[0]

    return pd.Series([one(x, r) for x, r in zip(payload, restoration)])
