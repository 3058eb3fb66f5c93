"""Repair of model answers that should be JSON: token-based passes, batched over Arrow.

``scan`` cuts a text once into tokens (strings with their escapes, brackets, commas, other runs); every repair works on
tokens, so none of them is misled by what is inside strings.
"""

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]{},]|[^"\[\]{},]+', re.S)
_OPEN = {"[": "]", "{": "}"}


def scan(text: str) -> Iterator[tuple[int, str]]:
    for m in _TOKEN.finditer(text):
        yield m.start(), m[0]


def top_spans(text: str) -> list[tuple[int, int]]:
    """JS2: spans of complete arrays and objects that no other contains; brackets that do not match are passed over."""
    out, stack, start = [], [], 0
    for at, token in scan(text):
        if token in _OPEN:
            start = start if stack else at
            stack.append(_OPEN[token])
        elif stack and token == stack[-1]:
            stack.pop()
            if not stack:
                out.append((start, at + 1))
    return out


def without_trailing_commas(text: str) -> str:
    """JS6."""
    tokens = [t for _, t in scan(text)]
    kept = []
    for i, t in enumerate(tokens):
        after = "".join(tokens[i + 1 : i + 3]).lstrip() if t == "," else ""
        if not (t == "," and after[:1] in ("]", "}")):
            kept.append(t)
    return "".join(kept)


def escaped_newlines(text: str) -> str:
    """JS7: line breaks inside strings as escapes."""
    return "".join(t.replace("\r", "\\r").replace("\n", "\\n") if t[0] == '"' else t for _, t in scan(text))


def closed(text: str) -> str:
    """JS8: closes what was left open."""
    stack: list[str] = []
    for _, t in scan(text):
        if t in _OPEN:
            stack.append(_OPEN[t])
        elif stack and t == stack[-1]:
            stack.pop()
    return text + "".join(reversed(stack))


def merged_objects(text: str) -> str:
    """JS9: several objects beside each other as an array."""
    parts = [text[a:b] for a, b in top_spans(text)]
    return "[" + ",".join(parts) + "]" if len(parts) > 1 and all(p[0] == "{" for p in parts) else text


def fenced(text: str) -> list[str]:
    """JS3: contents of fenced blocks."""
    return [m.strip() for m in re.findall(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)]


def parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def repaired(text: str, deep: bool = True):
    """JS11: the value of the text itself, of its first complete part without trailing commas, or of all repairs."""
    raw = text.strip()
    if (value := parsed(raw)) is not None:
        return value
    spans = top_spans(raw)
    part = without_trailing_commas(raw[slice(*spans[0])] if spans else raw)
    if (value := parsed(part)) is not None or not deep:
        return value
    return parsed(without_trailing_commas(closed(merged_objects(escaped_newlines(part)))))


def key_hits(value, keys: list[str]) -> int:
    """JS13: keys that any object in the value has."""
    seen: set[str] = set()
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            seen |= x.keys()
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return len(seen.intersection(keys))


def extract(answer: str | None, keys: list[str] | None = None, sentinel: str = "</json>"):
    """JS10: the best value in an answer: most of the wanted keys, longer text first; objects come as one-element lists."""
    text = (answer or "").split(sentinel)[0]
    if not text.strip():
        return None
    candidates = [*fenced(text), merged_objects(text), *(text[a:b] for a, b in top_spans(text)), text]
    if "[" in text or "{" in text:
        candidates.append(text[min(i for i in (text.find("["), text.find("{")) if i >= 0) :])
    candidates = list(dict.fromkeys(c.strip() for c in candidates if c.strip()))
    if keys:
        candidates.sort(key=lambda c: (-sum(f'"{k}"' in c for k in keys), -len(c)))
    best, most = None, -1
    for c in candidates:
        value = repaired(c)
        if value is None or not isinstance(value, (dict, list)):
            continue
        hits = key_hits(value, keys or [])
        if hits > most:
            best, most = value, hits
        if not keys or hits == len(keys):
            break
    return [best] if isinstance(best, dict) else best


def extracted(answer: Column, keys: list[str] | None = None) -> Column:
    """Repaired JSON text of an answer column; null where nothing can be read."""

    @F.pandas_udf("string")
    def run(answers: pd.Series) -> pd.Series:
        found = (extract(a, keys) for a in answers)
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True) for x in found], dtype=object)

    return run(answer)


def cleaned(text: Column) -> Column:
    """JS1: plain quotes and commas, and commas between adjacent objects and arrays."""
    plain = F.translate(text, "“”‘’，", "\"\"'',")
    return F.regexp_replace(F.regexp_replace(plain, r"\}\s*\{", "},{"), r"\]\s*\[", "],[")


def _is(value: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def _unfenced(answer: Column, sentinel: str) -> Column:
    """The text before the sentinel without a fence around it."""
    text = F.trim(F.substring_index(F.coalesce(answer, F.lit("")), sentinel, 1))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def first_of(candidates: list[Column], kind: str) -> Column:
    """The first candidate that parses to a value of the kind (ARRAY or OBJECT), as a variant."""
    return F.coalesce(*[F.when(_is(F.try_parse_json(c), kind), F.try_parse_json(c)) for c in candidates])


def balanced_list(text: Column) -> Column:
    """JS4: the shortest text from the first opening bracket to a closing one that parses, which is the balanced one."""
    rest = F.when(F.contains(text, F.lit("[")), F.substring(text, F.instr(text, "["), F.length(text)))
    parts = F.split(rest, r"\]")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "]"), F.lit("]")))
    return F.get(F.filter(ends, lambda x: _is(F.try_parse_json(x), "ARRAY")), F.lit(0))


def list_text(answer: Column, greedy: bool = True, sentinel: str = "</json>") -> Column:
    """JS14, JS16 (not ``greedy``): text of a list in an answer, else the answer without fences."""
    text = _unfenced(answer, sentinel)
    whole = F.when(_is(F.try_parse_json(text), "ARRAY"), text)
    outer = F.regexp_extract(text, r"\[[\s\S]*\]", 0)
    widest = F.when(_is(F.try_parse_json(outer), "ARRAY"), outer) if greedy else F.lit(None)
    return F.coalesce(whole, balanced_list(text), widest, text)


def object_of(answer: Column) -> Column:
    """JS15: the object of an answer: the text without its fence, else from the first brace to the last."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"```\s*$", ""))
    return first_of([bare, F.regexp_extract(bare, r"\{[\s\S]*\}", 0)], "OBJECT")


def simple_list(answer: Column, sentinel: str = "</json>") -> Column:
    """JS12: a fenced value, else the widest list (once more without commas before its end), else the widest object, which
    comes as a list of one; as a variant."""
    text = cleaned(F.substring_index(F.coalesce(answer, F.lit("")), sentinel, 1))
    fence = F.regexp_extract(text, r"```json\s*([\s\S]+?)\s*```", 1)
    outer = F.regexp_extract(text, r"\[[\s\S]*\]", 0)
    lists = [fence, outer, F.regexp_replace(outer, r",\s*\]", "]")]
    one = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    wrapped = F.when(_is(F.try_parse_json(one), "OBJECT"), F.try_parse_json(F.concat(F.lit("["), one, F.lit("]"))))
    return F.coalesce(F.when(_is(F.try_parse_json(fence), "OBJECT"), F.try_parse_json(fence)), first_of(lists, "ARRAY"), wrapped)


def groups_of(payload: Column) -> Column:
    """JS17: member lists of a payload's groups (objects with members, or lists): texts and whole numbers, no empty ones."""
    raw = F.try_variant_get(payload, "$.groups", "array<variant>")
    members = F.transform(raw, lambda g: F.coalesce(F.try_variant_get(g, "$.members", "array<variant>"), F.try_variant_get(g, "$", "array<variant>")))
    kept = F.transform(members, lambda m: F.transform(F.filter(m, lambda x: F.schema_of_variant(x).isin("STRING", "BIGINT")), lambda x: F.variant_get(x, "$", "string")))
    full = F.filter(kept, lambda m: F.size(m) > 0)
    return F.when(F.size(full) > 0, full)


def keys_in(text: Column, keys: list[str]) -> Column:
    """JS13b: how many of the keys a text names."""
    hits = [F.contains(text, F.lit(f'"{k}"')).cast("int") for k in keys]
    return F.coalesce(sum(hits[1:], hits[0]), F.lit(0))


def without_explanation(text: Column) -> Column:
    """JS5: the text up to the last closing brace or bracket."""
    return F.regexp_replace(text, r"([\}\]])[^\}\]]*$", "$1")
