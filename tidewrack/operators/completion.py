"""Model calls as a table operator: rows to validated rows, behind one protocol, with results kept by key.

A completer is made in each Python worker by a picklable factory, gets a prompt and gives text. Results are keyed by a hash
of stage, version and prompt and written once, so that retried tasks and later runs do not pay twice.
"""

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.evidence import chunks
from tidewrack.functions.json_repair import extract
from tidewrack.operators.graph import cut


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class LengthStub:
    """Deterministic stand-in: the option at the prompt's length modulo their number."""

    key: str
    options: list[str]

    def complete(self, prompt: str) -> str:
        return json.dumps({self.key: self.options[len(prompt) % len(self.options)]}) + "\n</json> trailing words"


def pause(attempt: int, base: float = 2.0, cap: float = 60.0) -> float:
    """Exponential back-off with jitter."""
    return min(cap, base * 2**attempt) * random.uniform(1.0, 1.5)


@dataclass
class HttpCompleter:
    """A chat endpoint. Too many requests and server faults are tried again, honouring Retry-After; a refused content
    gives an empty answer; an answer cut for length is continued."""

    url: str
    model: str
    token: str = ""
    tries: int = 4
    max_tokens: int = 4096
    rounds: int = 2
    send: Callable[[urllib.request.Request], dict] | None = None

    def _post(self, messages: list[dict], max_tokens: int) -> dict:
        body = json.dumps({"model": self.model, "messages": messages, "max_tokens": max_tokens}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.token}"})
        if self.send:
            return self.send(request)
        with urllib.request.urlopen(request, timeout=300) as answer:
            return json.load(answer)

    def _choice(self, messages: list[dict], max_tokens: int) -> dict | None:
        for attempt in range(self.tries):
            try:
                return self._post(messages, max_tokens)["choices"][0]
            except urllib.error.HTTPError as e:
                if e.code == 403:
                    return None
                if e.code != 429 and e.code < 500 or attempt == self.tries - 1:
                    raise
                time.sleep(float(e.headers.get("Retry-After") or pause(attempt)))
        return None

    def complete(self, prompt: str) -> str:
        messages, text, room = [{"role": "user", "content": prompt}], "", self.max_tokens
        for _ in range(self.rounds + 1):
            choice = self._choice(messages, room)
            if choice is None:
                return text
            text += choice["message"]["content"]
            if choice.get("finish_reason") != "length":
                break
            room = int(room * 1.5)
            messages = [messages[0], {"role": "assistant", "content": text}, {"role": "user", "content": "Continue exactly where you stopped."}]
        return text


@dataclass(frozen=True)
class Stage:
    """What one kind of call asks for: a prompt around the row's text, the schema of the answer, and what makes it valid."""

    name: str
    prompt: str
    schema: str
    keys: list[str] = field(default_factory=list)
    valid: str = "true"
    most_chars: int = 12_000
    version: str = "1"
    #: Longer texts are asked about in chunks of most_chars that overlap by so many characters; None: only their head is.
    overlap: int | None = 200


#: The kinds of calls of the domain (U1 to U15). ``valid`` is an SQL condition on the answer ``a``.
STAGES = {s.name: s for s in [
    Stage("paper_environment", "Which environments does this abstract sample?\n{text}", "label string", ["label"], "a.label IS NOT NULL", 2_000, overlap=None),
    Stage("paragraph_relation", "Which relation does this paragraph state?\n{text}", "relation string, accessions array<string>, labels array<string>, keys array<string>, quote string", ["relation"], "a.relation IN ('unknown', 'label-metadata', 'accession-metadata', 'accession-label', 'accession-label-metadata')"),
    Stage("family_partition", "Group the names that mean the same.\n{text}", "groups array<array<string>>", ["groups"], "a.groups IS NOT NULL"),
    Stage("sample_environment", "Which environment is this sample from?\n{text}", "value string, source_field string, reason string", ["value"], "a.value IS NOT NULL"),
    Stage("slot_mapping", "Which standard slot does each field map to?\n{text}", "field string, slot string, confidence string, reason string", ["slot"], "a.slot IS NOT NULL"),
    Stage("identity_aliases", "Which names stand for which accession?\n{text}", "accession string, formal_name string, aliases array<string>", ["accession"], "a.accession IS NOT NULL"),
    Stage("section_extraction", "List field values by accession.\n{text}", "accession string, items array<string>", ["accession"], "a.accession IS NOT NULL"),
    Stage("is_environmental", "Is this key environmental metadata?\n{text}", "is_env boolean, reason string", ["is_env"], "a.is_env IS NOT NULL"),
    Stage("four_slots", "Annotate this key.\n{text}", "family string, subtype string, quantity_kind string, modifiers array<string>", ["family"], "a.family IS NOT NULL"),
    Stage("kind_merges", "Which quantity kinds are the same?\n{text}", "target string, members array<string>", ["members"], "size(a.members) > 1"),
    Stage("pair_verification", "Do these two groups mean the same?\n{text}", "decision string, reason string", ["decision"], "a.decision IN ('merge', 'keep')"),
    Stage("standard_alignment", "Which standard slot is this?\n{text}", "slot string, reason string", ["slot"], "a.slot IS NOT NULL"),
    Stage("section_evaluation", "Which of the targets does this section give values for?\n{text}", "target string, value string", ["target"], "a.target IS NOT NULL"),
    Stage("syntax_suggestion", "Which value syntax and unit does each field need?\n{text}", "field string, value_syntax string, preferred_unit array<string>", ["value_syntax"], "a.value_syntax IS NOT NULL"),
    Stage("field_description", "Describe this field in one sentence.\n{text}", "description string", ["description"], "length(a.description) > 0"),
]}


def complete(rows: DataFrame, id_: str, text: Column, stage: Stage, completer: Callable[[], Completer], known: DataFrame | None = None) -> DataFrame:
    """id, key, answer (``a``) and is_valid of every row, one row for each object of an answer.

    A text over the stage's ``most_chars`` has a prompt, a key and answers for each of its chunks, which ``merged`` brings
    together; stages without an overlap ask about its head alone.

    ``known``: earlier results (key, json); only prompts that are not among them are sent, each once. Answers are repaired,
    read with the stage's schema and checked; what cannot be read gives a null answer that is not valid.
    """
    before, after = stage.prompt.split("{text}")
    texts, whole = rows.select(F.col(id_), F.coalesce(text, F.lit("")).alias("__whole")), F.col("__whole")
    if stage.overlap is None:
        parts = F.array(F.left(whole, F.lit(stage.most_chars)))
    else:
        spans = chunks(whole, stage.most_chars, stage.overlap)
        parts = F.array_distinct(F.transform(spans, lambda c: F.substring(whole, c["start"] + 1, c["end"] - c["start"])))
    asked = texts.select(F.col(id_), F.explode(parts).alias("part")).select(id_, F.concat(F.lit(before), "part", F.lit(after)).alias("prompt"))
    asked = asked.withColumn("key", F.sha2(F.concat_ws("\n", F.lit(stage.name), F.lit(stage.version), "prompt").cast("binary"), 256))
    todo = asked.select("key", "prompt").dropDuplicates(["key"])
    if known is not None:
        todo = todo.join(known.select("key"), "key", "left_anti")
    keys = stage.keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = completer()
        for batch in batches:
            found = [extract(client.complete(p), keys) for p in batch["prompt"]]
            yield pd.DataFrame({"key": batch["key"], "json": [None if x is None else json.dumps(x, ensure_ascii=False) for x in found]})

    fresh = cut(todo.mapInPandas(run, "key string, json string"))
    results = fresh if known is None else fresh.unionByName(known.select("key", "json"))
    read = results.select("key", F.explode_outer(F.from_json("json", f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in stage.schema.split(', '))}>>")).alias("a"))
    checked = read.withColumn("is_valid", F.coalesce(F.expr(stage.valid), F.lit(False)))
    return asked.select(id_, "key").join(checked, "key")


def merged(completed: DataFrame, id_: str) -> DataFrame:
    """id, answer (``a``) and is_valid of every row over all its chunks: each different answer once, and a null answer only
    where the row has no other."""
    read = completed.groupBy(id_).agg(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "is_valid"))).alias("all"))
    return read.select(id_, F.explode_outer("all").alias("x")).select(id_, "x.a", F.coalesce("x.is_valid", F.lit(False)).alias("is_valid"))


def results_of(completed: DataFrame) -> DataFrame:
    """key and json of finished prompts, to be kept for later runs."""
    return completed.groupBy("key").agg(F.to_json(F.collect_list("a")).alias("json"))
