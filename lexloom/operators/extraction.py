"""Extraction by a language model behind a provider: prompts, retries, parsing, batches and resumption. No network is used here."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import parse_literal, read_cell
from .joins import keep_last, not_done

RESULT = "raw_output string, payload string, valid_json boolean, legal_triplets string, context_main_topic string, input_tokens long, output_tokens long, error string"


class Provider(Protocol):
    """Answers a prompt; ``usage`` (input and output tokens) may be None, and is then estimated."""

    def __call__(self, prompt: str) -> tuple[str, tuple[int, int] | None]: ...


@dataclass(frozen=True)
class Stub:
    """A rule-based provider for tests: finds "X must Y" in the prompt's text."""

    def __call__(self, prompt: str) -> tuple[str, tuple[int, int] | None]:
        text = prompt.rpartition("TEXT:")[2]
        if "TOPICS" in prompt.partition("TEXT:")[0]:
            places = re.findall(r'"i":\s*(\d+)', text)
            return json.dumps([{"i": int(i), "topic": "maintenanceActivity"} for i in places]), None
        found = re.findall(r"(?:The |the )?(\w+) must (\w+)", text)
        return "```json\n" + json.dumps({"legal_triplets": [{"head": a, "head_type": "Actor", "relation": "mustPerform", "tail": b, "tail_type": "Action"} for a, b in found]}) + "\n```", None


# Prompts are short statements of a task in our own words; callers may pass others.
def prompt_joint(text: str, types: list[str]) -> str:
    return f"List the legal relations of the text as JSON, {{\"legal_triplets\": [head, head_type, relation, tail, tail_type]}}. Types: {', '.join(types)}.\nTEXT:{text}"


def prompt_entities(text: str, types: list[str]) -> str:
    return f"List the entities of the text as a JSON array of id, label and type. Types: {', '.join(types)}.\nTEXT:{text}"


def prompt_relations(text: str, entities: str) -> str:
    return f"List the relations among these entities as JSON, {{\"legal_triplets\": [...]}}, by their ids, with confidence and evidence. ENTITIES:{entities}\nTEXT:{text}"


def prompt_topics(triples: str, topics: list[str]) -> str:
    return f"Give each triple one of the TOPICS {', '.join(topics)}, as a JSON array of i and topic.\nTEXT:{triples}"


def prompt_candidates(triples: str, context: str = "") -> str:
    return f"Propose object properties that the triples need, as JSON with candidates_object_props (domain, range, definition, confidence, textual_evidence). KNOWN:{context}\nTEXT:{triples}"


def json_of(text: str | None):
    """The value of a fenced block, of the text itself, or from its first to its last brace; None if none parses."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.S | re.I)
    braced = re.search(r"\{.*\}", text, re.S)
    for part in (fenced and fenced[1], text, braced and braced[0]):
        value = parse_literal(part.strip()) if part else None
        if isinstance(value, (dict, list)):
            return value
    return None


def _within(call: Callable, seconds: float | None):
    """What ``call`` returns; a TimeoutError if it takes longer. A call that hangs is left to its own thread."""
    if seconds is None:
        return call()
    box: list = []

    def run() -> None:
        try:
            box.append((call(), None))
        except Exception as e:  # noqa: BLE001  # raised again in the caller's thread
            box.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError(f"no answer within {seconds:g} s")
    value, error = box[0]
    if error is not None:
        raise error
    return value


def ask(provider: Provider, prompt: str, tries: int = 3, wait: float = 5.0, timeout: float | None = None) -> tuple[str, tuple[int, int]]:
    """The provider's answer with its tokens; after ``tries`` failures, of which a silence of ``timeout`` seconds is one, an ``ERROR:`` text."""
    count = lambda s: len(re.findall(r"\w+|[^\w\s]", s))
    last = ""
    for attempt in range(tries):
        try:
            answer, usage = _within(lambda: provider(prompt), timeout)
            return answer, usage or (count(prompt), count(answer))
        except Exception as e:  # noqa: BLE001
            last = str(e)
            if attempt + 1 < tries:
                time.sleep(wait)
    return f"ERROR: {last}", (count(prompt), 0)


def triples_of(answer: str) -> tuple[str | None, str]:
    """The payload as JSON, and its triples as a JSON array."""
    value = json_of(answer)
    payload = None if value is None else json.dumps(value, ensure_ascii=False)
    found = read_cell(payload)["triples"] if payload else None
    return payload, found or "[]"


def with_topics(found: str, topics: list[str], step: Callable[[str], str]) -> tuple[str, str | None]:
    """Triples (JSON) with the topics that ``step`` answers for them, and the most frequent one, of equals the first by name."""
    rows = json.loads(found)
    named = json_of(step(prompt_topics(json.dumps([{"i": i, "h": t.get("head"), "r": t.get("relation"), "t": t.get("tail")} for i, t in enumerate(rows)], ensure_ascii=False), topics)))
    by_place = {x["i"]: x.get("topic") for x in (named if isinstance(named, list) else []) if isinstance(x, dict) and isinstance(x.get("i"), int)}
    for i, t in enumerate(rows):
        t["topic"] = by_place.get(i, t.get("topic"))
    given = [t["topic"] for t in rows if t.get("topic")]
    return json.dumps(rows, ensure_ascii=False), max(sorted(set(given)), key=given.count) if given else None


def extract_one(text: str, provider: Provider, types: list[str], topics: list[str], two_steps: bool = True, tries: int = 3, wait: float = 5.0, timeout: float | None = None) -> tuple:
    """One article: entities then relations, or both at once and then topics."""
    tokens = [0, 0]

    def step(prompt: str) -> str:
        answer, usage = ask(provider, prompt, tries, wait, timeout)
        tokens[0] += usage[0]
        tokens[1] += usage[1]
        return answer

    if two_steps:
        first = step(prompt_entities(text, types))
        raw = first if first.startswith("ERROR:") else step(prompt_relations(text, json.dumps(json_of(first), ensure_ascii=False)))
    else:
        raw = step(prompt_joint(text, types))
    payload, found = triples_of(raw)
    main = None
    if not two_steps and found != "[]":
        found, main = with_topics(found, topics, step)
    error = raw if raw.startswith("ERROR:") else None
    return raw, payload, payload is not None, found, main, tokens[0], tokens[1], error


def extract(articles: DataFrame, key: str, text: str, make_provider: Callable[[], Provider], types: list[str], topics: list[str], two_steps: bool = True, concurrency: int = 5, tries: int = 3, wait: float = 5.0, timeout: float | None = None) -> DataFrame:
    """``key`` and the result columns for each article. Each task makes a provider of its own, and has ``concurrency`` requests in flight."""
    kind = articles.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        with ThreadPoolExecutor(concurrency) as pool:
            for part in parts:
                rows = list(pool.map(lambda t: extract_one(t or "", provider, types, topics, two_steps, tries, wait, timeout), part[text]))
                yield pd.DataFrame([[k, *r] for k, r in zip(part[key], rows)], columns=[key, *names])

    return articles.select(key, text).mapInPandas(run, f"`{key}` {kind}, {RESULT}")


def extract_resumable(articles: DataFrame, key: str, text: str, folder: str, **options) -> DataFrame:
    """Only articles that the table in ``folder`` lacks are extracted, and appended to it; the last result of each key is returned."""
    spark = articles.sparkSession
    try:
        done = spark.read.parquet(folder)
        articles = not_done(articles, done, key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    extract(articles, key, text, **options).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(folder)
    return keep_last(spark.read.parquet(folder), key, ["written_at"])


def reparse(results: DataFrame, raw: str = "raw_output", make_provider: Callable[[], Provider] | None = None, topics: list[str] | None = None, **retry) -> DataFrame:
    """Payload and triples from the stored answers, anew; with a provider and ``topics`` also the triples' topics, and ``context_main_topic`` from them."""
    ask_again = make_provider is not None and topics is not None
    kind = "payload string, legal_triplets string, topic string"

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make_provider() if ask_again else None
        for part in parts:
            rows = []
            for text in part:
                payload, found = triples_of(text or "")
                main = None
                if ask_again and found != "[]":
                    found, main = with_topics(found, topics, lambda prompt: ask(provider, prompt, **retry)[0])
                rows.append((payload, found, main))
            yield pd.DataFrame(rows, columns=["payload", "legal_triplets", "topic"])

    again = F.pandas_udf(kind)(run)
    out = results.withColumn("_p", again(raw)).withColumns({"payload": F.col("_p.payload"), "legal_triplets": F.col("_p.legal_triplets")})
    if ask_again:
        out = out.withColumn("context_main_topic", F.coalesce("_p.topic", "context_main_topic") if "context_main_topic" in out.columns else F.col("_p.topic"))
    return out.drop("_p")


#: The arrays of a candidate model.
MODEL_KEYS = ("candidates_classes", "candidates_object_props", "candidates_datatype_props", "unmapped", "conflicts")


def merge_models(models: list[dict]) -> dict:
    """The arrays of several models, each object once (key order aside), the first of equals kept."""
    out: dict[str, list] = {}
    for key in MODEL_KEYS:
        seen: dict[str, object] = {}
        for model in models:
            for item in model.get(key) or []:
                seen.setdefault(json.dumps(item, sort_keys=True, ensure_ascii=False), item)
        out[key] = list(seen.values())
    return out


def discover(batches: DataFrame, batch: str, items: str, make_provider: Callable[[], Provider], **retry) -> DataFrame:
    """``batch``, ``model`` (JSON): the candidate model for each batch of triples, asked for independently; ``merge_models`` unites them."""
    kind = batches.schema[batch].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for part in parts:
            answers = [json_of(ask(provider, prompt_candidates(json.dumps(list(x), ensure_ascii=False)), **retry)[0]) for x in part[items]]
            yield pd.DataFrame({batch: part[batch], "model": [json.dumps(a if isinstance(a, dict) else {}) for a in answers]})

    return batches.select(batch, items).mapInPandas(run, f"`{batch}` {kind}, model string")


def discover_in_turn(batches: list[tuple[object, list]], provider: Provider, **retry) -> tuple[dict, list[tuple[object, dict]]]:
    """Like ``discover``, one batch after the other, each asked with what the earlier ones found: the united model, and each batch's own.

    The order matters, so this is a walk on the driver; batches that may be asked independently go through ``discover``.
    """
    model: dict = {k: [] for k in MODEL_KEYS}
    own = []
    for batch, items in batches:
        known = json.dumps({k: v for k, v in model.items() if v}, ensure_ascii=False) if any(model.values()) else ""
        answer = json_of(ask(provider, prompt_candidates(json.dumps(items, ensure_ascii=False), known), **retry)[0])
        own.append((batch, answer if isinstance(answer, dict) else {}))
        model = merge_models([model, own[-1][1]])
    return model, own


class BatchService(Protocol):
    """A service that takes a file of requests and gives a file of answers some time later."""

    def upload(self, lines: list[str]) -> str: ...

    def status(self, job: str) -> str: ...

    def download(self, job: str) -> list[str]: ...


def run_batch(requests: DataFrame, key: str, prompt: str, make_service: Callable[[], BatchService], per_job: int = 1000, poll: float = 10.0, most_polls: int = 8640) -> DataFrame:
    """``key``, ``output``, ``error`` for each request: each task uploads its requests in jobs of ``per_job`` lines, polls until they are done, and reads the answers by their ids.

    A job that fails, expires or isn't done in time gives its requests an error, as does an answer that is missing.
    """
    kind = requests.schema[key].dataType.simpleString()

    def wait_for(service: BatchService, job: str) -> str:
        for _ in range(most_polls):
            if (state := service.status(job)) in ("completed", "failed", "expired", "cancelled"):
                return state
            time.sleep(poll)
        return "timeout"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make_service()
        for part in parts:
            for at in range(0, len(part), per_job):
                rows = part.iloc[at : at + per_job]
                lines = [json.dumps({"custom_id": str(i), "prompt": p}, ensure_ascii=False) for i, p in enumerate(rows[prompt])]
                job = service.upload(lines)
                state = wait_for(service, job)
                answers = {a["custom_id"]: a for a in map(json.loads, service.download(job))} if state == "completed" else {}
                found = [answers.get(str(i), {"error": "no output" if state == "completed" else state}) for i in range(len(rows))]
                yield pd.DataFrame({key: rows[key].to_numpy(), "output": [a.get("output") for a in found], "error": [a.get("error") for a in found]})

    return requests.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, output string, error string")
