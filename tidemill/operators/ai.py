"""Functions backed by a language model. A model is a callable from a list of prompts to a list of replies,
given by the caller; no network is assumed. ``parity`` is the deterministic test model."""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter

Model = Callable[[list[str]], list[str]]
MAX_BATCH = 256
SUMMARY_CHARS = 12_000
SUMMARIZE = "Summarize the following text."
YES, NO = {"yes", "true", "1", "y", "t"}, {"no", "false", "0", "n", "f"}


class ModelError(RuntimeError):
    """A reply that cannot be used (SQLSTATE 38000)."""


def parity(prompts: list[str]) -> list[str]:
    """Yes if the last integer of the prompt is even, else no; a prompt without one gets no."""

    def one(p: str) -> str:
        numbers = re.findall(r"-?\d+", p or "")
        return "yes" if numbers and int(numbers[-1]) % 2 == 0 else "no"

    return [one(p) for p in prompts]


def hashed_embedding(dims: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic test embedding: signed word hashes, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for t in texts:
            v = [0.0] * dims
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def call(model: Model, prompts: list[str], batch: int = MAX_BATCH) -> list[str]:
    """All replies in order, at most ``batch`` prompts a call; no prompt makes no call."""
    out: list[str] = []
    for at in range(0, len(prompts), batch):
        part = prompts[at : at + batch]
        replies = model(part)
        if len(replies) != len(part):
            raise ModelError(f"{len(replies)} replies for {len(part)} prompts")
        out += replies
    return out


def required(values, what: str = "prompt") -> list[str]:
    values = list(values)
    if any(v is None for v in values):
        raise InvalidParameter(f"the {what} must not be null")
    return values


def parse_bool(reply: str) -> bool:
    token = (re.findall(r"\w+", (reply or "").lower()) or [""])[0]
    if token in YES:
        return True
    if token in NO:
        return False
    raise ModelError(f"neither yes nor no: {reply!r}")


def parse_sentiment(reply: str) -> str:
    for word in re.findall(r"[a-z]+", (reply or "").lower()):
        if word in ("positive", "negative", "neutral"):
            return word
    raise ModelError(f"no sentiment: {reply!r}")


def parse_number(reply: str) -> float:
    m = re.search(r"-?\d+(?:\.\d+)?", reply or "")
    if not m:
        raise ModelError(f"no number: {reply!r}")
    return float(m[0])


def replies(s: pd.Series, model: Model, parse: Callable[[str], object], prefix: str = "") -> pd.Series:
    """The read replies to all prompts of a batch; a null prompt or an empty reply is an error."""
    out = call(model, [prefix + p for p in required(s)])
    if any(not r for r in out):
        raise ModelError("empty reply")
    return pd.Series([parse(r) for r in out])


def _column(kind: str, model: Model, prompt: Column, parse: Callable[[str], object], prefix: str = "") -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return replies(s, model, parse, prefix)

    return run(prompt)


class CallCounter:
    """Counts the prompts that reach a model on all executors; read after an action, and again from zero after ``reset``."""

    def __init__(self, spark) -> None:
        self._sent = spark.sparkContext.accumulator(0)
        self._before = 0

    def wrap(self, model: Model) -> Model:
        sent = self._sent

        def counted(prompts: list[str]) -> list[str]:
            sent.add(len(prompts))
            return model(prompts)

        return counted

    @property
    def count(self) -> int:
        return self._sent.value - self._before

    def reset(self) -> None:
        self._before = self._sent.value


def chat(prompt: Column, model: Callable[[list[str], str | None], list[str]], system: str | None = None) -> Column:
    """One reply a row from a model that also takes a system prompt."""
    return _column("string", lambda prompts: model(prompts, system), prompt, str)


def generate(prompt: Column, model: Model = parity) -> Column:
    return _column("string", model, prompt, str)


def summarize(text: Column, model: Model = parity) -> Column:
    return _column("string", model, text, str, SUMMARIZE + "\n")


def ai_if(prompt: Column, model: Model = parity) -> Column:
    return _column("boolean", model, prompt, parse_bool)


def analyze_sentiment(text: Column, model: Model) -> Column:
    return _column("string", model, text, parse_sentiment)


def rank(prompt: Column, model: Model) -> Column:
    """The first number of the reply, not clamped."""
    return _column("float", model, prompt, parse_number)


def if_costly(prompt: Column, model: Model = parity) -> Column:
    """``ai_if`` row by row; a filter's native conditions are planned below it, so only rows that pass them are asked about."""
    return ai_if(prompt, model)


def answers(condition: str, values: list, model: Model) -> list[bool | None]:
    """``condition: value`` for every value; null values are not sent and stay null, unreadable replies are null."""
    live = [i for i, v in enumerate(values) if v is not None]
    out: list[bool | None] = [None] * len(values)
    for i, r in zip(live, call(model, [f"{condition}: {' '.join(str(values[i]).split())}" for i in live])):
        try:
            out[i] = parse_bool(r)
        except ModelError:
            out[i] = None
    return out


def if_batch(condition: str, values: Column, model: Model = parity) -> Column:
    """The ``answers`` of a column."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(answers(condition, list(s), model), dtype=object)

    return run(values)


def generate_batch(prompts: list[str], model: Model = parity) -> list[str]:
    return call(model, required(prompts, "element"))


def rerank(query: str, docs: list[str], scorer: Callable[[str, list[str]], list[float]], top_n: int | None = None) -> list[tuple[int, float]]:
    """(index, score), best first, stable on ties; a null or negative ``top_n`` keeps all."""
    scores = scorer(query, required(docs, "document"))
    order = sorted(range(len(docs)), key=lambda i: -scores[i])
    return [(i, scores[i]) for i in (order if top_n is None or top_n < 0 else order[:top_n])]


def embedded(s: pd.Series, embed: Callable[[list[str]], list[list[float]]], dims: int | None = None) -> pd.Series:
    """Embeddings of a batch in order; nulls stay null."""
    live = [i for i, t in enumerate(s) if t is not None]
    made = embed([s.iloc[i] for i in live]) if live else []
    if len(made) != len(live) or (dims and any(len(v) != dims for v in made)):
        raise ModelError("embeddings do not match the texts")
    by_row = dict(zip(live, made))
    return pd.Series([by_row.get(i) for i in range(len(s))], dtype=object)


def embed_column(text: Column, embed: Callable[[list[str]], list[list[float]]], dims: int | None = None) -> Column:
    """Order-preserving embeddings of all texts of an Arrow batch at once; nulls stay null."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return embedded(s, embed, dims)

    return run(text)


def prefixes(keys: list[str], limit: int):
    """Of each group of a task the first texts in order that can lie within ``limit`` characters; groups are handed over in bounded portions."""

    def cut_off(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (r[0], r[1]))
        used = 0
        for n, r in enumerate(rows):
            used += len(r[1]) + 1
            if used > limit:
                return rows[: n + 1]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: dict[tuple, list[tuple]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(*k, *r) for k, own in held.items() for r in cut_off(own)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(row[: len(keys)], [])
                own.append((row[-2], row[-1][:limit]))
                size += len(own[-1][1]) + 100
            if size > 16 << 20:
                held = {k: cut_off(own) for k, own in held.items()}
                size = sum(len(t) + 100 for own in held.values() for _, t in own)
                if size > 8 << 20:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return run


def agg_summarize(df: DataFrame, keys: list[str], text_col: str, order_col: str, model: Model = parity) -> DataFrame:
    """One summary a group from its non-empty texts joined by newlines in order (ties by text), cut to 12,000 characters; no text gives null.

    Each task keeps of each of its groups only what can lie within the limit, so a group of any size reaches
    the last step as one bounded stretch a task, by way of a second such round over a part of the tasks each.
    """
    rows = df.select(*keys, F.col(order_col).alias("__o"), F.col(text_col).cast("string").alias("__t"))
    full = rows.where((F.char_length("__t") > 0) & F.col("__o").isNotNull())
    first = full.mapInArrow(prefixes(keys, SUMMARY_CHARS), full.schema)
    second = first.withColumn("__task", F.pmod(F.spark_partition_id(), F.lit(64))).repartition(*keys, "__task").drop("__task").mapInArrow(prefixes(keys, SUMMARY_CHARS), full.schema)
    parts = second.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__o", "__t"))).alias("p"))
    every = rows.select(*keys).distinct()
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    both = every.alias("a").join(parts.alias("b"), functools.reduce(lambda x, y: x & y, same, F.lit(True)), "left") if keys else parts
    joined = both.select(*[F.col(f"a.`{k}`") for k in keys], F.when(F.size("p") > 0, F.substring(F.array_join(F.col("p.__t"), "\n"), 1, SUMMARY_CHARS)).alias("text"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        live = [i for i, t in enumerate(s) if t is not None]
        made = dict(zip(live, call(model, [f"{SUMMARIZE}\n{s.iloc[i]}" for i in live])))
        return pd.Series([made.get(i) for i in range(len(s))], dtype=object)

    return joined.select(*keys, run("text").alias("summary"))


def pushdown_safe(depends_on: set[str], generated: set[str]) -> bool:
    """Whether a predicate may run before the columns in ``generated`` exist."""
    return not (set(depends_on) & set(generated))


class ModelRegistry:
    """Named models: their kind, endpoint and settings, and the callable that serves them."""

    def __init__(self) -> None:
        self._models: dict[str, dict] = {}

    def create_model(self, name: str, kind: str, endpoint: str | None = None, config: str | dict | None = None, model: Model | None = None) -> None:
        if not name or kind not in ("chat", "embedding", "rerank"):
            raise InvalidParameter("a model needs a name and the kind chat, embedding or rerank")
        if endpoint is not None and not re.match(r"https?://", endpoint):
            raise InvalidParameter("the endpoint must be http or https")
        self._models[name] = {"name": name, "kind": kind, "endpoint": endpoint, "config": json.loads(config) if isinstance(config, str) else config or {}, "model": model}

    def drop_model(self, name: str) -> bool:
        return self._models.pop(name, None) is not None

    def list_models(self) -> list[dict]:
        return [{k: v for k, v in m.items() if k != "model"} for _, m in sorted(self._models.items())]

    def apply_model(self, name: str) -> Model:
        if name not in self._models or self._models[name]["model"] is None:
            raise InvalidParameter(f"unknown model {name!r}")
        return self._models[name]["model"]
