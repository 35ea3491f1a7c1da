"""Questions in natural language to validated SQL. The model is a callable; what it returns is checked before it runs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter

# Statement words that a read-only query never holds.
DENIED = set(
    "insert update delete merge truncate drop create alter grant revoke copy call do execute prepare deallocate vacuum analyze refresh cluster reindex listen notify lock set reset show load "
    "import export attach detach use cache uncache msck repair add reflect java_method".split()
)


def strip_literals(sql: str) -> str:
    return re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", " x ", sql)


def check_static(sql: str) -> str:
    """One SELECT or WITH statement without comments or statement words; returned without its final semicolon."""
    text = sql.strip()
    fence = re.fullmatch(r"```(?:sql)?\s*(.*?)\s*```", text, re.S)
    text = (fence[1] if fence else text).strip().removesuffix(";").strip()
    bare = strip_literals(text)
    if not text:
        raise InvalidParameter("the model gave no SQL")
    if ";" in bare or "--" in bare or "/*" in bare or "$$" in bare:
        raise InvalidParameter("only one statement without comments is allowed")
    words = re.findall(r"[a-z_]+", bare.lower())
    if words[0] not in ("select", "with"):
        raise InvalidParameter("only SELECT and WITH are allowed")
    if bad := DENIED & set(words):
        raise InvalidParameter(f"not allowed: {sorted(bad)}")
    if re.search(r"\b(parquet|csv|json|orc|text|avro|delta|binaryfile)\s*\.\s*[`x]", re.sub(r"`[^`]*`", "`", text.lower())):
        raise InvalidParameter("files cannot be queried by path")
    return text


#: Leaves of an analysed plan that hold no stored data.
HARMLESS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}


def relations_of(spark: SparkSession, sql: str) -> set[str]:
    """Full identifiers of all stored relations a statement reads, as the analyser resolves them.

    The analyser gives each name its meaning scope by scope, so a common table expression hides a relation
    only where it is visible. A view stands for itself; data read without a name (files by path) is an error.
    """
    state = spark._jsparkSession.sessionState()
    try:
        plan = state.executePlan(state.sqlParser().parsePlan(sql), spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()
    except Exception as e:
        raise InvalidParameter(f"the statement cannot be planned: {str(e).splitlines()[0]}") from e
    names: set[str] = set()
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "View":
            names.add(("temporary view " if node.isTempView() else "") + node.desc().identifier().unquotedString().lower())
            continue
        inner = [node.children(), node.subqueries()]
        todo += [seq.apply(i) for seq in inner for i in range(seq.size())]
        if node.children().size() == 0 and kind not in HARMLESS:
            table = getattr(node, "catalogTable", None) or getattr(node, "tableMeta", None)
            held = table() if table is not None else None
            if held is not None and held.getClass().getSimpleName() == "Some$":
                held = held.get()
            try:
                found = held.get() if held.getClass().getSimpleName() == "Some" else held
                names.add(found.identifier().unquotedString().lower())
            except Exception as e:
                raise InvalidParameter(f"only named relations can be read, not {node.simpleString(5)}") from e
    return names


def nl_to_sql(spark: SparkSession, question: str, allowed: list[str], model: Callable[[list[str]], list[str]], context: str = "") -> str:
    """The model's SQL after all checks; every planned relation must be allowed."""
    if not question or not question.strip() or not allowed:
        raise InvalidParameter("a question and allowed relations are required")
    schema = "\n".join(f"{r}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in spark.table(r).schema)})" for r in allowed)
    prompt = f"Write one SQL SELECT statement.\nRelations:\n{schema}\n{context}\nQuestion: {question}"
    sql = check_static(model([prompt])[0])
    known = {name for r in allowed for name in relations_of(spark, f"SELECT * FROM {r}")}
    if outside := relations_of(spark, sql) - known:
        raise InvalidParameter(f"relations outside the allowed ones: {sorted(outside)}")
    return sql


def nl_query(spark: SparkSession, question: str, allowed: list[str], model, max_rows: int = 100, context: str = "") -> DataFrame:
    """The first ``max_rows`` rows of the validated query, one JSON object each."""
    if max_rows <= 0:
        raise InvalidParameter("max_rows must be positive")
    df = spark.sql(nl_to_sql(spark, question, allowed, model, context)).limit(max_rows)
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))


@dataclass
class NlConfig:
    relations: list[str]
    context: str = ""
    template: str | None = None
    model: str | None = None
    values: dict[tuple[str, str], list[str]] = field(default_factory=dict)


class NlConfigs:
    """Named configurations, prompt templates and value hints."""

    def __init__(self) -> None:
        self.configs: dict[str, NlConfig] = {}
        self.templates: dict[str, tuple[str, bool]] = {}

    def add_config(self, config_id: str, relations: list[str], context: str = "", template: str | None = None, model: str | None = None) -> None:
        if not config_id or not relations:
            raise InvalidParameter("a configuration needs an id and relations")
        old = self.configs.get(config_id)
        self.configs[config_id] = NlConfig(relations, context, template, model, old.values if old else {})

    def add_template(self, template_id: str, prompt: str) -> None:
        """An update keeps the enabled flag."""
        self.templates[template_id] = (prompt, self.templates.get(template_id, ("", True))[1])

    def set_template_enabled(self, template_id: str, enabled: bool) -> None:
        if template_id not in self.templates:
            raise InvalidParameter(f"unknown template {template_id!r}")
        self.templates[template_id] = (self.templates[template_id][0], enabled)

    def config(self, config_id: str) -> NlConfig:
        if config_id not in self.configs:
            raise InvalidParameter(f"unknown configuration {config_id!r}")
        return self.configs[config_id]

    def set_value_index(self, config_id: str, relation: str, column: str, values: list[str]) -> None:
        self.config(config_id).values[(relation, column)] = list(values)

    def refresh_value_index(self, spark: SparkSession, config_id: str, relation: str, column: str, limit: int = 50) -> int:
        """The first ``limit`` distinct values in order."""
        cfg = self.config(config_id)
        if relation not in cfg.relations or not re.fullmatch(r"[A-Za-z_]\w*", column):
            raise InvalidParameter("the relation must be allowed and the column a plain identifier")
        rows = spark.table(relation).select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(limit).collect()
        cfg.values[(relation, column)] = [r.v for r in rows]
        return len(rows)

    def prompt(self, config_id: str) -> str:
        cfg = self.config(config_id)
        text, enabled = self.templates.get(cfg.template or "", ("", False))
        hints = [f"{r}.{c}: {', '.join(v)}" for (r, c), v in sorted(cfg.values.items())]
        return "\n".join(p for p in (cfg.context, text if enabled else "", *hints) if p)

    def nl_query(self, spark: SparkSession, question: str, config_id: str, model, max_rows: int = 100) -> DataFrame:
        return nl_query(spark, question, self.config(config_id).relations, model, max_rows, self.prompt(config_id))
