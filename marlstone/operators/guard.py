"""Screening of retrieved text for injected instructions, and of answers for signs that they worked."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
_MODAL = r"you\s+(?:must|should|shall"
#: In order of priority: an earlier pattern claims a span that a later one overlaps.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("instruction_override", "critical", r"(?:disregard|forget|ignore|override)\s+(?:(?:the|any|all)\s+)?(?:(?:above|earlier|initial|original|preceding|previous|prior|your)\s+|(?:above|earlier|initial|original|preceding|previous|prior))[\w\s]{0,20}?(?:command|context|direction|instruction|prompt|rule)s?"),
    ("new_instructions", "critical", r"(?:actual|new|real|revised|updated)\s+(?:rule|task|prompt|instruction)s?\s*[-:]"),
    ("fake_system_turn", "critical", r"(?:\n|^)\s*(?:\#{0,3}\s*)?(?:developer|assistant|system)\s*[>:]\s*\S"),
    ("prompt_disclosure", "critical", r"(?:disclose|output|print|repeat|reveal|show)\s+(?:me\s+)?(?:(?:your|the)\s+)?(?:(?:original|initial|system)\s+)?prompt"),
    ("role_override", "high", r"you\s+are\s+(?:from\s+now\s+on|now)\b|(?:switch\s+to|activate|enter)\s+\w{0,12}\s*mode\b|\b(?:developer\s+mode|jailbreak)\b"),
    ("concealment", "high", r"(?:never|don't|do\s+not)\s+(?:acknowledge|disclose|mention|output|refer\s+to|reveal|tell)\s+(?:any\s+of|the\s+above|that|these|this|those)"),
    ("mandated_claim", "high", _MODAL + r")\s+(?:answer|claim|report|say|state|tell\s+\w+)\s+(?:the\s+following\b|there\b|that\b|['\"])"),
    ("mandated_response", "medium", _MODAL + r"|will)\s+(?:output|reply|respond)\b"),
    ("exfiltration_markup", "high", r"!\[[^\]]*\]\(\s*https?://[^)]+\)"),
    ("imperative_to_model", "medium", r"(?:\n|^)\s*(?:pretend\s+to\s+be|act\s+as|as\s+an?\s+ai|your\s+(?:new\s+)?(?:job|task|role)\s+is)\b"),
)
_COMPILED = [(n, s, re.compile(p, re.I)) for n, s, p in PATTERNS]
FINDING = "array<struct<pattern:string,severity:string,start:int,stop:int,excerpt:string>>"


@dataclass(frozen=True)
class GuardConfig:
    action: str = "neutralise"  # flag, neutralise, exclude or refuse
    least: str = "high"
    delimit: bool = True
    marker: str = " [removed: instruction-like text in source] "
    check_output: bool = True
    allow_external_urls: bool = False
    refuse_on_critical: bool = True


def findings(text: str) -> list[dict]:
    """Spans of one text, the most severe first and then by place."""
    out: list[dict] = []
    for name, severity, pattern in _COMPILED:
        for m in pattern.finditer(text):
            if not any(m.start() < f["stop"] and m.end() > f["start"] for f in out):
                out.append({"pattern": name, "severity": severity, "start": m.start(), "stop": m.end(), "excerpt": " ".join(m[0].split())[:160]})
    return sorted(out, key=lambda f: (-RANK[f["severity"]], f["start"]))


def scan(text: Column) -> Column:
    """The findings of each text: a pandas UDF, as regular expressions of the engine give no offsets."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: findings(t or ""))

    return F.pandas_udf(run, FINDING)(text)


def flags(text: Column) -> dict[str, Column]:
    """Whether each pattern occurs, natively."""
    return {name: text.rlike("(?i)" + pattern) for name, _, pattern in PATTERNS}


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for k in RANK for v in (k, RANK[k])]), severity)


def _neutralise(marker: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(text: str, spans) -> str:
            for f in sorted(spans, key=lambda f: -f["start"]):
                text = text[: f["start"]] + marker + text[f["stop"] :]
            return text

        return pd.Series([one(t or "", s) for t, s in zip(texts, found, strict=True)])

    return run


def shield(sources: DataFrame, config: GuardConfig = GuardConfig(), source: str = "source_id", text: str = "text") -> DataFrame:  # noqa: B008
    """sources with original_text, findings, excluded and refused; text is what may be shown to a model."""
    found = sources.withColumn("original_text", F.col(text)).withColumn("findings", scan(F.col(text)))
    serious = F.filter("findings", lambda f: severity_rank(f["severity"]) >= RANK[config.least])
    acted = F.size(serious) > 0
    shown = F.when(acted, _neutralise(config.marker)(F.col(text), serious)).otherwise(F.col(text)) if config.action == "neutralise" else F.col(text)
    return found.withColumn(text, shown).withColumn("excluded", acted & F.lit(config.action == "exclude")).withColumn("refused", acted & F.lit(config.action == "refuse"))


def fence(source: Column, text: Column) -> Column:
    return F.concat(F.lit("SOURCE ["), source.cast("string"), F.lit("] BEGIN\n"), text, F.lit("\nSOURCE ["), source.cast("string"), F.lit("] END"))


def render_context(sources: DataFrame, query: str = "query_id", order: str = "rank", source: str = "source_id", text: str = "text", limit: int | None = 8000, delimit: bool = True) -> DataFrame:
    """(query, context, shown): blocks in order until one goes beyond limit; the first always stays, and nothing follows the first that doesn't fit."""
    block = fence(F.col(source), F.col(text)) if delimit else F.concat(F.lit("["), F.col(source).cast("string"), F.lit("]\n"), F.col(text))
    rows = sources.filter(~F.col("excluded")) if "excluded" in sources.columns else sources
    by = Window.partitionBy(query).orderBy(order)
    cut = rows.withColumn("_block", block).withColumn("_upto", F.sum(F.length("_block")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(by))
    if limit is not None:
        # blocks aren't negative, so the running sum passes the limit once
        cut = cut.filter((F.col("_n") == 1) | (F.col("_upto") <= limit))
    return cut.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_block"))), lambda x: x["_block"]), "\n\n").alias("context"), F.count("*").alias("shown"))


def check_output(answers: DataFrame, sources: DataFrame, config: GuardConfig = GuardConfig(), query: str = "query_id", text: str = "text") -> DataFrame:  # noqa: B008
    """(query, rules, refuse): echoed_instruction (critical), unsourced_url (high) and leaked_marker (medium), sorted."""
    if not config.check_output:
        return answers.select(query, F.array().cast("array<string>").alias("rules"), F.lit(False).alias("refuse"))
    known = sources.groupBy(query).agg(F.array_distinct(F.flatten(F.collect_list(T.urls(F.col(text))))).alias("_known"))
    met = answers.withColumn("_found", scan(F.col("answer"))).join(known, query, "left")
    echoed = F.exists("_found", lambda f: severity_rank(f["severity"]) >= RANK["high"])
    foreign = F.size(F.array_except(T.urls(F.col("answer")), F.coalesce("_known", F.array().cast("array<string>")))) > 0
    rules = F.array_compact(F.array(F.when(echoed, "echoed_instruction"), F.when(F.contains("answer", F.lit(config.marker.strip())), "leaked_marker"), F.when(foreign & F.lit(not config.allow_external_urls), "unsourced_url")))
    return met.select(query, rules.alias("rules"), (echoed & F.lit(config.refuse_on_critical)).alias("refuse"))
