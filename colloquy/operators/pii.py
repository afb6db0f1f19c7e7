"""Personal-data detection and masking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X

#: Entity, placeholder, validator and its patterns with scores (fixed values).
RECOGNIZERS = (
    ("PHONE_NUMBER", "<PHONE>", "phone", ((r"\+7\s*\(?\d{3}\)?\s*\d{3}[-\s]?\d{2}[-\s]?\d{2}", 0.5), (r"8\s*\(?\d{3}\)?\s*\d{3}[-\s]?\d{2}[-\s]?\d{2}", 0.5), (r"\b8\d{10}\b", 0.4), (r"\+7\d{10}", 0.4))),
    ("PASSPORT", "<PASSPORT>", "passport", ((r"\b\d{2}\s+\d{2}\s+\d{6}\b", 0.5), (r"\b\d{2}-\d{2}-\d{6}\b", 0.5), (r"\b\d{4}\s+\d{6}\b", 0.4))),
    ("SNILS", "<SNILS>", "snils", ((r"\b\d{3}-\d{3}-\d{3}\s+\d{2}\b", 0.5), (r"\b\d{3}-\d{3}-\d{3}-\d{2}\b", 0.5), (r"\b\d{11}\b", 0.3))),
    ("INN", "<INN>", "inn", ((r"\b\d{10}\b", 0.3), (r"\b\d{12}\b", 0.3), (r"\b\d{2,4}-\d{2,4}-\d{2,6}\b", 0.3))),
    ("CREDIT_CARD", "<CARD>", "luhn", ((r"\b\d{4}\s+\d{4}\s+\d{4}\s+\d{4}\b", 0.5), (r"\b\d{16}\b", 0.4), (r"\b\d{15}\b", 0.3))),
    ("CONTRACT_NUMBER", "<CONTRACT>", "", ((r"\bД-\d+[/\\]\d+\b", 0.7), (r"[Дд]оговор\s*№\s*\d+", 0.7), (r"\bК-\d+\b", 0.6), (r"№\s*\d{3,}", 0.3))),
    ("BILLING_ACCOUNT", "<BILLING>", "", ((r"\bЛС\s+\d{4,}\b", 0.7), (r"\bЛ/с\s+\d{4,}\b", 0.7), (r"[Лл]ицевой\s+счёт\s+\d{4,}", 0.7))),
    ("EMAIL_ADDRESS", "<EMAIL>", "", ((r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", 1.0),)),
)

#: A character without which an entity cannot be there.
HINTS = {"EMAIL_ADDRESS": "@"}
#: What a match of any of RECOGNIZERS without a hint begins with: one look at a character rules out most places of a text.
STARTS = "[+0-9ДдКЛл№]"

DETECTION = "array<struct<entity:string,start:int,end:int,score:double>>"


def _valid(kind: Column, found: Column) -> Column:
    bare = F.regexp_replace(found, r"\D", "")
    return (
        F.when(kind == "phone", F.length(bare) == 11)
        .when(kind == "passport", F.substring(bare, 1, 2) != "00")
        .when(kind == "snils", X.snils_valid(found))
        .when(kind == "inn", X.inn_valid(found))
        .when(kind == "luhn", X.luhn_valid(found))
        .otherwise(F.lit(True))
    )


def _spans(text: Column, r: Column) -> Column:
    """Valid matches of one pattern, from the split's parts: each starts where all before it ends."""
    found = F.regexp_extract_all(text, r["pattern"], F.lit(0))
    parts = F.slice(F.split(text, r["pattern"], -1), 1, F.size(found))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,t:string>>)").alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["p"])
        end = start + F.length(x["f"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["f"].alias("t")))).alias("out"))

    spans = F.aggregate(F.zip_with(parts, found, lambda p, f: F.struct(p.alias("p"), f.alias("f"))), zero, step, lambda a: a["out"])
    spans = F.filter(spans, lambda x: _valid(r["check"], x["t"]))
    return F.transform(spans, lambda x: F.struct(r["entity"].alias("entity"), x["s"].alias("start"), x["e"].alias("end"), r["score"].alias("score")))


def detections(text: Column, least: float = 0.5, entities: tuple[str, ...] | None = None, recognizers: tuple = RECOGNIZERS) -> Column:
    """All detections from `least` on. A pattern with a validator counts 1 if valid, else not at all.

    The caller's own recognizers are rows of the same form: RECOGNIZERS + (row,) or others in their place.
    Most texts have none, which one search for all patterns decides; only the others are searched
    pattern by pattern, by one expression over the list of them, so the plan does not grow with it.
    """
    text, none = F.coalesce(text, F.lit("")), F.expr(f"cast(array() as {DETECTION})")
    rows = [(entity, p, 1.0 if check else score, check, HINTS.get(entity, "")) for entity, _, check, patterns in recognizers if not entities or entity in entities for p, score in patterns if check or score >= least]
    if not rows:
        return none
    # Patterns that refer to groups by number or name, and those with a hint, are searched on their own.
    alone = [r for r in rows if r[4] or re.search(r"\\[1-9k]|\(\?<?[A-Za-z]", r[1])]
    seen = F.lit(False)
    for r in alone:
        seen = seen | (F.contains(text, F.lit(r[4])) & F.regexp_like(text, F.lit(r[1])))
    together = [r[1] for r in rows if r not in alone]
    own = {p for entity, _, _, patterns in RECOGNIZERS if entity not in HINTS for p, _ in patterns}
    known = "|".join(f"(?:{p})" for p in together if p in own)
    joint = "|".join([f"(?={STARTS})(?:{known})"] * bool(known) + [f"(?:{p})" for p in together if p not in own])
    seen = seen | F.regexp_like(text, F.lit(joint)) if joint else seen
    names = ("entity", "pattern", "score", "check", "hint")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    found = F.flatten(F.transform(F.filter(listed, lambda r: F.contains(text, r["hint"])), lambda r: _spans(text, r)))
    return F.when(seen, F.array_distinct(found)).otherwise(none)


def resolve(found: Column) -> Column:
    """Without overlaps: the higher score wins, then the longer, then the earlier."""
    better = lambda x: F.struct((-x["score"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["start"].alias("c"), x["entity"].alias("d"), x.alias("x"))
    ranked = F.transform(F.array_sort(F.transform(found, better)), lambda y: y["x"])

    def step(kept, x):
        clash = F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return F.array_sort(F.aggregate(ranked, F.expr(f"cast(array() as {DETECTION})"), step), lambda a, b: a["start"] - b["start"])


def mask(docs: DataFrame, least: float = 0.5, text: str = "text", entities: tuple[str, ...] | None = None, recognizers: tuple = RECOGNIZERS, more: Column | None = None) -> DataFrame:
    """Add detections and masked (the text with placeholders).

    `more` is an array column of further detections (DETECTION), such as a model's persons and
    addresses; those below `least`, null or beyond the text are left out. An entity without a
    recognizer shows its own name as its placeholder.
    """
    places = F.create_map(*[F.lit(v) for e, p, *_ in recognizers for v in (e, p)])
    own = detections(F.col(text), least, entities, recognizers)
    if more is not None:
        fits = lambda x: (x["score"] >= least) & (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(text))
        own = F.array_distinct(F.concat(own, F.filter(F.coalesce(more, F.expr(f"cast(array() as {DETECTION})")), lambda x: F.coalesce(fits(x), F.lit(False)))))
    found = docs.withColumn("detections", own)
    # Most texts have none: only the others are resolved and cut.
    found = found.withColumn("detections", F.when(F.size("detections") > 1, resolve(F.col("detections"))).otherwise(F.col("detections")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = F.coalesce(F.col(text), F.lit(""))
    step = lambda a, d: F.struct(d["end"].alias("at"), F.concat(a["out"], t.substr(a["at"] + 1, d["start"] - a["at"]), F.coalesce(F.try_element_at(places, d["entity"]), F.concat(F.lit("<"), d["entity"], F.lit(">")))).alias("out"))
    masked = F.aggregate("detections", zero, step, lambda a: F.concat(a["out"], t.substr(a["at"] + 1, F.length(t))))
    return found.withColumn("masked", F.when(F.size("detections") > 0, masked).otherwise(t))


def counts(docs: DataFrame) -> DataFrame:
    """(entity, detections, documents) over masked documents."""
    # Outer, as else a filter on the array would find all detections once more.
    flat = docs.select("doc_id", F.explode_outer("detections.entity").alias("entity")).where("entity is not null")
    return flat.groupBy("entity").agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("doc_id").alias("documents"))
