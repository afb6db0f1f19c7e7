"""Phrase dictionaries as XML: reading, writing, and files as tables of nodes and conditions."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.dictionary import Condition, Limit, Node, Token, conditions_of, flatten
from colloquy.sources.listing import with_empty

#: Tags of the file format (fixed values).
REQUEST, REMAINDER = "SpeechLabRequest", "SpeechLabRemainderRequest"
MOST_DEEP = 20

ROWS = "path string, node_id string, parent_id string, name string, level int, is_remainder boolean, cond_ord int, phrase string, distance int, channel string, exact boolean, negated boolean, operator string, limits string, saved_state string, attributes string, error string"


def _text(e: ET.Element | None, tag: str, default: str = "") -> str:
    found = e.find(tag) if e is not None else None
    return (found.text or "") if found is not None else default


def _tokens(e: ET.Element) -> list[Token]:
    out = []
    for t in e.findall("Tokens/Token"):
        p = t.find("Properties")
        get = lambda name, p=p: (p.get(name) or _text(p, name)) if p is not None else ""
        out.append(Token(_text(t, "Text"), _text(t, "Type", "WORD"), get("Channel"), get("WordDistance")))
    return out


def _channel(text: str) -> str:
    """CLIENT or OPERATOR, in whatever case it is written; everything else is ANY."""
    return known if (known := text.strip().upper()) in ("CLIENT", "OPERATOR") else "ANY"


def _limits(e: ET.Element) -> list[Limit]:
    out = []
    for group in e.findall("ExtraLimitations/ExtraLimitation"):
        mode = _text(group, "SearchSpecifier")
        for x in group.findall("Limits/Limit"):
            value = _text(x, "Value").strip()
            enabled = _text(x, "Enabled").strip().lower() == "true" and mode in ("OnlyInGaps", "ExcludeGaps")
            out.append(
                Limit(
                    _text(group, "EventType"), mode == "OnlyInGaps", int(value) if value.lstrip("-").isdigit() else 0, _text(x, "ValueType") or "Seconds", _channel(_text(x, "Channel")),
                    _text(x, "LimitType"), _text(x, "EventSelector") or "Each", _text(x, "SearchDirection"), enabled,
                )
            )
    return out


def _attributes(e: ET.Element) -> dict[str, str]:
    """Keys and values of `<Attributes>`, whether as children with a key and a value or as tags."""
    out = {}
    for x in e.findall("Attributes/*"):
        key = x.get("Key") or _text(x, "Key") or x.tag.rpartition("}")[2]
        out[key] = x.get("Value") or _text(x, "Value") or (x.text or "").strip()
    return out


def parse(data: bytes | str, warnings: list[str] | None = None) -> Node:
    """The tree of one dictionary; children over the depth or without a known tag are left out, with a warning."""
    warnings = [] if warnings is None else warnings

    def node(e: ET.Element, depth: int) -> Node:
        for c in e.findall("Requests/*"):
            if c.tag.rpartition("}")[2] not in (REQUEST, REMAINDER):
                warnings.append(f"unknown tag {c.tag} in {_text(e, 'Name')}")
            elif depth >= MOST_DEEP:
                warnings.append(f"{_text(c, 'Name')} is deeper than {MOST_DEEP}")
        remainder = e.tag.rpartition("}")[2] == REMAINDER
        conditions = [] if remainder else conditions_of(_tokens(e))
        for c in conditions:
            c.limits = _limits(e)
        children = [node(c, depth + 1) for c in e.findall("Requests/*") if c.tag.rpartition("}")[2] in (REQUEST, REMAINDER) and depth < MOST_DEEP]
        return Node(_text(e, "Name"), conditions, children, remainder, saved_state=_text(e, "SavedState"), attributes=_attributes(e))

    root = ET.fromstring(data)
    if root.tag.rpartition("}")[2] != REQUEST:
        raise ValueError("not a dictionary")
    return node(root, 0)


def serialize(root: Node) -> str:
    """Canonical XML of a tree; parsing it gives the tree again.

    The file has limits of nodes, not of conditions: a node whose conditions differ in theirs is refused.
    """

    def sub(parent: ET.Element, tag: str, text: str) -> ET.Element:
        e = ET.SubElement(parent, tag)
        e.text = text
        return e

    def token(parent: ET.Element, text: str, kind: str, c: Condition) -> None:
        t = ET.SubElement(parent, "Token")
        sub(t, "Text", text)
        sub(t, "Type", kind)
        sub(t, "IsError", "false")
        ET.SubElement(t, "Properties", Channel=c.channel, WordDistance=str(c.distance))

    def build(n: Node, order: int) -> ET.Element:
        e = ET.Element(REMAINDER if n.remainder else REQUEST, type=REMAINDER if n.remainder else REQUEST)
        sub(e, "Name", n.name)
        sub(e, "OrderIndex", str(order))
        if not n.remainder:
            tokens = ET.SubElement(e, "Tokens")
            for i, c in enumerate(n.conditions):
                words = ([{"OR": "ИЛИ"}.get(c.operator.upper(), c.operator if c.operator else "И")] if i else []) + (["НЕ"] if c.negated else [])
                for w in words:
                    token(tokens, w, "LEXEME", c)
                for mark in ['"'] if c.exact else []:
                    token(tokens, mark, "TERMINAL", c)
                for w in c.text.split(" "):
                    token(tokens, w, "WORD", c)
                for mark in ['"'] if c.exact else []:
                    token(tokens, mark, "TERMINAL", c)
            if any(c.limits != n.conditions[0].limits for c in n.conditions):
                raise ValueError(f"conditions of {n.name} differ in their limits")
            extra = ET.SubElement(e, "ExtraLimitations")
            for x in n.conditions[0].limits if n.conditions else []:
                g = ET.SubElement(extra, "ExtraLimitation")
                sub(g, "EventType", x.event)
                sub(g, "SearchSpecifier", "OnlyInGaps" if x.only else "ExcludeGaps")
                limit = ET.SubElement(ET.SubElement(g, "Limits"), "Limit")
                for tag, value in (("Value", x.value), ("ValueType", x.unit), ("Channel", x.channel), ("Enabled", str(x.enabled).lower()), ("LimitType", x.end), ("EventSelector", x.selector), ("SearchDirection", x.direction)):
                    sub(limit, tag, str(value))
        if n.saved_state:
            sub(e, "SavedState", n.saved_state)
        if n.attributes:
            attributes = ET.SubElement(e, "Attributes")
            for key, value in n.attributes.items():
                ET.SubElement(attributes, "Attribute", Key=key, Value=value)
        requests = ET.SubElement(e, "Requests")
        for i, child in enumerate(n.children):
            requests.append(build(child, i))
        return e

    return ET.tostring(build(root, 0), encoding="unicode")


def read_dictionaries(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """Rows of nodes and conditions of all *.xml files.

    A file that is too large, empty or does not parse is one row with its error; what a file's tree leaves
    out is a row with a warning each. Limits and attributes are JSON.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    good = files.where(F.col("length") <= most_bytes)
    names = [c.split()[0] for c in ROWS.split(", ")]

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                warnings: list[str] = []
                try:
                    placed = flatten([parse(bytes(content), warnings)])
                except (ET.ParseError, ValueError) as e:
                    warnings, placed = [str(e)[:500]], []
                for p in placed:
                    head = (file, p.node_id, p.node_id.rpartition(".")[0] or None, p.node.name, p.level, p.node.remainder)
                    tail = (p.node.saved_state or None, json.dumps(p.node.attributes, ensure_ascii=False) if p.node.attributes else None, None)
                    for i, c in enumerate(p.node.conditions):
                        limits = json.dumps([asdict(x) for x in c.limits], ensure_ascii=False) if c.limits else None
                        out.append((*head, i, c.text, c.distance, c.channel, c.exact, c.negated, c.operator, limits, *tail))
                    if not p.node.conditions:
                        out.append((*head, *[None] * 8, *tail))
                out += [(file, *[None] * (len(names) - 2), w) for w in warnings]
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    bad = files.where(F.col("length") > most_bytes).select("path", F.lit("too large").alias("error"))
    rejected = spark.createDataFrame([], ROWS).unionByName(bad, allowMissingColumns=True)
    return with_empty(spark, path, ".xml", good.select("path", "content").mapInPandas(rows, ROWS).unionByName(rejected), "path", "error")
