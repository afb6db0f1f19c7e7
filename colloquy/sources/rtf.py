"""Dialogues from RTF files: a push-down parser of groups, tables in tables, and columns told by their headers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X
from colloquy.operators.kept import written
from colloquy.schemas import CLIENT, OPERATOR, UNKNOWN
from colloquy.sources.listing import with_empty
from colloquy.sources.turns import from_plain_text, with_end_offsets

#: Groups whose text is not part of the document (fixed values of the format).
ASIDE = set("fonttbl colortbl stylesheet info pict header headerl headerr headerf footer footerl footerr footerf footnote object themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl latentstyles nonesttables fldinst bkmkstart bkmkend".split())
#: Code pages of a font's character set (fixed values of the format).
CHARSETS = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "cp936", 136: "cp950", 161: "cp1253", 162: "cp1254", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 238: "cp1250"}
#: Control words that stand for a character (fixed values of the format).
SIGNS = {"tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": "\xa0", "_": "-", "-": "", "{": "{", "}": "}", "\\": "\\"}

_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)|\\")

ROWS = "dialogue_id string, ord int, part int, depth int, cells array<struct<text:string,color:int>>, error string"


@dataclass
class _Group:
    aside: bool = False  # its text is left out
    codec: str = "cp1251"
    skip: int = 1  # characters that stand for a \\u
    color: int = 0
    depth: int = 0  # of the table that the paragraph is in
    fonts: bool = False  # it lists fonts


@dataclass
class _Open:
    """A cell and a row that are being read, at one depth of tables."""

    text: list[str] = field(default_factory=list)
    colors: dict[int, int] = field(default_factory=dict)
    cells: list[tuple[str, int]] = field(default_factory=list)

    def cell(self) -> tuple[str, int]:
        out = " ".join("".join(self.text).split()), max(self.colors, key=lambda c: (self.colors[c], -c), default=0)
        self.text, self.colors = [], {}
        return out


def parse(data: bytes, codec: str = "cp1251") -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
    """(part, depth, cells) in the order of their ends: lines (depth 0, one cell) and rows of tables, inner ones before outer.

    Each cell is its text and the colour number of most of it. A part is a table, or the lines between
    two; a table inside a cell is a part of its own. Text is decoded by the code page of its font, else
    of the document, else the given one; unbalanced groups end where the file ends.
    """
    stack, now = [], _Group(codec=codec)
    pages: dict[int, str] = {}
    font, pending, raw = 0, 0, bytearray()
    opened: dict[int, _Open] = {}
    parts, used, was = {0: 0}, 0, 0

    def place() -> _Open:
        return opened.setdefault(now.depth, _Open())

    def put(text: str) -> None:
        if text and not now.aside:
            place().text.append(text)
            if text.strip():
                place().colors[now.color] = place().colors.get(now.color, 0) + len(text)

    def flush() -> None:
        if raw:
            put(raw.decode(now.codec, "replace"))
            raw.clear()

    def part_of(depth: int) -> int:
        nonlocal used, was
        if depth not in parts or (min(depth, 1) != min(was, 1)):
            used += 1
            parts[depth] = used
        was = depth
        return parts[depth]

    def line() -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
        if opened.get(0):
            done = opened.pop(0).cell()
            if done[0]:
                yield part_of(0), 0, [done]

    def row(depth: int) -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
        done = opened.pop(depth, _Open()).cells
        if any(t for t, _ in done):
            yield part_of(depth), depth, done

    at = 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        at = m.end()
        word, number, byte, sign, brace, plain = m.groups()
        if byte is not None:
            if pending:
                pending -= 1
            else:
                raw.append(int(byte, 16))
            continue
        if plain is not None:
            cut = min(pending, len(plain))
            pending -= cut
            raw += plain[cut:]
            continue
        if brace or word or sign:
            flush()
        if brace == b"{":
            pending = 0
            stack.append(now)
            now = replace(now)
        elif brace == b"}":
            pending = 0
            now = stack.pop() if stack else now
        elif sign is not None:
            mark = sign.decode("latin-1")
            if mark == "*":
                now.aside = True
            elif mark in "\r\n":
                yield from _break(now, place, line)
            else:
                put(SIGNS.get(mark, ""))
        elif word is not None:
            name, n = word.decode(), int(number) if number else None
            if name == "u" and n is not None:
                put(chr(n % 65536))
                pending = now.skip
            elif name == "uc":
                now.skip = n or 0
            elif name == "bin":
                at += max(0, n or 0)
            elif name == "ansicpg":
                now.codec = codec = f"cp{n}" if _known(f"cp{n}") else codec
            elif name == "fonttbl":
                now.aside, now.fonts = True, True
            elif name == "f" and n is not None:
                font = n
                if not now.fonts:
                    now.codec = pages.get(n, codec)
            elif name == "fcharset" and now.fonts:
                if n in CHARSETS and n:
                    pages[font] = CHARSETS[n]
            elif name == "nesttableprops":  # its marks count although readers of old may pass over it
                now.aside = False
            elif name in ASIDE:
                now.aside = True
            elif now.aside:
                pass
            elif name in SIGNS:
                put(SIGNS[name])
            elif name == "cf":
                now.color = n or 0
            elif name == "plain":
                now.color = 0
            elif name == "pard":
                now.depth = 0
            elif name == "intbl":
                now.depth = max(now.depth, 1)
            elif name == "itap":
                now.depth = n or 0
            elif name in ("par", "line", "sect", "page"):
                yield from _break(now, place, line)
            elif name in ("cell", "nestcell"):
                now.depth = 1 if name == "cell" else max(now.depth, 2)
                place().cells.append(place().cell())
                for deeper in [d for d in parts if d > now.depth]:
                    del parts[deeper]  # a table in the next cell is another one
            elif name == "row":
                yield from row(1)
            elif name == "nestrow":
                yield from row(max((d for d in opened if d > 1 and opened[d].cells), default=2))
    flush()
    now.depth = 0
    yield from line()


def _break(now: _Group, place, line):
    if now.depth:
        place().text.append(" ")
    else:
        yield from line()


def _known(codec: str) -> bool:
    try:
        b"".decode(codec)
        return True
    except LookupError:
        return False


def read_rows(files: DataFrame) -> DataFrame:
    """Lines and table rows of files(path, content): dialogue_id, ord, part, depth and cells, or an error."""

    def rows(batches):
        import pyarrow as pa

        kinds = pa.schema([("dialogue_id", pa.string()), ("ord", pa.int32()), ("part", pa.int32()), ("depth", pa.int32()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("color", pa.int32())]))), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, out = content.as_py() or b"", []
                if data.lstrip()[:5] != b"{\\rtf":
                    out.append({"dialogue_id": path, "error": "not RTF"})
                else:
                    for i, (part, depth, cells) in enumerate(parse(data)):
                        out.append({"dialogue_id": path, "ord": i, "part": part, "depth": depth, "cells": [{"text": t, "color": c} for t, c in cells]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return files.select("path", "content").mapInArrow(rows, ROWS)


#: What a header's cell may say of its column, lower-case.
HEADERS = {
    "speaker": ("говорящий", "спикер", "участник", "канал", "кто", "роль", "speaker", "role", "channel", "participant"),
    "text": ("текст", "реплика", "фраза", "речь", "text", "phrase", "utterance", "message"),
    "time": ("время", "начало", "time", "start", "timestamp", "offset"),
}
#: How a speaker's cell may begin, lower-case.
SPEAKERS = {CLIENT: ("клиент", "абонент", "client", "customer", "caller"), OPERATOR: ("сотрудник", "оператор", "operator", "agent", "employee")}
_CLOCK = r"^\s*\d{1,2}:\d{1,2}(:\d{1,2})?([.,]\d+)?\s*$"


def _column(head: Column, kind: str) -> Column:
    """The place (from 1) of the first column whose header names the kind, else 0."""
    return F.array_position(F.transform(head, lambda c: F.lower(F.trim(c["text"])).isin(*HEADERS[kind])), True)


def _speaker(text: Column, color: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    named = F.lit(None).cast("string")
    for who, starts in SPEAKERS.items():
        for s in starts:
            named = F.when(F.startswith(low, F.lit(s)), who).otherwise(named)
    return F.coalesce(named, F.when(color == 1, CLIENT).when(color == 2, OPERATOR), F.lit(UNKNOWN))


def typed_turns(rows: DataFrame) -> DataFrame:
    """Turns of table rows (read_rows), whatever the order of their columns.

    A table's first row is its header if it names the text's column and another one; it says where the
    speaker, the text and the time stand. Without a header a cell that is a clock time is the time, one that
    begins like a speaker the speaker, and the longest of the others the text. A speaker that is not named
    is told by the text's colour: 1 the client's, 2 the employee's. Rows without a text are no turns; outer
    rows that only hold a table have none of their own.
    """
    tables = rows.where("depth > 0").select("dialogue_id", "ord", "part", "cells")
    heads = tables.groupBy("dialogue_id", "part").agg(F.min_by("cells", "ord").alias("head"), F.min("ord").alias("first"))
    at = {k: _column(F.col("head"), k) for k in HEADERS}
    heads = heads.select("dialogue_id", "part", "first", *[c.alias(f"at_{k}") for k, c in at.items()])
    named = (F.col("at_text") > 0) & ((F.col("at_speaker") > 0) | (F.col("at_time") > 0))
    found = tables.join(heads.withColumn("named", named), ["dialogue_id", "part"]).where(~F.col("named") | (F.col("ord") > F.col("first")))
    cell = lambda k: F.when(F.col(f"at_{k}") > 0, F.try_element_at("cells", F.col(f"at_{k}").cast("int")))
    is_time = lambda c: F.regexp_like(c["text"], F.lit(_CLOCK))
    is_speaker = lambda c: (F.length(c["text"]) <= 40) & (_speaker(c["text"], F.lit(0)) != UNKNOWN)
    timed = F.get(F.filter("cells", is_time), F.lit(0))
    speaking = F.when(F.size("cells") > 1, F.get(F.filter("cells", is_speaker), F.lit(0)))
    others = F.filter("cells", lambda c: ~is_time(c) & (c["text"] != "") & ~c["text"].eqNullSafe(speaking["text"]))
    longest = F.array_max(F.transform(others, lambda c: F.struct(F.length(c["text"]).alias("n"), c.alias("cell"))))["cell"]
    pick = lambda k, other: F.when(F.col("named"), cell(k)).otherwise(other)
    turns = found.select("dialogue_id", "ord", pick("text", longest).alias("said"), pick("speaker", speaking).alias("who"), pick("time", timed).alias("at")).where("said.text <> ''")
    place = F.row_number().over(Window.partitionBy("dialogue_id").orderBy("ord"))
    return with_end_offsets(
        turns.select(
            "dialogue_id",
            (place - 1).cast("int").alias("turn_index"),
            _speaker(F.col("who.text"), F.col("said.color")).alias("speaker"),
            F.col("said.text").alias("text"),
            F.col("at.text").alias("timestamp"),
            X.clock_seconds(F.col("at.text")).alias("start_offset"),
        )
    )


def read_dialogues(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """(turns, rejected(dialogue_id, reason)) of all *.rtf files.

    A file's turns are the rows of its tables; one without such rows is read as lines of plain text.
    Larger files, those that are no RTF, those without a turn and those of no bytes are rejected, so every
    file is in one of both.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rtf").load(path)
    rows = written(read_rows(files.where(F.col("length") <= most_bytes)), "rtf-rows")
    typed = typed_turns(rows)
    bare = rows.where("depth = 0").join(typed.select("dialogue_id").distinct(), "dialogue_id", "left_anti")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.get("cells", F.lit(0))["text"].alias("t")))), lambda x: x["t"]), "\n")
    plain = from_plain_text(bare.groupBy("dialogue_id").agg(lines.alias("text")))
    turns = typed.unionByName(plain, allowMissingColumns=True)
    large = files.where(F.col("length") > most_bytes).select(F.col("path").alias("dialogue_id"), F.lit("too large").alias("reason"))
    other = rows.where("error is not null").select("dialogue_id", F.col("error").alias("reason"))
    known = large.unionByName(other)
    none = files.select(F.col("path").alias("dialogue_id")).join(turns.select("dialogue_id").union(known.select("dialogue_id")).distinct(), "dialogue_id", "left_anti")
    rejected = known.unionByName(none.withColumn("reason", F.lit("no turn")))
    return turns, with_empty(spark, path, ".rtf", rejected, "dialogue_id", "reason")
