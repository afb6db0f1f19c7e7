"""RTF: nested groups, code pages, tables in tables, columns told by headers, content or colour."""

import pytest

from colloquy.schemas import CLIENT as C
from colloquy.schemas import OPERATOR as O
from colloquy.schemas import UNKNOWN as U
from colloquy.sources import rtf


def read(text: str):
    return [(depth, [t for t, _ in cells]) for _, depth, cells in rtf.parse(text.encode("latin-1"))]


def test_groups_escapes_and_code_pages():
    head = r"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0\fcharset204 Arial;}{\f1\fcharset238 Arial {\*\falt x};}{\f2\fcharset0 A;}}{\colortbl;\red1;}{\info{\author {a}b}}"
    assert read(head + r"a{b{c{\*\x hid{d}en}}d}\par {\pict 00ff}e\'ed\f1\'b3\f0\'ed}") == [(0, ["abcd"]), (0, ["eнłн"])]
    assert read(r"{\rtf1 \u1076?\u1072\'3f {\uc0\u1076 x}{\uc2\u1076??y}\{\}\\\~z\emdash}") == [(0, ["да дxдy{}\\ z—"])]
    assert read(r"{\rtf1 one\line two\par\par three {\bin5 {{{{{x}four}") == [(0, ["one"]), (0, ["two"]), (0, ["three xfour"])]
    assert read("{\\rtf1 a\r\nb{\\field{\\*\\fldinst HYPERLINK}{\\fldrslt link}}}}} c") == [(0, ["ablink c"])]
    assert read(r"{\rtf1 never {closed \b bold") == [(0, ["never closed bold"])]


def row(*cells):
    return r"\trowd\cellx1" + "".join(rf"\pard\intbl {c}\cell " for c in cells) + r"\row "


def test_tables_in_tables():
    inner = r"\pard\intbl\itap2 in one\nestcell in two\nestcell{\*\nesttableprops\trowd\nestrow}{\nonesttables\par}"
    again = r"\pard\intbl\itap2 in three\nestcell in four\nestcell{\*\nesttableprops\trowd\nestrow}{\nonesttables\par}"
    text = r"{\rtf1 before\par \trowd " + inner + again + r"\pard\intbl\itap1 own\cell \pard\intbl\itap1 last\cell\row \pard after\par " + row("x", "y") + "}"
    assert read(text) == [(0, ["before"]), (2, ["in one", "in two"]), (2, ["in three", "in four"]), (1, ["own", "last"]), (0, ["after"]), (1, ["x", "y"])]
    parts = [p for p, _, _ in rtf.parse(text.encode())]
    assert parts[1] == parts[2] and len({parts[0], parts[1], parts[3], parts[4], parts[5]}) == 5


RU = lambda t: "".join(rf"\u{ord(c)}?" if ord(c) > 127 else c for c in t)


def test_typed_turns(spark, tmp_path):
    write = lambda name, body: (tmp_path / f"{name}.rtf").write_bytes((r"{\rtf1\ansi\ansicpg1251{\colortbl;\red1;\red2;}" + body + "}").encode("latin-1"))
    write("headers", r"Call 7\par " + row(RU("Время"), RU("Реплика"), RU("Говорящий")) + row("0:00:01", "hello there", RU("Оператор 1")) + row("0:01:05", "Operator, please", RU("Клиент")) + row("", "", ""))
    write("content", row(RU("Клиент"), "what is it", "0:00:02") + row("0:00:09", "it is {nested {text}} of mine", "agent"))
    write("colours", row(r"{\cf1 red} words", "0:00:03") + row(r"{\cf2 blue words}", "0:00:04") + row("no colour", "12:99"))
    write("lines", RU("Клиент: да") + r"\par " + RU("Сотрудник: нет"))
    write("nested", r"\trowd " + r"\pard\intbl\itap2 Text\nestcell Time\nestcell{\*\nesttableprops\trowd\nestrow}\pard\intbl\itap2 inside\nestcell 00:07\nestcell{\*\nesttableprops\trowd\nestrow}\pard\intbl\itap1\cell\row ")
    write("empty", "")
    (tmp_path / "other.rtf").write_bytes(b"PK not rtf")
    (tmp_path / "zero.rtf").write_bytes(b"")
    (tmp_path / "zero.txt").write_bytes(b"")
    (tmp_path / "big.rtf").write_bytes(b"{\\rtf1 " + b"x" * 5000 + b"}")
    turns, rejected = rtf.read_dialogues(spark, str(tmp_path), 4000)
    got: dict = {}
    for r in turns.orderBy("dialogue_id", "turn_index").collect():
        got.setdefault(r["dialogue_id"].rpartition("/")[2][:-4], []).append((r["speaker"], r["text"], r["start_offset"], r["end_offset"]))
    assert got == {
        "headers": [(O, "hello there", 1.0, 65.0), (C, "Operator, please", 65.0, 65.0)],
        "content": [(C, "what is it", 2.0, 9.0), (O, "it is nested text of mine", 9.0, 9.0)],
        "colours": [(U, "red words", 3.0, 4.0), (O, "blue words", 4.0, 4.0), (U, "no colour", None, None)],
        "lines": [(C, "да", None, None), (O, "нет", None, None)],
        "nested": [(U, "inside", 7.0, 7.0)],
    }
    assert {r["dialogue_id"].rpartition("/")[2]: r["reason"] for r in rejected.collect()} == {"empty.rtf": "no turn", "other.rtf": "not RTF", "big.rtf": "too large", "zero.rtf": "empty"}


@pytest.mark.parametrize("n", [200_000])
def test_large_files_take_time_in_proportion(n):
    text = r"{\rtf1 " + "".join(rf"{{\b w{i}}} \'ed\par " for i in range(n)) + "}"
    assert sum(1 for _ in rtf.parse(text.encode())) == n
