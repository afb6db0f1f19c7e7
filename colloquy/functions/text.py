"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[а-яёa-z0-9]+"

#: Verb pairs that differ only in aspect (fixed values).
ASPECT_PAIRS = (
    ("переключить", "переключать"),
    ("переключаться", "переключить"),
    ("переключиться", "переключать"),
    ("перейти", "переходить"),
    ("уйти", "уходить"),
    ("сменить", "сменять"),
    ("поменять", "менять"),
    ("отказаться", "отказываться"),
    ("расторгнуть", "расторгать"),
    ("отключить", "отключать"),
    ("отключиться", "отключаться"),
    ("подключить", "подключать"),
    ("подключиться", "подключаться"),
    ("переехать", "переезжать"),
    ("перебраться", "перебираться"),
    ("отвергнуть", "отвергать"),
    ("забрать", "забирать"),
    ("переместить", "перемещать"),
    ("перенести", "переносить"),
    ("передать", "передавать"),
    ("разорвать", "разрывать"),
    ("закрыть", "закрывать"),
    ("остановить", "останавливать"),
    ("прекратить", "прекращать"),
    ("закончить", "заканчивать"),
    ("завершить", "завершать"),
    ("продолжить", "продолжать"),
    ("изменить", "изменять"),
    ("заменить", "заменять"),
    ("отменить", "отменять"),
    ("перевести", "переводить"),
    ("перевестись", "переводиться"),
    ("перевернуть", "переворачивать"),
    ("приостановить", "приостанавливать"),
    ("возобновить", "возобновлять"),
    ("восстановить", "восстанавливать"),
    ("купить", "покупать"),
    ("продлить", "продлевать"),
    ("оформить", "оформлять"),
    ("подписать", "подписывать"),
    ("оплатить", "оплачивать"),
    ("заплатить", "платить"),
    ("вернуть", "возвращать"),
    ("вернуться", "возвращаться"),
    ("перезвонить", "перезванивать"),
    ("связать", "связывать"),
    ("связаться", "связываться"),
    ("решить", "решать"),
    ("разобраться", "разбираться"),
    ("разобрать", "разбирать"),
    ("обсудить", "обсуждать"),
    ("рассмотреть", "рассматривать"),
    ("предложить", "предлагать"),
    ("помочь", "помогать"),
)


def aspect_keys() -> dict[str, str]:
    """Lemma -> the key that it shares with its aspect partners."""
    keys: dict[str, str] = {}
    for a, b in ASPECT_PAIRS:
        key = keys.get(a) or keys.get(b) or f"aspect:{a}"
        keys[a] = keys[b] = key
    return keys


def tokens(text: Column) -> Column:
    """Tokens of the lower-cased text; null is empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_gaps(text: Column) -> Column:
    """Of each token of the lower-cased text struct(gap, step): the characters since the token before, and with its own."""
    gaps, toks = F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN, -1), tokens(text)
    return F.zip_with(F.slice(gaps, 1, F.size(toks)), toks, lambda g, t: F.struct(F.length(g).alias("gap"), (F.length(g) + F.length(t)).alias("step")))


def token_start(gaps: Column, k: Column) -> Column:
    """Where the k-th token (from 0) begins, from 0: what comes before it is summed up."""
    return F.aggregate(F.slice(gaps, 1, k), F.get(gaps, k)["gap"], lambda a, x: a + x["step"])


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def sanitize(text: Column, limit: int = 5000) -> Column:
    """Without control characters, cut to the limit."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), 1, limit)


def snippet(text: Column, limit: int = 240) -> Column:
    """The first characters with an ellipsis where something is cut."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…")))


def source_snippet(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def normalize_phrase(phrase: Column) -> Column:
    """Trimmed, without one pair of quotes around it, lower-case, single spaces."""
    t = F.trim(F.regexp_replace(F.coalesce(phrase, F.lit("")), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(t, r"""^(?:"([\s\S]*)"|«([\s\S]*)»|'([\s\S]*)')$""", "$1$2$3")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\s+", " "))


def strip_code_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def last_json(text: Column) -> Column:
    """The last valid JSON object (braces nested once at most) in noisy text, else the whole text if valid."""
    found = F.regexp_extract_all(strip_code_fence(text), F.lit(r"\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0))
    good = F.filter(found, lambda j: F.try_parse_json(j).isNotNull())
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.when(F.try_parse_json(text).isNotNull(), text))


def clock_seconds(stamp: Column) -> Column:
    """Seconds of `H:MM:SS`, `MM:SS` or bare seconds; a clock's fraction is dropped; null if malformed or over 59."""
    t = F.trim(F.regexp_replace(stamp, ",", "."))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i).try_cast("double")
    hms, ms = r"^(\d+):(\d{1,2}):(\d{1,2})(?:\.\d+)?$", r"^(\d+):(\d{1,2})(?:\.\d+)?$"
    ok = lambda c: c <= 59
    return (
        F.when(F.regexp_like(t, F.lit(hms)), F.when(ok(part(hms, 2)) & ok(part(hms, 3)), part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3)))
        .when(F.regexp_like(t, F.lit(ms)), F.when(ok(part(ms, 1)) & ok(part(ms, 2)), part(ms, 1) * 60 + part(ms, 2)))
        .when(F.regexp_like(t, F.lit(r"^\d+(?:\.\d+)?$")), t.try_cast("double"))
    )


def timespan_seconds(span: Column) -> Column:
    """Seconds of `d.hh:mm:ss.fffffff`; null for the sentinel of a million days or more."""
    pattern = r"^(?:(\d+)\.)?(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d+))?$"
    part = lambda i: F.coalesce(F.regexp_extract(span, pattern, i).try_cast("double"), F.lit(0.0))
    days = part(1)
    fraction = F.coalesce(F.concat(F.lit("0."), F.regexp_extract(span, pattern, 5)).try_cast("double"), F.lit(0.0))
    return F.when(F.regexp_like(span, F.lit(pattern)) & (days < 1_000_000), days * 86400 + part(2) * 3600 + part(3) * 60 + part(4) + fraction)


def humanize_seconds(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    two = lambda a, an, b, bn: F.when(b == 0, F.concat_ws(" ", a, F.lit(an))).otherwise(F.concat_ws(" ", a, F.lit(an), b, F.lit(bn)))
    return F.when(s < 60, F.concat_ws(" ", s, F.lit("сек"))).when(s < 3600, two(F.floor(s / 60), "мин", s % 60, "сек")).otherwise(two(F.floor(s / 3600), "ч", F.floor(s % 3600 / 60), "мин"))


def digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"\D", ""), ""), lambda d: d != ""), lambda d: d.cast("int"))


def _weighted(d: Column, weights: list[int]) -> Column:
    return sum((F.get(d, F.lit(i)) * w for i, w in enumerate(weights)), F.lit(0))


def inn_valid(text: Column) -> Column:
    """Check digits of 10- and 12-digit taxpayer numbers."""
    d = digits(text)
    check = lambda w: _weighted(d, w) % 11 % 10
    ten = check([2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(d, F.lit(9))
    twelve = (check([7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(d, F.lit(10))) & (check([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == F.get(d, F.lit(11)))
    return F.coalesce(F.when(F.size(d) == 10, ten).when(F.size(d) == 12, twelve), F.lit(False))


def snils_valid(text: Column) -> Column:
    """Check number of 11-digit insurance numbers."""
    d = digits(text)
    total = _weighted(d, list(range(9, 0, -1)))
    total = F.when(total > 101, total % 101).otherwise(total)
    total = F.when(total == 100, 0).otherwise(total)
    return F.coalesce((F.size(d) == 11) & (total == F.get(d, F.lit(9)) * 10 + F.get(d, F.lit(10))), F.lit(False))


def luhn_valid(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    return (F.length(bare) > 0) & F.call_function("luhn_check", bare)


def longest_line_run(text: Column) -> Column:
    """The longest run of equal non-blank lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"), F.lit("").alias("last"))

    def step(a, x):
        now = F.when(a["last"] == x, a["now"] + 1).otherwise(F.lit(1))
        return F.struct(F.greatest(a["best"], now).alias("best"), now.alias("now"), x.alias("last"))

    return F.aggregate(lines, start, step, lambda a: a["best"])


def occurrences(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("int")


def repeats_itself(text: Column, run: int = 5, probe: int = 50, least: int = 200) -> Column:
    """Whether generated text has come into a loop: equal lines in a row, or a probe that recurs."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - probe + 1, F.lit(1)), F.lit(probe))
    again = F.exists(at, lambda i: occurrences(text, F.substring(text, i, F.lit(probe))) >= run)
    return F.coalesce((F.length(text) >= least) & ((longest_line_run(text) >= run) | again), F.lit(False))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def one_of(value: Column, synonyms: dict[str, str], default: str) -> Column:
    """A closed vocabulary's value for a trimmed lower-case synonym, else the default."""
    v = F.lower(F.trim(value))
    out = F.lit(default)
    for target in sorted(set(synonyms.values())):
        out = F.when(v.isin([s for s, t in synonyms.items() if t == target]), target).otherwise(out)
    return out


#: Names of the three confidence labels in two languages (fixed values).
CONFIDENCE = {
    "relevant": "relevant", "релевантен": "relevant", "релевантно": "relevant", "релевантный": "relevant",
    "irrelevant": "irrelevant", "нерелевантен": "irrelevant", "нерелевантно": "irrelevant", "нерелевантный": "irrelevant", "not relevant": "irrelevant",
    "uncertain": "uncertain", "частично": "uncertain", "partial": "uncertain", "partially": "uncertain", "не уверен": "uncertain", "неуверенно": "uncertain",
}


# ---------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different length or zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- names, templates, stamps, model answers


def clean_file_name(name: Column) -> Column:
    """Without folders and `..`; null if nothing is left or a character is no letter, digit, space, `_`, `.` or `-`."""
    base = F.replace(F.regexp_extract(name, r"([^/\\]*)$", 1), F.lit(".."), F.lit(""))
    return F.when((F.trim(base) != "") & F.regexp_like(base, F.lit(r"^[\p{L}\p{N}_\s.\-]+$")), base)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Every `{name}` replaced by its value; braces of anything else stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def iso_stamp(ts: Column) -> Column:
    """A UTC time with seven digits of its second's fraction."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def canonical_stamp(text: Column) -> Column:
    """ISO-8601 text with seven digits of fraction; one with a fraction and Z stays, as does what cannot be read."""
    t = F.trim(text)
    parsed = F.try_to_timestamp(F.regexp_replace(t, "Z$", ""))
    return F.when(F.regexp_like(t, F.lit(r"\..*Z$")), t).otherwise(F.coalesce(iso_stamp(parsed), text))


def outer_object(text: Column) -> Column:
    """The first `{...}` whose braces balance, of any depth, braces in strings not counted; null without one."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    begin = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\{[\s\S]*)$", 1)
    parts = F.regexp_extract_all(begin, F.lit(r'[{}"\\]|[^{}"\\]+'), F.lit(0))

    def step(a, x):
        mark = ~a["escaped"] & (x == '"')
        depth = a["depth"] + F.when(a["quoted"] | a["done"], 0).when(x == "{", 1).when(x == "}", -1).otherwise(0)
        escaped = a["quoted"] & ~a["escaped"] & (x == "\\")
        n = F.when(a["done"], a["n"]).otherwise(a["n"] + F.length(x))
        return F.struct(depth.alias("depth"), F.when(mark, ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"), escaped.alias("escaped"), n.alias("n"), (a["done"] | ((depth == 0) & (x == "}") & ~a["quoted"])).alias("done"))

    taken = F.aggregate(parts, zero, step, lambda a: F.when(a["done"], a["n"]))
    return F.when(taken.isNotNull(), F.substring(begin, F.lit(1), taken))


def summary_or_raw(text: Column, limit: int = 500) -> Column:
    """The field `summary` of the flat object in a model's answer, else the answer's first characters."""
    return F.coalesce(F.get_json_object(F.regexp_extract(text, r"(\{[^{}]*\})", 1), "$.summary"), F.substring(text, 1, limit))


def coerced_list(raw: Column, separator: str = ",") -> Column:
    """A JSON list of texts; a bare or quoted text becomes its parts; blanks go; null or anything else is an empty list."""
    listed = F.from_json(raw, "array<string>")
    bare = F.split(F.regexp_replace(F.trim(raw), r'^"|"$', ""), separator)
    out = F.when(F.regexp_like(raw, F.lit(r"^\s*\[")), listed).when(~F.regexp_like(raw, F.lit(r"^\s*\{")), bare)
    return F.filter(F.transform(F.coalesce(out, F.expr("cast(array() as array<string>)")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def checked_value(value: Column, synonyms: dict[str, str], default: str) -> Column:
    """struct(value, reason) of a field of a model's answer: reason missing, wrong_type, invalid_value or null."""
    known = one_of(value, synonyms, "\x00")
    reason = F.when(value.isNull(), "missing").when(F.regexp_like(F.trim(value), F.lit(r"^[\[{]|^-?\d+(\.\d+)?$")), "wrong_type").when(known == "\x00", "invalid_value")
    return F.struct(F.when(reason.isNull(), known).otherwise(default).alias("value"), reason.alias("reason"))


#: Names of call directions and comparisons (fixed values).
DIRECTIONS = {"PhoneCallDirectionIngoing": "Входящий", "PhoneCallDirectionOutgoing": "Исходящий", "PhoneCallDirectionInternal": "Внутренний"}
COMPARISONS = {"NotStartsWith": "Номер не начинается с", "StartsWith": "Номер начинается с", "Equals": "Номер =", "Contains": "Номер содержит"}


def _named(value: Column, names: dict[str, str]) -> Column:
    out = value
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _whole_unit(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    hours = (seconds % 3600 == 0) & (seconds >= 3600)
    return F.when(seconds < 60, F.concat_ws(" ", seconds.cast("int"), F.lit("сек"))).when(hours, F.concat_ws(" ", F.floor(seconds / 3600), F.lit("ч"))).otherwise(F.concat_ws(" ", minutes, F.lit("мин")))


def decoded_attribute(key: Column, value: Column) -> Column:
    """A dictionary attribute in words: duration, direction, remote number, server list; others as they are."""
    low, high = (F.trim(F.get(F.split(value, ";"), F.lit(i))) for i in (0, 1))
    at_least = F.floor(F.coalesce(timespan_seconds(low), F.lit(0.0)))
    at_most = F.floor(timespan_seconds(high))
    span = F.when(at_most.isNull(), F.concat_ws(" ", F.lit("Длительность >="), _whole_unit(at_least))).otherwise(F.concat_ws(" ", F.lit("Длительность"), _whole_unit(at_least), F.lit("—"), _whole_unit(at_most)))
    piped = F.contains(value, F.lit("|"))
    operator = F.when(piped, F.substring_index(value, "|", 1)).otherwise("Equals")
    rest = F.when(piped, F.regexp_extract(value, r"^[^|]*\|([\s\S]*)$", 1)).otherwise(value)
    servers = F.size(F.filter(F.split(rest, ","), lambda x: F.trim(x) != ""))
    return (
        F.when(key == "Duration", span)
        .when(key == "CallDirection", F.concat_ws(" ", F.lit("Направление:"), _named(value, DIRECTIONS)))
        .when(key == "RemotePhoneNumber", F.concat_ws(" ", _named(operator, COMPARISONS), rest))
        .when(key == "UserDef5", F.concat(F.lit("SIP-сервер из списка ("), servers, F.lit(" шт.)")))
        .otherwise(F.concat_ws(" = ", key, value))
    )
