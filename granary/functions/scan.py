"""An exact JSON scanner for Python workers: where and why a text fails, what it measures, which limit it breaks.

It keeps a list of open containers, so that nesting is bounded by memory only.  Tokens are taken by
regular expressions; a token that doesn't fit is looked at again, byte by byte, for the place and reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.policy import Limits

_SPACE = re.compile(r"[ \n\r\t]*")
_PLAIN = re.compile(r'[^"\\\x00-\x1f\ud800-\udfff]*')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_PART = re.compile(r"-?(?:(?:0|[1-9][0-9]*)(?:\.(?:[0-9]+(?:[eE][+-]?[0-9]*)?)?|[eE][+-]?[0-9]*)?)?")
_HEX = re.compile(r"[0-9a-fA-F]{0,4}")
_OPENS, _CLOSES = re.compile(r"\[+"), re.compile(r"\]+")
_AFTER = frozenset(" \n\r\t,]}")
_LITERALS = {"t": ("true", "boolean"), "f": ("false", "boolean"), "n": ("null", "null")}


@dataclass
class Report:
    """What a scan found.  Exactly one of ``valid``, ``reason`` and ``resource`` says how it ended.

    ``resource`` names the first limit that was broken.  For limits on one measurement ``observed`` and
    ``maximum`` are set, for limits on sums ``requested``, ``remaining`` and ``maximum``.  The counts are
    those of the events that were admitted.  ``duplicate`` says that an object repeats a key, and where the
    first such key begins; ``field_duplicate`` that one of the declared fields is repeated.
    """

    valid: bool = False
    reason: str | None = None
    offset: int | None = None
    line: int | None = None
    column: int | None = None
    resource: str | None = None
    observed: int | None = None
    maximum: int | None = None
    requested: int | None = None
    remaining: int | None = None
    root: str | None = None
    nodes: int = 0
    depth: int = 0
    max_items: int = 0
    max_entries: int = 0
    max_key_bytes: int = 0
    max_string_bytes: int = 0
    max_number_bytes: int = 0
    payload_bytes: int = 0
    keys: int = 0
    duplicate: bool = False
    duplicate_offset: int | None = None
    duplicate_line: int | None = None
    duplicate_column: int | None = None
    field_duplicate: bool = False


class Broken(Exception):
    """A limit was broken; what was measured isn't counted."""

    def __init__(self, resource: str, maximum: int, *, observed: int | None = None, requested: int | None = None, remaining: int | None = None):
        super().__init__(resource)
        self.found = {"resource": resource, "maximum": maximum, "observed": observed, "requested": requested, "remaining": remaining}


class Unfit(Exception):
    """The text isn't JSON, from the given character on."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


class Meter:
    """Counts admitted events against limits.  Limits on one measurement are looked at before limits on sums."""

    def __init__(self, limits: Limits, report: Report):
        self.limits, self.report = limits, report

    def _point(self, resource: str, observed: int) -> None:
        most = getattr(self.limits, resource)
        if most is not None and observed > most:
            raise Broken(resource, most, observed=observed)

    def _sum(self, resource: str, requested: int) -> None:
        most, used = getattr(self.limits, resource), getattr(self.report, resource)
        if most is not None and used + requested > most:
            raise Broken(resource, most, requested=requested, remaining=most - used)

    def value(self, depth: int, resource: str = "", size: int = 0) -> None:
        self._point("depth", depth)
        if resource:
            self._point(resource, size)
        self._sum("nodes", 1)
        if size and resource in ("string_bytes", "number_bytes"):
            self._sum("payload_bytes", size)
            self.report.payload_bytes += size
        r = self.report
        r.nodes += 1
        r.depth = max(r.depth, depth)
        if resource == "string_bytes":
            r.max_string_bytes = max(r.max_string_bytes, size)
        elif resource == "number_bytes":
            r.max_number_bytes = max(r.max_number_bytes, size)

    def arrays(self, depth: int, n: int) -> bool:
        """Admits ``n`` arrays, the first at ``depth``, each the first item of the one before; false, admitting none, if a limit may be broken."""
        most, r = self.limits, self.report
        if (most.depth is not None and depth + n > most.depth) or (most.nodes is not None and r.nodes + n > most.nodes) or (most.items is not None and most.items < 1):
            return False
        r.nodes += n
        r.depth = max(r.depth, depth + n - 1)
        r.max_items = max(r.max_items, 1)
        return True

    def key(self, size: int) -> None:
        self._point("key_bytes", size)
        self._sum("payload_bytes", size)
        r = self.report
        r.keys += 1
        r.payload_bytes += size
        r.max_key_bytes = max(r.max_key_bytes, size)

    def count(self, resource: str, n: int) -> None:
        self._point(resource, n)
        name = f"max_{resource}"
        if n > getattr(self.report, name):
            setattr(self.report, name, n)


def _string(text: str, at: int) -> tuple[str, int, int]:
    """The decoded text, its UTF-8 bytes, and the place after the string that begins at ``at``."""
    parts, i, n = [], at + 1, len(text)
    while True:
        m = _PLAIN.match(text, i)
        if m.end() > i:
            parts.append(m[0])
            i = m.end()
        c = text[i : i + 1]
        if c == '"':
            out = "".join(parts)
            return out, len(out.encode()) if not out.isascii() else len(out), i + 1
        if not c:
            raise Unfit("unexpected_end", n)
        if c != "\\":
            raise Unfit(_no_utf8(text, i) if "\ud800" <= c <= "\udfff" else "unexpected_byte", i)
        e = text[i + 1 : i + 2]
        if not e:
            raise Unfit("unexpected_end", n)
        if e != "u":
            if e not in '"\\/bfnrt':
                raise Unfit("invalid_escape", i + 1)
            parts.append({"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(e, e))
            i += 2
            continue
        unit, i = _unit(text, i + 2)
        if 0xDC00 <= unit <= 0xDFFF:
            raise Unfit("unpaired_surrogate", i)
        if 0xD800 <= unit <= 0xDBFF:
            if text[i : i + 2] != "\\u":
                raise Unfit("unexpected_end" if i >= n else "unpaired_surrogate", i)
            low, i = _unit(text, i + 2)
            if not 0xDC00 <= low <= 0xDFFF:
                raise Unfit("unpaired_surrogate", i)
            unit = 0x10000 + ((unit - 0xD800) << 10) + (low - 0xDC00)
        parts.append(chr(unit))


def _no_utf8(text: str, at: int) -> str:
    """Why the byte at ``at`` fails: the text ends before the character that it begins, or it is no UTF-8."""
    lead = ord(text[at]) - 0xDC00
    width = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
    return "invalid_utf8" if len(text[at : at + 4].encode("utf-8", "surrogateescape")) >= width else "unexpected_end"


def _unit(text: str, at: int) -> tuple[int, int]:
    m = _HEX.match(text, at)
    if len(m[0]) < 4:
        raise Unfit("unexpected_end" if m.end() >= len(text) else "invalid_unicode_escape", m.end())
    return int(m[0], 16), m.end()


def _number(text: str, at: int) -> int:
    """The place after the number that begins at ``at``."""
    m = _NUMBER.match(text, at)
    if m and (m.end() == len(text) or text[m.end()] in _AFTER):
        return m.end()
    # The longest start of a number shows where it stops being one.
    end = _PART.match(text, at).end()
    bare_sign = text[at:end] == "-"
    raise Unfit("unexpected_end" if bare_sign and end >= len(text) else "invalid_number", end)


Event = tuple  # (what, depth, index or key, kind, bytes or lexeme)


def events(text: str, meter: Meter, report: Report, above: int = 0, declared: frozenset[tuple] = frozenset(), runs: bool = False) -> Iterator[Event]:
    """Admits one document and yields its events: ("value", depth, place, kind, lexeme or None) and ("end", depth).

    ``above`` is how many containers a fragment stands in.  ``place`` is none for the root, an index in an array or a key in an object; it is given before a
    container's children.  ``declared`` holds paths of fields, with "*" for any index.  Raises Unfit or Broken.

    With ``runs``, for callers that pass over the events, arrays that open one right in the other are admitted
    at once, as one open container that stands for several, without an event of each; so are their ends.
    """
    open_: list[list] = []  # kind, count, keys seen, place, how many such containers
    level, runs = above, runs and not declared
    i, n = 0, len(text)
    place: int | str | None = None
    wants_value = True
    while True:
        i = _SPACE.match(text, i).end()
        c = text[i : i + 1]
        if wants_value:
            depth = level + 1
            if runs and c == "[" and text.startswith("[[", i):
                # All but the innermost have one item so far.
                n_open = _OPENS.match(text, i).end() - i - 1
                if meter.arrays(depth, n_open):
                    open_.append(["array", 1, None, place, n_open])
                    level += n_open
                    i, place, depth = i + n_open, 0, depth + n_open
            if c in ("{", "["):
                kind = "object" if c == "{" else "array"
                meter.value(depth)
                yield ("value", depth, place, kind, None)
                open_.append([kind, 0, set() if kind == "object" else None, place, 1])
                level = depth
                i = _SPACE.match(text, i + 1).end()
                c = text[i : i + 1]
                if c == ("}" if kind == "object" else "]"):
                    i += 1
                    open_.pop()
                    level -= 1
                    yield ("end", depth)
                    wants_value = False
                elif kind == "array":
                    open_[-1][1] = 1
                    meter.count("items", 1)
                    place = 0
                else:
                    i, place = _key(text, i, open_, meter, report, declared)
            else:
                if c == '"':
                    value, size, i = _string(text, i)
                    meter.value(depth, "string_bytes", size)
                    yield ("value", depth, place, "string", value)
                elif c == "-" or "0" <= c <= "9":
                    end = _number(text, i)
                    meter.value(depth, "number_bytes", end - i)
                    yield ("value", depth, place, "number", text[i:end])
                    i = end
                elif c in _LITERALS and c:
                    word, kind = _LITERALS[c]
                    if not text.startswith(word, i):
                        raise Unfit("unexpected_byte", i)
                    end = i + len(word)
                    if end < n and text[end] not in _AFTER:
                        raise Unfit("unexpected_byte", end)
                    meter.value(depth)
                    yield ("value", depth, place, kind, word)
                    i = end
                else:
                    raise Unfit("unexpected_byte" if c else "unexpected_end", i)
                wants_value = False
            continue
        if not open_:
            if c:
                raise Unfit("trailing_characters", i)
            return
        top = open_[-1]
        if c == ",":
            if top[4] > 1:
                # The innermost of several goes on by itself.
                top[4] -= 1
                top = [*top[:4], 1]
                open_.append(top)
            i = _SPACE.match(text, i + 1).end()
            if top[0] == "array":
                if text[i : i + 1] == "]":
                    raise Unfit("unexpected_byte", i)
                top[1] += 1
                meter.count("items", top[1])
                place = top[1] - 1
            else:
                if text[i : i + 1] == "}":
                    raise Unfit("unexpected_byte", i)
                i, place = _key(text, i, open_, meter, report, declared)
            wants_value = True
        elif c == ("]" if top[0] == "array" else "}"):
            n_closed = min(top[4], _CLOSES.match(text, i).end() - i) if top[4] > 1 else 1
            i += n_closed
            top[4] -= n_closed
            if not top[4]:
                open_.pop()
            level -= n_closed
            yield ("end", level + 1)
        else:
            raise Unfit(("expected_comma_or_array_end" if top[0] == "array" else "expected_comma_or_object_end") if c else "unexpected_end", i)


def _key(text: str, i: int, open_: list[list], meter: Meter, report: Report, declared: frozenset[tuple]) -> tuple[int, str]:
    """The place of the value after a key and colon, and the key."""
    top = open_[-1]
    if text[i : i + 1] != '"':
        raise Unfit("expected_object_key", i)
    top[1] += 1
    meter.count("entries", top[1])
    begin = i
    key, size, i = _string(text, i)
    meter.key(size)
    if key in top[2]:
        if not report.duplicate:
            report.duplicate = True
            report.duplicate_offset, report.duplicate_line, report.duplicate_column = position(text, begin)
        if declared:
            report.field_duplicate |= (*["*" if isinstance(x[3], int) else x[3] for x in open_[1:]], key) in declared
    top[2].add(key)
    i = _SPACE.match(text, i).end()
    if text[i : i + 1] != ":":
        raise Unfit("expected_colon" if i < len(text) else "unexpected_end", i)
    return i + 1, key


def position(text: str, at: int) -> tuple[int, int, int]:
    """Byte offset, line and column of a character; CR LF, CR and LF each end one line, columns count characters."""
    before = text[:at]
    lines = re.split(r"\r\n|\r|\n", before)
    return len(before.encode("utf-8", "surrogateescape")), len(lines), len(lines[-1]) + 1


def scan(text: str | bytes, limits: Limits = Limits(), above: int = 0, declared: frozenset[tuple] = frozenset()) -> Report:
    """What there is to say about one document, or about a fragment in ``above`` containers.

    Bytes may be no UTF-8; where they aren't, the text fails.
    """
    if isinstance(text, bytes):
        text = text.decode("utf-8", "surrogateescape")
    report = Report()
    first = text.lstrip(" \n\r\t")[:1]
    report.root = {"{": "object", "[": "array"}.get(first, "other")
    try:
        for _ in events(text, Meter(limits, report), report, above, declared, runs=True):
            pass
        report.valid = True
    except Unfit as e:
        report.reason = e.reason
        report.offset, report.line, report.column = position(text, e.at)
    except Broken as e:
        for k, v in e.found.items():
            setattr(report, k, v)
    return report


_FIELDS = [("valid", pa.bool_()), ("reason", pa.string()), *[(k, pa.int64()) for k in ("offset", "line", "column")], ("resource", pa.string()), *[(k, pa.int64()) for k in ("observed", "maximum", "requested", "remaining")], ("root", pa.string()), *[(k, pa.int64()) for k in ("nodes", "depth", "max_items", "max_entries", "max_key_bytes", "max_string_bytes", "max_number_bytes", "payload_bytes", "keys")], ("duplicate", pa.bool_()), *[(k, pa.int64()) for k in ("duplicate_offset", "duplicate_line", "duplicate_column")], ("field_duplicate", pa.bool_())]
REPORT = ", ".join(f"{k}: {'boolean' if t == pa.bool_() else 'string' if t == pa.string() else 'bigint'}" for k, t in _FIELDS)


def reports(found: list[Report | None]) -> pa.Array:
    """Reports as one struct column, made field by field."""
    none = pa.array([r is None for r in found], pa.bool_())
    fields = [pa.array([None if r is None else getattr(r, k) for r in found], t) for k, t in _FIELDS]
    return pa.StructArray.from_arrays(fields, fields=[pa.field(k, t) for k, t in _FIELDS], mask=none)


def distinct(column: pa.Array) -> tuple[list, pa.Array]:
    """The different values of a batch's column, null first, and which one stands at each place."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    return [None, *coded.dictionary.to_pylist()], pa.array(coded.indices.fill_null(-1).to_numpy() + 1)


def scan_column(text: Column, limits: Limits = Limits(), above: int = 0, declared: frozenset[tuple] = frozenset()) -> Column:
    """A struct like Report for each text or binary value; null for null.  Equal texts of a batch are scanned once.

    Spark doesn't move filters to before this column, as it would then scan once for the filter and once
    for the column.  Filters on other columns should come before it.
    """

    @F.arrow_udf(f"struct<{REPORT}>")
    def run(column: pa.Array) -> pa.Array:
        texts, at = distinct(column)
        return reports([None if t is None else scan(t, limits, above, declared) for t in texts]).take(at)

    return run.asNondeterministic()(text)


def with_scan(df: DataFrame, column: str, out: str = "scan", limits: Limits = Limits()) -> DataFrame:
    """``df`` with the scan of a column."""
    return df.withColumn(out, scan_column(F.col(f"`{column}`"), limits))


def failure_text(report: Column) -> Column:
    """Why and where a scan failed, in words; null where it didn't."""
    reason = F.replace(report["reason"], F.lit("_"), F.lit(" "))
    return F.when(report["reason"].isNotNull(), F.format_string("%s at line %d column %d (byte offset %d)", reason, report["line"], report["column"], report["offset"]))


def utf8_failure(data: bytes) -> tuple[int, int | None] | None:
    """How many bytes are sound, and how many after them are not: none of the latter if the data ends too early."""
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return e.start, None if e.reason == "unexpected end of data" else e.end - e.start
    return None


def utf8_failure_column(data: Column) -> Column:
    """(valid_up_to, error_len) of bytes that are no UTF-8; null for sound ones."""

    @F.arrow_udf("struct<valid_up_to: bigint, error_len: bigint>")
    def run(column: pa.Array) -> pa.Array:
        found = [None if (b := x.as_py()) is None else utf8_failure(b) for x in column]
        return pa.array([f and {"valid_up_to": f[0], "error_len": f[1]} for f in found], pa.struct([("valid_up_to", pa.int64()), ("error_len", pa.int64())]))

    return run.asNondeterministic()(data)
