"""Repair of text around and inside JSON, as Column expressions.

Nothing here calls Python for a row.  Each repair first asks by a cheap test whether it has anything to
do, and rewrites only then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.policy import Policy

#: Unicode's White_Space characters; the byte order mark isn't one.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BOM = "\ufeff"
#: Short escapes of control characters; all others are written with four hexadecimal digits.
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
ESCAPES = {chr(c): _SHORT.get(c, f"\\u{c:04x}") for c in range(0x20)}


def free(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in either case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called by number, for functions over batches, which can't be given names with dots."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(text, F.lit(WHITE))


def strip_bom(text: Column) -> Column:
    """Without one leading byte order mark."""
    return F.when(F.startswith(text, F.lit(BOM)), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


_OPENING = r"^( {0,3})(`{3,}+|~{3,}+)([^\r\n]*+)(\r\n|\r|\n)"


def _body_of(content: Column, run: Column, required: bool, unchanged: Column) -> Column:
    """The content before a closing fence that fits the opening ``run``."""

    def with_trimmed(trimmed: Column) -> Column:
        last = F.substring_index(F.translate(trimmed, "\r", "\n"), "\n", -1)

        def with_last(line: Column) -> Column:
            marks = F.ltrim(line, F.lit(" "))
            closes = line.rlike("^ {0,3}(?:`{3,}+|~{3,}+)$") & (F.left(marks, F.lit(1)) == F.left(run, F.lit(1))) & (F.length(marks) >= F.length(run)) & ~line.rlike("\n$")
            return F.when(closes, F.left(trimmed, F.length(trimmed) - F.length(line))).otherwise(unchanged if required else content)

        return let(last, with_last)

    return let(F.rtrim(content, F.lit(" \t\n\r")), with_trimmed)


def strip_fence(text: Column, policy: Policy) -> Column:
    """The body of one outer Markdown fence, if the policy accepts it; else the text as it is.

    A fence opens with up to three spaces and three or more equal marks, and needs a line break after its
    label.  It closes with a last line of up to three spaces and as many of the same marks, or more;
    spaces, tabs and line breaks after that line don't count.
    """
    if policy.fence == "disabled":
        return text

    def opened(t: Column) -> Column:
        head = lambda i: F.regexp_extract(t, _OPENING, i)
        size = F.length(head(0))
        content = F.substring(t, size + 1, F.length(t))
        body = let(content, lambda c: _body_of(c, head(2), policy.closing == "required", t))
        if policy.fence == "json":
            label = F.lower(F.split(trim(head(3)), f"[{WHITE}]+", 2)[0])
            ascii_label = F.split(trim(head(3)), f"[{WHITE}]+", 2)[0]
            body = F.when(label.isin("", "json", "jsonc") & (F.octet_length(ascii_label) == F.octet_length(label)), body).otherwise(t)
        return F.when(size > 0, body).otherwise(t)

    return F.when(text.rlike("^ {0,3}[`~]"), let(text, opened)).otherwise(text)


def escape_each(text: Column) -> Column:
    """Every control character as its escape."""
    common = text
    for c in "\n\t\r":
        common = F.replace(common, F.lit(c), F.lit(ESCAPES[c]))
    every = common
    for c, e in ESCAPES.items():
        if c not in "\n\t\r":
            every = F.replace(every, F.lit(c), F.lit(e))
    return F.when(text.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"), every).otherwise(common)


def escape_controls(text: Column) -> Column:
    """Raw control characters inside strings as escapes; outside they stay.

    After an unmatched backslash the backslash already there is used.  A string may lack its end.
    """
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]|\\.)*+\\?"?|[^"]++'), F.lit(0))

    def piece(p: Column) -> Column:
        # A backslash before a control character goes, and comes back with the escape.
        bare = F.regexp_replace(p, r"(?s)(\\[^\x00-\x1f])|\\(?=[\x00-\x1f])", "$1")
        return F.when(F.startswith(p, F.lit('"')) & p.rlike("[\\x00-\\x1f]"), let(bare, escape_each)).otherwise(p)

    return F.when(text.rlike("[\\x00-\\x1f]") & F.contains(text, F.lit('"')), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def unwrapped(text: Column, policy: Policy) -> Column:
    """White space, mark and fence taken off, before controls are escaped."""
    steps: list[Callable[[Column], Column]] = []
    if policy.trim:
        steps.append(trim)
    if policy.strip_bom:
        steps += [strip_bom, *([trim] if policy.trim else [])]
    if policy.fence != "disabled":
        steps += [lambda t: strip_fence(t, policy), *([trim] if policy.trim else [])]
    out = text
    for step in steps:
        out = let(out, step)
    if policy.trim and len(steps) > 1:
        # Most texts begin with neither mark nor fence, and only white space comes off.
        return F.when(text.rlike(f"^[{WHITE}]*+[{BOM}`~]"), out).otherwise(trim(text))
    return out


def normalize(text: Column, policy: Policy | None = None) -> Column:
    """``text`` as the policy repairs it; null stays null."""
    policy = policy or Policy.lenient()
    out = unwrapped(text, policy)
    return let(out, escape_controls) if policy.escape_controls else out
