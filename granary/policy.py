"""What callers choose: how input is repaired, and which limits hold."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

FENCES = ("disabled", "any", "json")
CLOSINGS = ("optional", "required")


@dataclass(frozen=True)
class Policy:
    """How a text is made ready for the JSON grammar.  Missing syntax is never guessed.

    ``fence``: which outer Markdown fence is taken off: none, any, or one labelled nothing, json or jsonc.
    ``closing``: whether a fence must be closed to count.  ``detailed`` lets error messages carry sizes of
    the input beside the kind; texts of the input never appear in them.
    """

    trim: bool = True
    strip_bom: bool = True
    fence: str = "json"
    closing: str = "optional"
    escape_controls: bool = True
    detailed: bool = False

    def __post_init__(self) -> None:
        if self.fence not in FENCES or self.closing not in CLOSINGS:
            raise ValueError(f"fence is one of {FENCES}, closing one of {CLOSINGS}")

    @classmethod
    def lenient(cls) -> Policy:
        """Every repair, fences labelled as JSON or not at all; the default."""
        return cls()

    @classmethod
    def strict(cls) -> Policy:
        """No rewriting."""
        return cls(trim=False, strip_bom=False, fence="disabled", escape_controls=False)

    def but(self, **changes) -> Policy:
        """A copy with some choices changed."""
        return replace(self, **changes)


#: Limits on single measurements, and limits on sums.
POINT = ("depth", "items", "entries", "key_bytes", "string_bytes", "number_bytes")
CUMULATIVE = ("nodes", "payload_bytes", "input_bytes", "normalized_bytes", "output_bytes")


@dataclass(frozen=True)
class Limits:
    """Largest allowed values; none is no limit.

    Depth counts the root and scalars too, so that ``[null]`` has depth 2.  Key and string bytes are
    those of the decoded text in UTF-8, number bytes those of the number as written.  Payload is the sum
    of the three; nodes are values, not keys.  The bytes of input, repaired input and output are limits of
    one document here and of all documents together in a session.
    """

    depth: int | None = None
    items: int | None = None
    entries: int | None = None
    key_bytes: int | None = None
    string_bytes: int | None = None
    number_bytes: int | None = None
    nodes: int | None = None
    payload_bytes: int | None = None
    input_bytes: int | None = None
    normalized_bytes: int | None = None
    output_bytes: int | None = None

    @classmethod
    def unlimited(cls) -> Limits:
        return cls()

    @property
    def set(self) -> dict[str, int]:
        """The limits that are configured."""
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    @property
    def of_values(self) -> bool:
        """True if anything about the parsed value is limited."""
        return any(k in self.set for k in (*POINT, "nodes", "payload_bytes"))
