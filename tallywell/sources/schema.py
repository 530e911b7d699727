"""Schema strings for CSV files: ``name:type.transform,...``, or types alone."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.errors import ParseError

#: The spellings of the types, and the transforms.
TYPES = {
    "integer": "int", "int": "int", "i": "int",
    "ninteger": "nint", "nint": "nint", "ni": "nint",
    "string": "str", "s": "str",
    "nstring": "nstr", "ns": "nstr",
    "": "drop",
}
TRANSFORMS = ("", "100", "1000", "date")


@dataclass(frozen=True)
class ColumnSchema:
    """``kind`` is int, str or drop."""

    kind: str
    nullable: bool = False
    transform: str = ""


@dataclass(frozen=True)
class CsvSchema:
    columns: tuple[ColumnSchema, ...]
    names: tuple[str, ...] | None = None

    @classmethod
    def parse(cls, text: str) -> CsvSchema:
        """Either all columns have names or none has."""
        names, columns = [], []
        for part in text.split(","):
            name, colon, kind = part.rpartition(":")
            if ":" in name:
                raise ParseError(f"more than one : in {part!r}")
            if colon:
                names.append(name)
            kind, _, transform = kind.partition(".")
            if kind not in TYPES or "." in transform:
                raise ParseError(f"{part!r} has no type that is known")
            known = TYPES[kind]
            columns.append(ColumnSchema(known.lstrip("n") if known in ("nint", "nstr") else known, known in ("nint", "nstr"), transform if transform in TRANSFORMS else ""))
        if names and len(names) != len(columns):
            raise ParseError("either all columns have names or none has")
        return cls(tuple(columns), tuple(names) or None)
