"""What a query asks for: labels, relations, structures and decisions, checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Label:
    name: str
    description: str = ""


@dataclass(frozen=True)
class Relation:
    name: str
    description: str = ""
    fields: tuple[str, ...] = ("head", "tail")

    def __post_init__(self):
        if not self.fields:
            raise ValueError(f"relation {self.name} has no fields")


@dataclass(frozen=True)
class Field:
    """``kind``: STRING takes the best span, LIST all of them. With ``choices`` spans snap to a choice."""

    name: str
    kind: str = "STRING"
    description: str | None = None
    choices: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in ("STRING", "LIST"):
            raise ValueError(f"unknown kind {self.kind}")


@dataclass(frozen=True)
class Structure:
    name: str
    fields: tuple[Field, ...]

    def __post_init__(self):
        if not self.name or not self.fields:
            raise ValueError("a structure needs a name and a field")


@dataclass(frozen=True)
class Question:
    """``kind``: choice, score (options in rising order) or noul (yes or no)."""

    id: str
    kind: str = "choice"
    instructions: str = ""
    options: tuple[Label, ...] = ()

    def __post_init__(self):
        if self.kind == "noul":
            object.__setattr__(self, "options", (Label("yes"), Label("no")))
        elif self.kind not in ("choice", "score"):
            raise ValueError(f"unknown kind {self.kind}")
        names = [o.name for o in self.options]
        if not self.id.strip():
            raise ValueError("a question needs an id")
        if len(names) < 2 or any(not n.strip() for n in names) or len(set(names)) < len(names):
            raise ValueError(f"question {self.id} needs two or more distinct options that aren't blank")

    @property
    def prompt(self) -> str:
        return f"{self.id}: {self.instructions}" if self.instructions.strip() else self.id


@dataclass(frozen=True)
class Family:
    """Labels of a router; of a single-label family the best is returned, else all."""

    name: str
    labels: tuple[str, ...]
    single: bool = False


@dataclass(frozen=True)
class Schema:
    entities: tuple[Label, ...] = ()
    classifications: tuple[Label, ...] = ()
    relations: tuple[Relation, ...] = ()
    structures: tuple[Structure, ...] = field(default=())

    def __post_init__(self):
        if not (self.entities or self.classifications or self.relations or self.structures):
            raise ValueError("a schema asks for something")
