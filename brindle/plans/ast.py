"""Nodes of a query; each prints in the form AND(Term(a), NEAR/3(Term(b), Phrase("c d")))."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    word: str

    def __str__(self) -> str:
        return f"Term({self.word})"


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]

    def __str__(self) -> str:
        return f'Phrase("{" ".join(self.words)}")'


@dataclass(frozen=True)
class Wildcard:
    pattern: str

    def __str__(self) -> str:
        return f"Wildcard({self.pattern})"


@dataclass(frozen=True)
class Field:
    name: str
    word: str

    def __str__(self) -> str:
        return f"Field({self.name}:{self.word})"


@dataclass(frozen=True)
class Not:
    operand: Node

    def __str__(self) -> str:
        return f"NOT({self.operand})"


@dataclass(frozen=True)
class And:
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"AND({self.left}, {self.right})"


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"OR({self.left}, {self.right})"


@dataclass(frozen=True)
class Near:
    left: Node
    right: Node
    distance: int

    def __str__(self) -> str:
        return f"NEAR/{self.distance}({self.left}, {self.right})"


Node = Term | Phrase | Wildcard | Field | Not | And | Or | Near


def show(node: Node | None) -> str:
    return "(empty)" if node is None else str(node)
