"""Prompts of choosers, by name and version.

A published version never changes, since results name it; a new text is a new
version at the end of its family.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Prompt:
    """Instructions for the model, and a template of one question with the places {citation} and {options}."""

    name: str
    version: str
    system: str
    template: str
    note: str

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


CHOICE = (
    Prompt(
        "choice",
        "1",
        "You match court citations with registry records. Reply with one number.",
        "Citation: {citation}\nRecords:\n{options}\nWhich number is cited? 0 for none.",
        "first version",
    ),
    Prompt(
        "choice",
        "2",
        "You match court citations with registry records. Records of one number differ by the kind of appeal; prefer the record of the kind that the citation names. Reply with one number.",
        "Citation: {citation}\nRecords:\n{options}\nWhich number is cited? 0 for none.",
        "says what tells the records apart",
    ),
)
FAMILIES = {"choice": CHOICE}


def current(name: str) -> Prompt:
    """The version in use: the last of its family."""
    return FAMILIES[name][-1]


def version(name: str, number: str) -> Prompt:
    """One version, to give an earlier result anew."""
    return next(p for p in FAMILIES[name] if p.version == number)
