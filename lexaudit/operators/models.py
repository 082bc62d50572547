"""Answerers for choosers: loaded once a worker, asked in batches; a stub that needs no model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: (system prompt, questions) to answers, one a question.
Answerer = Callable[[str, list[str]], list[str]]

_loaded: dict[str, Answerer] = {}


@dataclass(frozen=True)
class Loaded:
    """A model that a worker process loads when it is first asked, and keeps under its name.

    load takes nothing and returns an answerer; it and its arguments must
    pickle, and the model itself is never sent. Questions are asked batch at a
    time, in order.
    """

    name: str
    load: Callable[[], Answerer]
    batch: int = 16

    def __call__(self, system: str, questions: list[str]) -> list[str]:
        if questions and self.name not in _loaded:
            _loaded[self.name] = self.load()
        out: list[str] = []
        for i in range(0, len(questions), self.batch):
            part = questions[i : i + self.batch]
            told = _loaded[self.name](system, part)
            if len(told) != len(part):
                raise ValueError(f"{self.name} gave {len(told)} answers to {len(part)} questions")
            out += told
        return out


def first_option(system: str, questions: list[str]) -> list[str]:
    """The stub: every question gets its first option."""
    return ["1"] * len(questions)
