"""From a question to a cited answer: named stages over a short list of passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.errors import EngineError, require
from docspark.functions.answers import NOT_FOUND, cited, escape_markup_text

SYSTEM_PROMPT = (
    "You answer questions from numbered passages of the user's own documents. Use nothing but the passages. After each "
    "statement name the passages it rests on, like [S1]. If the passages do not hold the answer, reply exactly: " + NOT_FOUND
)


@dataclass(frozen=True)
class Passage:
    id: int
    doc_id: str
    source_path: str
    title: str
    page: int
    offset: int
    length: int
    text: str
    score: float
    similarity: float
    content_hash: str = ""


@dataclass
class State:
    """What stages read and change."""

    question: str
    passages: list[Passage] = field(default_factory=list)
    prompt: str = ""
    answer: str = ""


Stage = tuple[str, Callable[[State], None]]


class Generator(Protocol):
    def generate(self, system: str, user: str) -> Iterator[str]: ...

    def count_tokens(self, text: str) -> int: ...


def run(stages: Sequence[Stage], state: State) -> State:
    """Stages in order; an error ends the run and names its stage, an empty list does not."""
    for name, stage in stages:
        try:
            stage(state)
        except EngineError as e:
            raise EngineError(e.status, f"{name}: {e}") from e
    return state


def similar(rows: DataFrame, least: float) -> DataFrame:
    """Rows with a similarity of ``least`` or more."""
    return rows.filter(F.col("similarity") >= least)


def keep_similar(least: float) -> Callable[[State], None]:
    def stage(s: State) -> None:
        s.passages = [p for p in s.passages if p.similarity >= least]

    return stage


def rank(s: State) -> None:
    s.passages = sorted(s.passages, key=lambda p: -p.score)


def drop_repeats(s: State) -> None:
    """Of better passages first: one goes if a kept one has its text, or covers more than half of the shorter in its document."""
    kept: list[Passage] = []
    for p in s.passages:
        def repeats(k: Passage, p: Passage = p) -> bool:
            shared = min(k.offset + k.length, p.offset + p.length) - max(k.offset, p.offset)
            shorter = min(k.length, p.length)
            return k.text == p.text or (k.doc_id == p.doc_id and shorter > 0 and shared > shorter // 2)

        if not any(map(repeats, kept)):
            kept.append(p)
    s.passages = kept


def user_prompt(question: str, passages: Sequence[Passage]) -> str:
    blocks = []
    for n, p in enumerate(passages, 1):
        name = escape_markup_text(p.title or p.source_path.rpartition("/")[2])
        page = f", page {p.page}" if p.page > 0 else ""
        blocks.append(f"[S{n}] ({name}{page})\n{escape_markup_text(p.text)}\n\n")
    return "Passages:\n\n" + "".join(blocks) + f"Question: {escape_markup_text(question)}"


def bytes_over_four(text: str) -> int:
    """A token count without a model."""
    return -(-len(text.encode()) // 4)


def tokens_of(path: str) -> Callable[[str], int]:
    """A token count by a vocabulary file of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def fit_budget(budget: int, count: Callable[[str], int] = bytes_over_four) -> Callable[[State], None]:
    """Passages, best first, while the prompt stays within ``budget`` tokens; one that does not fit is passed over."""

    def stage(s: State) -> None:
        size = lambda ps: count(SYSTEM_PROMPT) + count(user_prompt(s.question, ps))
        require(size([]) <= budget, "the question alone is over the budget", "TOO_LONG")
        kept: list[Passage] = []
        for p in s.passages:
            if size([*kept, p]) <= budget:
                kept.append(p)
        s.passages = kept
        s.prompt = user_prompt(s.question, kept) if kept else ""

    return stage


def generate(model: Generator, on_token: Callable[[str], bool | None] | None = None) -> Callable[[State], None]:
    """Without passages the model does not run and the answer is that nothing was found. ``on_token`` stops by returning False."""

    def stage(s: State) -> None:
        if not s.passages:
            s.answer = NOT_FOUND
            if on_token:
                on_token(s.answer)
            return
        parts = []
        for piece in model.generate(SYSTEM_PROMPT, s.prompt):
            parts.append(piece)
            if on_token and on_token(piece) is False:
                break
        require(bool(parts), "the model gave no tokens", "INTERNAL")
        s.answer = "".join(parts)

    return stage


@dataclass(frozen=True)
class Citation:
    number: int
    chunk_id: int
    doc_id: str
    source_path: str
    title: str
    page: int
    offset: int
    length: int
    similarity: float
    content_hash: str


@dataclass(frozen=True)
class Answer:
    text: str
    found: bool
    citations: list[Citation]
    passages: list[Passage]


def not_found(text: str) -> bool:
    return text.strip(" \t\r\n").removesuffix(".") == NOT_FOUND.removesuffix(".")


def make_answer(s: State) -> Answer:
    """Cited passages in the order of their first citation; an answer that cites none rests on all that were used."""
    found = bool(s.passages) and not not_found(s.answer)
    numbers = (cited(s.answer, len(s.passages)) or list(range(1, len(s.passages) + 1))) if found else []
    made = [
        Citation(n, p.id, p.doc_id, p.source_path, p.title, p.page, p.offset, p.length, p.similarity, p.content_hash)
        for n in numbers
        for p in [s.passages[n - 1]]
    ]
    return Answer(s.answer, found, made, s.passages)


@dataclass(frozen=True)
class ExtractiveGenerator:
    """No model: the sentence of the best passages that shares most words with the question, with its citation."""

    least_shared: int = 1

    def count_tokens(self, text: str) -> int:
        return bytes_over_four(text)

    def generate(self, system: str, user: str) -> Iterator[str]:
        import re

        body, _, question = user.rpartition("Question: ")
        asked = {w for w in re.findall(r"\w+", question.lower()) if len(w) > 2}
        best, answer = self.least_shared - 1, ""
        for n, text in re.findall(r"\[S(\d+)\] \([^\n]*\)\n(.*?)(?=\n\n\[S\d+\] \(|\n\n\Z)", body, re.S):
            for sentence in re.split(r"(?<=[.!?।。])\s+|\n", text):
                shared = len(asked & set(re.findall(r"\w+", sentence.lower())))
                if shared > best:
                    best, answer = shared, f"{sentence.strip()} [S{n}]"
        yield answer or NOT_FOUND


def standard_stages(retrieve: Callable[[State], None], model: Generator, least: float, budget: int, on_token=None) -> list[Stage]:
    return [
        ("retrieve", retrieve), ("filter", keep_similar(least)), ("rank", rank), ("dedupe", drop_repeats),
        ("budget", fit_budget(budget, model.count_tokens)), ("generate", generate(model, on_token)),
    ]


__all__ = ["Answer", "Citation", "ExtractiveGenerator", "Generator", "Passage", "State", "make_answer", "replace", "run", "standard_stages"]
