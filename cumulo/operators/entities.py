"""Bags of entity names from text: pluggable extraction, negation, ordered de-duplication.

The default extractor is a rule and needs no model. Inside each clause, runs of content words between function words are noun chunks. Runs that begin
with a number or the name of a month or weekday are entities with a label (PERCENT, MONEY, DATE, CARDINAL), as a model would give them. Negation
follows the usual four lists of cues: a pre-cue negates what follows it in its clause, a post-cue what stands before it,
a pseudo-cue ("no increase", "not only") looks like one and negates nothing, and a termination ("but", "however") ends a clause as punctuation does.
A model-backed extractor can be given as a function from a list of texts to lists of entities. Either runs in Arrow batches, as one step
from text to bag: as higher-order functions in the JVM the same rules took some ten times as long. No parity with any language model's entities is claimed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP_LABELS = ("PERSON", "GPE", "LOC", "ORG", "DATE", "TIME", "MONEY", "PERCENT", "CARDINAL", "ORDINAL", "QUANTITY", "FAC", "NORP")
GENERIC = ("patient", "he", "she", "they", "we", "history", "procedure")
MIN_NAME, BATCH = 3, 32
PRE_CUES = (
    "absence of", "cannot see", "declined", "denied", "denies", "denying", "fails to reveal", "free of", "lack of", "lacked", "lacking", "negative for", "never", "no", "no evidence of", "no sign of",
    "no signs of", "nor", "not", "not demonstrate", "rather than", "resolved", "rule out", "ruled out", "ruled out for", "rules out", "unremarkable for", "with no", "without", "without any evidence of", "without evidence of",
)
POST_CUES = ("absent", "free", "is ruled out", "not present", "not seen", "unlikely", "was ruled out", "were negative", "was negative", "were ruled out")
PSEUDO_CUES = ("gram negative", "no change", "no further", "no increase", "no suspicious change", "not cause", "not certain whether", "not drain", "not extend", "not necessarily", "not only", "without difficulty")
TERMINATIONS = ("although", "apart from", "aside from", "because of", "but", "cause of", "except", "however", "nevertheless", "secondary to", "still", "though", "which", "yet")
BREAKS = (
    "a an the this that these those and or with of to in on at for from by as is are was were be been has have had he she they we it i you his her their our my its "
    "there who who's than then so if because after before during while also very more most all any some".split()
)
DATES = "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()

@dataclass(frozen=True)
class Entity:
    text: str
    kind: str = "chunk"
    label: str = ""
    negated: bool = False


Extractor = Callable[[list[str]], list[list[Entity]]]


def phrases() -> list[tuple[str, str]]:
    """(phrase, mark) of the cues with several words, the longest first so that none is cut by a shorter one."""
    marks = [(PSEUDO_CUES, "|"), (POST_CUES, "`"), (PRE_CUES, "^"), (TERMINATIONS, "~")]
    return sorted(((p, mark) for cues, mark in marks for p in cues if " " in p), key=lambda x: (-len(x[0]), x[0]))


def single_words() -> dict[str, str]:
    """The mark of each function word and cue of one word."""
    marks = [(BREAKS, "|"), (PRE_CUES, "^"), (POST_CUES, "`"), (TERMINATIONS, "~")]
    return {w: mark for words, mark in reversed(marks) for w in words if " " not in w}


_PHRASES, _SINGLE = [(f" {p} ", f" {m} ") for p, m in phrases()], single_words()
_MARKS, _ENDS, _WHITE, _SPACE = re.compile(r"[|~^`]+"), re.compile(r"[.,;:!?\n]+"), re.compile(r"[ \t\n\r\x0b\f]+"), re.compile(r"\s+")


def mark(text: str) -> str:
    """The lower-case text with marks in the place of cues and function words: | between chunks, ^ and ` for pre- and post-cues, ~ at a clause's end."""
    t = f" {_WHITE.sub(' ', _ENDS.sub(' ~ ', _MARKS.sub(' ', text.lower())))} "
    for phrase, sign in _PHRASES:
        if phrase in t:
            t = t.replace(phrase, sign)
    return " ".join([_SINGLE.get(w, w) for w in t.split(" ")])


def _label(run: str, first: int) -> str:
    """The label of a run, whose first letter or digit stands at first; none for a noun chunk."""
    if not run[first].isalpha():
        if "%" in run[first:].partition(" ")[0]:
            return "PERCENT"
        return "MONEY" if first and run[first - 1] in "$€£" else "CARDINAL"
    return "DATE" if run[first:].partition(" ")[0] in DATES else ""


def rule_entities(texts: list[str]) -> list[list[Entity]]:
    """The default extraction. Before a post-cue all of a clause is negated; after the last one, what follows a pre-cue."""
    found = []
    for text in texts:
        own: list[Entity] = []
        for clause in mark(text).split("~"):
            parts = clause.split("`")
            for k, part in enumerate(parts):
                for i, segment in enumerate(part.split("^")):
                    for run in segment.split("|"):
                        if any(map(str.isalpha, run)):
                            own.append(_entity(run.strip(" "), k < len(parts) - 1 or i > 0))
        found.append(own)
    return found


def _entity(run: str, negated: bool) -> Entity:
    first, end = 0, len(run)
    while not run[first].isalnum():
        first += 1
    label = _label(run, first)
    while not run[first].isalpha():
        first += 1
    while not run[end - 1].isalnum():
        end -= 1
    return Entity(run[first:end], "entity" if label else "chunk", label, negated)


def bag(found: list[Entity]) -> list[str]:
    """Names of entities before those of chunks, unwanted labels and generic chunks out, short names out.

    A name counts once, where it first stands; that first place also decides whether it is negated.
    """
    names: dict[str, bool] = {}
    for kind in ("entity", "chunk"):
        for e in found:
            if e.kind == kind:
                name = _SPACE.sub("_", e.text.strip().lower())
                if len(name) >= MIN_NAME and name not in names and (e.label not in SKIP_LABELS if kind == "entity" else name not in GENERIC):
                    names[name] = e.negated
    return [f"NEG_{n}" if negated else n for n, negated in names.items()]


def entity_bags(docs: DataFrame, extract: Extractor | None = None) -> DataFrame:
    """(doc_id, tokens) of docs(doc_id, text). BATCH texts at a time, each batch sent on before the next, so that a worker holds the names of no more texts than those."""
    find = extract or rule_entities

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), BATCH):
                part = batch.slice(s, BATCH)
                bags = [bag(found) for found in find(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bags, pa.list_(pa.string()))], names=["doc_id", "tokens"])

    kept = docs.where("text IS NOT NULL").select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, tokens array<string>")


def non_empty(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.size("tokens") > 0)
