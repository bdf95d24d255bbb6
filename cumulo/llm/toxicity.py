"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton after folding disguises.

Folding: lower case; combining marks and characters without width go; homoglyphs (Cyrillic, Greek, full-width and accented look-alikes) to Latin
letters, but for the letters that French, German and Spanish words need; digits and signs that stand for letters to those letters, in words that have
a letter (a number stays a number). Entries are whole words or stems ("stem*": at the start
of a word). A match inside an exception phrase doesn't count. The score is the sum of the matches' weights per word of
the document, with at least MIN_WORDS words, so that one hit in a long text weighs little.

The lexicon is a short base list and what learn() adds: words and stems that labelled toxic documents have far more often
than others, weighted by their log odds. It learns from at most max_rows labelled documents (a documented bound, picked
by a hash of the id); scoring covers every document and its whole text.

Defined cases: a null or empty text scores 0; rows with null or repeated ids have results of their own; without
labels the base list is used alone; other columns are ignored; empty tables give empty results. Overlapping matches: at one
start the longest counts, and a match that begins inside a counted one doesn't.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.quality import labelled

BASE = {"idiot": 1.0, "moron": 1.0, "scum": 1.0, "stupid": 0.8, "pathetic": 0.8, "worthless": 0.8, "disgusting": 0.8, "loser": 0.8, "trash": 0.7, "clown": 0.7}
EXCEPTIONS = ("class clown", "clown fish", "trash can", "trash bin", "trash bag", "trash collection", "pond scum", "sore loser")
MIN_WORDS, THRESHOLD, MAX_ROWS = 20, 0.004, 6000

_LOOKALIKES = {
    "a": "аαａáàâãåāąă@4", "b": "вьｂ", "c": "сϲｃćč", "d": "ԁｄđ", "e": "еεｅēėęě3", "g": "ɡｇğ9", "h": "һｈ", "i": "іιｉïìîīįı1", "j": "јｊ", "k": "кκｋ",
    "l": "ӏｌł", "m": "мｍ", "n": "пηｎńň", "o": "оοｏōőõòô0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒř", "s": "ѕｓśš5", "t": "тτｔť7", "u": "υｕūůű", "v": "νѵｖ",
    "w": "ԝｗ", "x": "хχｘ", "y": "уγｙý", "z": "ｚźžż",
}
#: Letters that French, German and Spanish words need are no disguise.
_ORDINARY = set("áàâéèêëíîïóôúùûüñçäöß")
_FOLD = {ord(c): latin for latin, others in _LOOKALIKES.items() for c in others if (c not in _ORDINARY or c in "ï") and not c.isascii()}
_DIGITS = {ord(c): latin for latin, others in _LOOKALIKES.items() for c in others if c.isascii()}
_FOLDED = re.compile("[" + "".join(re.escape(chr(c)) for c in _FOLD) + "]")
_DISGUISE = re.compile(r"[0-9@$!|]+")
_SIGNS = re.compile(r"(?<=[^\W_])[$!|](?=[^\W_])")
_SIGN = {"$": "s", "!": "i", "|": "l"}
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_WORD = re.compile(r"\w+")


def _undisguised(text: str) -> str:
    """Digits and signs as letters, in words that have a letter; only the words around them are looked at."""
    out, done, n = [], 0, len(text)
    for m in _DISGUISE.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_@$!|"):
            start -= 1
        while end < n and (text[end].isalnum() or text[end] in "_@$!|"):
            end += 1
        word = text[start:end]
        if not word.isdigit() and any(map(str.isalpha, word)):
            word = _SIGNS.sub(lambda s: _SIGN[s[0]], word.translate(_DIGITS))
        out += [text[done:start], word]
        done = end
    return "".join([*out, text[done:]]) if out else text


def fold(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        t = _UNSEEN.sub("", t)
        if _COMBINING.search(t):
            t = _COMBINING.sub("", unicodedata.normalize("NFC", t))
        if _FOLDED.search(t):
            t = t.translate(_FOLD)
    return _undisguised(t)


@dataclass(frozen=True)
class Lexicon:
    """entries: word or stem* -> weight; exceptions: phrases whose matches don't count. All folded."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


def base_lexicon() -> Lexicon:
    return Lexicon(dict(BASE))


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    """A stem and a word can be the same string; value: (length, weight as a word, weight as a stem, exception)."""
    found: dict[str, list] = {}
    for entry, weight in lexicon.entries.items():
        key, stem = fold(entry.rstrip("*")), entry.endswith("*")
        if key:
            found.setdefault(key, [None, None, False])[int(stem)] = weight
    for phrase in lexicon.exceptions:
        if phrase:
            found.setdefault(fold(phrase), [None, None, False])[2] = True
    a = ahocorasick.Automaton()
    for key, (word, stem, exception) in found.items():
        a.add_word(key, (len(key), word, stem, exception))
    if found:
        a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the matches that count in a folded text."""
    if len(a) == 0:
        return []
    n, matches, spared = len(text), [], []
    for last, (length, word, stem, exception) in a.iter(text):
        start, end = last + 1 - length, last + 1
        if start and _joined(text[start - 1]):
            continue
        closed = end == n or not _joined(text[end])
        if exception and closed:
            spared.append((start, end))
        weight = word if closed and word is not None else stem
        if weight is not None:
            matches.append((start, -end, weight))
    spared.sort()
    starts, reaches = [s for s, _ in spared], []
    for _, e in spared:
        reaches.append(max(e, reaches[-1] if reaches else 0))
    counted, reach = [], 0
    for start, end, weight in sorted(matches):
        if start < reach:
            continue
        before = bisect_right(starts, start)
        if not before or reaches[before - 1] < -end:
            counted.append((start, -end, weight))
            reach = -end
    return counted


def _joined(c: str) -> bool:
    return c.isalnum() or c == "_"


def score_text(a: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
    """(score, number of hits)."""
    if not text:
        return 0.0, 0
    t = fold(text)
    found = hits(a, t)
    if not found:
        return 0.0, 0
    return sum(w for _, _, w in found) / max(MIN_WORDS, len(_WORD.findall(t))), len(found)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Lexicon:
    rows = labelled(docs, labels, "toxic", max_rows)
    return lexicon_from(rows["text"].tolist(), rows["cumulo_label"].tolist())


def lexicon_from(texts: list[str], toxic: list[int], stems: range = range(4, 9), least_odds: float = 3.0) -> Lexicon:
    """The base list and the entries that set the toxic texts apart.

    An entry has to be in 2 % of the toxic texts and in 6 (equal texts count once); of stems that begin alike, the one with the larger
    product of frequency and log odds is taken, at the longest length that occurs as often.
    """
    entries = dict(BASE)
    rows = sorted(dict(zip(texts, map(int, toxic))).items())
    n_bad = sum(t for _, t in rows)
    n_good = len(rows) - n_bad
    if n_bad == 0 or n_good == 0:
        return Lexicon(entries)
    counts = [Counter(), Counter()]
    for text, t in rows:
        words = {w for w in _WORD.findall(fold(text)) if not w.isdigit()}
        keys = {w[:k] + "*" for w in words for k in stems if len(w) > k} | words
        counts[t].update(keys)
    good, bad = counts
    least = max(6, 0.02 * n_bad)
    odds = {k: math.log((c + 0.5) / (n_bad + 1)) - math.log((good[k] + 0.5) / (n_good + 1)) for k, c in bad.items() if c >= least}
    ranked = sorted((k for k, o in odds.items() if o >= least_odds), key=lambda k: (-bad[k] * odds[k], -len(k), k))
    taken: list[str] = []
    for k in ranked:
        stem = k.rstrip("*")
        if any(stem.startswith(t.rstrip("*")) if t.endswith("*") else stem == t for t in taken) or any(t.startswith(stem) for t in taken):
            continue
        taken.append(k)
    for k in taken:
        if k not in entries:
            entries[k] = round(min(1.0, odds[k] / 6), 3)
    return Lexicon(entries)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, hits, toxic) of every row."""
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(lexicon)
        for b in batches:
            both = [score_text(a, t) for t in b["text"]]
            values = np.array([s for s, _ in both], float).round(6)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": values, "hits": [h for _, h in both], "toxic": values >= THRESHOLD})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(scored, f"doc_id {kind}, score double, hits int, toxic boolean")


def flagged(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of score() that are toxic."""
    return score(docs, lexicon).where("toxic")
