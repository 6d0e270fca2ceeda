"""Licence scans with a positional index over the rare words of licence templates.

Templates are short licence texts and phrases. Their words make a vocabulary of a few hundred words,
whose document frequencies are counted over all documents. A template is keyed by its highest-IDF words,
one more of them than a match may lack, so that every match holds a key at its place. In each file, all
places of keys give alignments of their templates, and each alignment is verified: a key phrase must
stand whole at its place, a text must match in most of its words there and have its mandatory phrases.
No place of a phrase and no matching alignment of a text can be missed, whatever else is in the file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, lean, running_sum, slices, span_hashes, word_hash, words

#: Word bytes after A-Z are lower-cased: digits, letters and every byte of a non-ASCII character.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Template:
    """`text` in lower-case words. A base template is a phrase; others may match in part of their words."""

    label: str
    text: str
    base: bool = False
    mandatory: tuple[str, ...] = ()


#: The phrases and labels that every scan reports.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
#: Opening words of common licences, with the phrases that must be there.
OWN = (
    Template("apache-2.0", "licensed under the apache license version 2 0", mandatory=("apache license",)),
    Template("mit", "released under the mit license", mandatory=("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", mandatory=("permission is hereby granted", "free of charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", mandatory=("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", mandatory=("mozilla public license",)),
    Template("lgpl", "gnu lesser general public license", mandatory=("lesser general public license",)),
    Template("agpl", "gnu affero general public license", mandatory=("affero general public license",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", mandatory=("general public license version 3",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", mandatory=("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", mandatory=("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", mandatory=("cc by nd",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", mandatory=("permission to use copy modify",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", mandatory=("unencumbered software",)),
    Template("boost", "boost software license version 1 0", mandatory=("boost software license",)),
)


class Index:
    """Vocabulary, template word ids and postings. `weights` are the vocabulary's IDFs, by word; `cover` is the share of words that matches."""

    def __init__(self, templates: Sequence[Template], idf: dict[str, float] | None = None, cover: float = 0.8):
        self.templates = list(templates)
        self.vocabulary = sorted({w for t in templates for w in t.text.split()} | {w for t in templates for m in t.mandatory for w in m.split()})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = np.array([word_hash(w) for w in self.vocabulary], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.idf = np.array([(idf or {}).get(w, 1.0) for w in self.vocabulary])
        self.ids = [np.array([self.number[w] for w in t.text.split()]) for t in templates]
        self.mandatory = [[np.array([self.number[w] for w in m.split()]) for m in t.mandatory] for t in templates]
        # fewest of a template's words that must stand at their places
        self.needed = [len(ids) if t.base else next(m for m in range(len(ids) + 1) if m / len(ids) >= cover) for t, ids in zip(templates, self.ids, strict=True)]
        self.postings: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        for t, ids in enumerate(self.ids):
            # a match misses too few words to miss all keys: one more highest-IDF word than may be missed
            for k in np.argsort(-self.idf[ids], kind="stable")[: len(ids) - self.needed[t] + 1].tolist():
                self.postings[ids[k]].append((t, k))
        self.keyed = np.array([bool(p) for p in self.postings])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of words given by their hashes; -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def scan_words(index: Index, ids: np.ndarray, n_words: int) -> dict:
    """Matches in one file. `ids` has the vocabulary id of each of its words, -1 for other words."""
    at = np.flatnonzero(ids >= 0)
    at = at[index.keyed[ids[at]]]
    hits: dict[int, list[np.ndarray]] = {}
    for v in np.unique(ids[at]).tolist():
        own = at[ids[at] == v]
        for t, k in index.postings[v]:
            hits.setdefault(t, []).append(own - k)
    places: list[int] = []
    base, labels, score = set(), set(), 0.0
    for t, found in hits.items():
        template, want = index.templates[t], index.ids[t]
        starts = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        same = np.zeros(len(starts), np.int64)
        for k, v in enumerate(want.tolist()):
            p = starts + k
            same += (ids[np.clip(p, 0, n_words - 1)] == v) & (p >= 0) & (p < n_words)
        enough = np.flatnonzero(same >= index.needed[t])
        if template.base:
            if len(enough):
                places.extend(starts[enough].tolist())
                base.add(template.label)
                score = 1.0
            continue
        # the best alignment comes first, so the first one with its phrases gives the template's score
        for i in enough[np.argsort(-same[enough], kind="stable")].tolist():
            start = int(starts[i])
            if all(_stands(ids[max(0, start) : start + len(want)], phrase) for phrase in index.mandatory[t]):
                labels.add(template.label)
                score = max(score, int(same[i]) / len(want))
                break
    return {"places": places, "base": base, "labels": labels | base, "score": score}


def _stands(ids: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(ids) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([ids[k : k + n] == p for k, p in enumerate(phrase)]).any())


def _file_words(index: Index, batches: Iterator[pa.RecordBatch]):
    """(rows, first word of each row, place and vocabulary id of each known word)."""
    for rows, data, offsets in slices(batches):
        low = LOWER[data]
        starts, ends, first = words(low, offsets, INSIDE[low])
        ids = index.find(span_hashes(running_sum(low), starts, ends)) if len(starts) else np.zeros(0, np.int64)
        yield rows, first, ids


def document_frequencies(docs: DataFrame, templates: Sequence[Template]) -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary stands, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, n = Index(templates), None, 0
        total = np.zeros(len(index.vocabulary), np.int64)
        for rows, first, ids in _file_words(index, batches):
            at = np.flatnonzero(ids >= 0)
            row = np.searchsorted(first, at, "right") - 1
            total += np.bincount(np.unique(row * len(total) + ids[at]) % len(total), minlength=len(total)) if len(at) else 0
            n += rows.num_rows
        yield pa.RecordBatch.from_pydict({"word": [*index.vocabulary, None], "n": [*total.tolist(), n]}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    counts = docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counts}
    return found, found.pop(None, 0)


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + OWN) -> DataFrame:
    """doc_id and, for its whole text, the columns of OUT.

    A null or empty text has no words, no labels (empty strings) and score 0; n_base counts every place
    of every base phrase, overlaps too. score is 1 with a base phrase, else the best share of a
    template's words that stood at their places, or 0. Rows that repeat are scanned one by one.
    """
    df, n = document_frequencies(docs, templates)
    idf = {w: float(np.log((1 + n) / (1 + k))) for w, k in df.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf)
        for rows, first, ids in _file_words(index, batches):
            known = np.add.reduceat(np.append(ids >= 0, False).astype(np.int64), np.minimum(first[:-1], len(ids))) if rows.num_rows else []
            out: dict[str, list] = {c.split()[0]: [] for c in OUT.split(", ")}
            for i in range(rows.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                hit = scan_words(index, ids[a:b], b - a) if b > a and known[i] else {"places": [], "base": (), "labels": (), "score": 0.0}
                places = hit["places"]
                for c, v in zip(out, (b - a, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(hit["base"])), ",".join(sorted(hit["labels"])), hit["score"]), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(v, kinds[c]) for c, v in out.items()]], ["doc_id", *out])

    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
    schema = docs.select("doc_id").schema
    for c in OUT.split(", "):
        schema = schema.add(*c.split())
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
