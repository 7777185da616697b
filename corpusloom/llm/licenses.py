"""License scans by a trained paragraph classifier.

A paragraph (a line with words) becomes hashed word uni- and bigrams.  A sparse
multinomial logistic regression with a class per license family and one for
everything else is trained with numpy: on variants of the template notices
(words dropped, put in, swapped, mixed into running text) and, as unknown, on at
most ``SAMPLE`` paragraphs of the corpus, none longer than ``EXAMPLE``
characters, that hold no template's distinctive words.  A temperature fitted on variants left out gives probabilities; below
``LEAST`` the answer is unknown.  A prediction counts if its paragraph also
holds at least ``COVER`` of the word pairs of a template of that family.  A
paragraph of more than ``WINDOW`` words is judged in windows of that many words,
one every ``STEP``, so that words around a notice do not outweigh it; of windows
that overlap the one with most of a template counts, once per family, and the
whole paragraph is only judged at once where no window counts.

Rows: null or empty texts have no paragraph.  Repeated rows are scanned each.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import text_of, written
from corpusloom.llm.textkernel import LOWER, pieces, runs, span_hashes, word_bounds

FEATURES = 1 << 16
SAMPLE = 4000
EXAMPLE = 2000
VARIANTS = 120
EPOCHS = 60
LEAST = 0.5
COVER = 0.5
WINDOW = 24
STEP = 8
UNKNOWN = "unknown"

# fixed values: short notices by which license families are known
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license", "this work is licensed under the gnu affero general public license version 3"],
    "Apache": ["licensed under the apache license version 2 0", "released under the apache license version 2 0"],
    "BSD": ["licensed under the bsd 3 clause license", "released under the bsd license",
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "CC-BY": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC0": ["released under cc0 1 0 universal", "dedicated to the public domain under the creative commons cc0 1 0 universal dedication"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license",
            "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "ISC": ["licensed under the isc license", "released under the isc license"],
    "LGPL": ["licensed under the gnu lesser general public license", "this work is licensed under the gnu lesser general public license version 3"],
    "MIT": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["licensed under the mozilla public license version 2 0", "subject to the terms of the mozilla public license v 2 0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
}
# fixed values: words that no paragraph used as an example of unknown may hold
DISTINCTIVE = ["license", "licensed", "licence", "copyright", "redistribution", "creative", "commons", "unencumbered"]

BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def paragraphs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a text column: first row, (row, line) per paragraph, word hashes, and each paragraph's first word."""
    for row, _, data, offsets in pieces(column):
        low = LOWER[data]
        starts, ends, _ = word_bounds(BREAK[low], offsets)
        if not len(starts):
            continue
        breaks = np.flatnonzero(data == 10)
        of = np.searchsorted(offsets, starts, "right") - 1
        line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[of]
        first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (line[1:] != line[:-1]))))
        yield row, np.stack((of[first], line[first])), span_hashes(low, starts, ends), np.append(first, len(starts))


def grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and word-pair hashes of all paragraphs, and the paragraph of each."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = runs(words, 2)
    inside = of[1:] == of[:-1]
    return np.concatenate((words, pair[inside])), np.concatenate((of, of[:-1][inside]))


def hashed(text: str) -> np.ndarray:
    """Word hashes of one paragraph."""
    found = [w for _, _, w, _ in paragraphs(pa.array([text]))]
    return found[0] if found else np.zeros(0, np.uint64)


class Classifier:
    """Weights per family, a temperature, and the word pairs of the templates."""

    def __init__(self, background: list[str], templates: dict[str, list[str]] = TEMPLATES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.names = [*templates, UNKNOWN]
        filler = [w for text in background[:200] for w in text.split()][:5000] or ["the", "of", "and", "in", "to"]
        texts, truth = [], []
        for k, notices in enumerate(templates.values()):
            for _ in range(VARIANTS):
                words = str(rng.choice(notices)).split()
                if rng.random() < 0.5:
                    words = [w for w in words if rng.random() > 0.08] or words
                if rng.random() < 0.5:
                    words.insert(int(rng.integers(len(words) + 1)), str(rng.choice(filler)))
                if rng.random() < 0.4:
                    extra = [str(x) for x in rng.choice(filler, int(rng.integers(1, 12)))]
                    words = extra + words if rng.random() < 0.5 else words + extra
                texts.append(" ".join(words))
                truth.append(k)
        near = ["the license fee was paid", "a driving license is required", "public library", "general version of the text", "all rights reserved",
                "released in the year", "free of charge", "under the terms of the contract", "the source code of the work"]
        for text in [*background, *near * 20]:
            texts.append(text)
            truth.append(len(templates))
        order = rng.permutation(len(texts))
        texts, y = [texts[i] for i in order], np.array(truth)[order]
        words = [hashed(t) for t in texts]
        first = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        feature, of = grams(np.concatenate(words), first)
        feature = (feature % np.uint64(FEATURES)).astype(np.int64)
        self.weights, self.bias = np.zeros((FEATURES, len(self.names)), np.float32), np.zeros(len(self.names))
        inside = np.arange(len(y)) % 5 != 0
        right = np.eye(len(self.names))[y]
        seen = np.full_like(self.weights, 1e-6), np.full_like(self.bias, 1e-6)
        for _ in range(EPOCHS):
            diff = (right - self.soft(self.sums(feature, of, len(y)))) * inside[:, None]
            g = np.stack([np.bincount(feature, diff[of, j], FEATURES) for j in range(len(self.names))], 1) - 0.01 * self.weights
            for target, grad, total in zip((self.weights, self.bias), (g, diff.sum(0)), seen):
                total += grad * grad
                target += (0.3 * grad / np.sqrt(total)).astype(target.dtype)
        scores = self.sums(feature, of, len(y))[~inside]
        heats = np.geomspace(0.5, 8, 33)
        loss = [-np.log(self.soft(scores / t)[np.arange(len(scores)), y[~inside]] + 1e-12).mean() for t in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        self.pairs = {k: [set(runs(hashed(t), 2).tolist()) for t in notices] for k, notices in enumerate(templates.values())}

    @staticmethod
    def soft(scores: np.ndarray) -> np.ndarray:
        out = np.exp(scores - scores.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    def sums(self, feature: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=n)
        out = np.tile(self.bias, (n, 1))
        some = np.flatnonzero(count)
        if len(some):
            starts = (np.cumsum(count) - count)[some]
            out[some] += np.add.reduceat(self.weights[feature[order]], starts)
        return out

    def cover(self, family: int, words: np.ndarray) -> float:
        """The largest share of the word pairs of a template of the family."""
        mine = set(runs(words, 2).tolist())
        return max((len(mine & pairs) / len(pairs) if pairs else 1.0 for pairs in self.pairs[family]), default=0.0)

    def found(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float]]:
        """(paragraph, family, probability) of the confirmed predictions among paragraphs."""
        feature, of = grams(words, first)
        chance = self.soft(self.sums((feature % np.uint64(FEATURES)).astype(np.int64), of, len(first) - 1) / self.heat)
        best = chance[:, :-1].argmax(1)
        sure = chance[np.arange(len(best)), best]
        out = self.in_windows(words, first)
        met = {i for i, _, _ in out}
        out += [(int(i), int(best[i]), float(sure[i])) for i in np.flatnonzero(sure >= LEAST)
                if i not in met and self.cover(int(best[i]), words[first[i] : first[i + 1]]) >= COVER]
        return sorted(out)

    def in_windows(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float]]:
        """As ``found``, from the windows of long paragraphs."""
        size = np.diff(first)
        long = np.flatnonzero(size > WINDOW)
        if not len(long):
            return []
        per = -(-(size[long] - WINDOW) // STEP) + 1
        of = np.repeat(long, per)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        start = first[of] + np.minimum(nth * STEP, size[of] - WINDOW)
        sums = np.tile(self.bias, (len(of), 1))
        for feature, n in ((words, WINDOW), (runs(words, 2), WINDOW - 1)):
            total = np.zeros((len(feature) + 1, len(self.names)))
            np.cumsum(self.weights[(feature % np.uint64(FEATURES)).astype(np.int64)], axis=0, dtype=np.float64, out=total[1:])
            sums += total[start + n] - total[start]
        chance = self.soft(sums / self.heat)
        best = chance[:, :-1].argmax(1)
        sure = chance[np.arange(len(best)), best]
        hits: dict[int, list] = {}
        for i in np.flatnonzero(sure >= LEAST):
            share = self.cover(int(best[i]), words[start[i] : start[i] + WINDOW])
            if share >= COVER:
                hits.setdefault(int(of[i]), []).append((-share, -float(sure[i]), int(start[i]), int(best[i])))
        out = []
        for i, windows in hits.items():
            taken, kept = [], {}
            for share, chance_, at, family in sorted(windows):
                if all(abs(at - other) >= WINDOW for other in taken):
                    taken.append(at)
                    kept.setdefault(family, -chance_)
            out += [(i, family, chance_) for family, chance_ in kept.items()]
        return out


def background(docs: DataFrame, text_column: str, sample: int) -> list[str]:
    """Paragraphs without distinctive words, at most ``sample``, the same ones for the same rows."""
    lines = docs.select(F.explode(F.split(text_of(docs, text_column), "\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    lines = lines.filter(~F.lower("line").rlike("|".join(DISTINCTIVE)) & (F.length("line") <= EXAMPLE))
    # chosen by hashes alone, so that tasks send no more than those
    keys = written(lines.select(F.xxhash64("line").alias("chosen")).distinct().orderBy("chosen").limit(sample))
    rows = lines.withColumn("chosen", F.xxhash64("line")).join(F.broadcast(keys), "chosen", "left_semi").distinct()
    return [r["line"] for r in rows.orderBy("chosen", "line").limit(sample).collect()]


def licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, n_paragraphs, found) for every row; found holds (line, family, probability) in the order of lines."""
    model = Classifier(background(docs, text_column, sample))
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for row, where, words, first in paragraphs(batch.column("text")):
                count += np.bincount(where[0] + row, minlength=batch.num_rows)
                for i, family, chance in model.found(words, first):
                    out[row + where[0][i]].append({"line": int(where[1][i]), "family": model.names[family], "probability": chance})
            yield pa.record_batch([batch.column("id"), pa.array(count), pa.array(out, kind)], names=["id", "n_paragraphs", "found"])

    rows = docs.select(docs[id_column].cast("bigint").alias("id"), text_of(docs, text_column).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_paragraphs bigint, found array<struct<line:int,family:string,probability:double>>")
