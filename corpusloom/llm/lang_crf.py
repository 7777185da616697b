"""Language ID by a linear-chain conditional random field over words.

A word is a run of letters (ASCII letters or bytes beyond ASCII); a run of more
than ``LONG`` bytes with letters beyond ASCII, as of a script without blanks, is
cut into words of ``UNIT`` characters that share one with the next.  Its emission
scores come from affixes, character n-grams and a lexicon: the share of each
language in the word's occurrences over all learnable texts.  Transitions
between the languages of neighbouring words are learned with them, also on
chains spliced from two texts, so that code-switched text is labelled word by
word.  Forward-backward gives the posterior of every word; a document's language
is the one with the largest mean posterior over all its words, and that mean is
the score.

The field is fitted with numpy on chains from at most ``SAMPLE`` texts; the
lexicon is counted over all of them and keeps the words that make up at least
one in ``RARE`` of the words of some language (so no more than that for each).  Chains have ``CHAIN`` words.

Rows: a null text, or one without a letter, gives ``und`` and 0.  Rows with a
null language, and those kept out by id, are never learned from.  With no
learnable row everything is ``und``.  Repeated rows are labelled each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import text_of, written
from corpusloom.llm.quality import held_out
from corpusloom.llm.textkernel import LOWER, pieces, span_hashes, word_bounds

SAMPLE = 2000
CHAIN = 32
CHAINS = 6_000
FEATURES = 1 << 16
RARE = 100_000
LONG = 48
UNIT = 4
EPOCHS = 40
CACHED_WORDS = 400_000
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words, and for each row its first word."""
    starts, ends, first = word_bounds(NO_LETTER[data], offsets)
    cut = [i for i in np.flatnonzero(ends - starts > LONG) if (data[starts[i] : ends[i]] >= 128).any()]
    if cut:
        parts = [(np.delete(starts, cut), np.delete(ends, cut))]
        for i in cut:
            chars = starts[i] + np.flatnonzero((data[starts[i] : ends[i]] & 0xC0) != 0x80)
            unit = np.arange(0, max(1, len(chars) - 1), UNIT)
            parts.append((chars[unit], np.append(chars, ends[i])[np.minimum(unit + UNIT + 1, len(chars))]))
        starts, ends = map(np.concatenate, zip(*parts))
        order = np.argsort(starts)
        starts, ends = starts[order], ends[order]
        first = np.searchsorted(starts, offsets)
    return starts, ends, span_hashes(LOWER[data], starts, ends), first


def features_of(word: str) -> list[int]:
    """Hashed affixes of up to four characters and inner n-grams of two and three."""
    word = word.lower()
    marked = f"<{word}>"
    names = {f"p{word[:i]}" for i in range(1, min(4, len(word)) + 1)} | {f"s{word[-i:]}" for i in range(1, min(4, len(word)) + 1)}
    names |= {f"g{marked[i:i + k]}" for k in (2, 3) for i in range(len(marked) - k + 1)}
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


class Field:
    """Weights of features and lexicon, transitions and starts for K languages."""

    def __init__(self, languages: list[str], lexicon: tuple[np.ndarray, np.ndarray]):
        self.languages, self.k = languages, len(languages)
        self.names, self.shares = lexicon
        self.weights = np.zeros((FEATURES, self.k), np.float32)
        self.trust = np.ones(1)
        self.move, self.start = np.zeros((self.k, self.k)), np.zeros(self.k)

    def lexical(self, hashes: np.ndarray) -> np.ndarray:
        """Centred shares of the languages; zero for words outside the lexicon."""
        out = np.zeros((len(hashes), self.k))
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
            known = self.names[at] == hashes
            out[known] = self.shares[at[known]]
        return out

    def emissions(self, features: list[list[int]], hashes: np.ndarray) -> np.ndarray:
        sizes = np.array([len(f) for f in features])
        flat = np.fromiter((x for f in features for x in f), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) if len(sizes) else np.zeros((0, self.k))
        return sums + self.trust * self.lexical(hashes)

    def posteriors(self, scores: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word posteriors [chain, word, language] and summed pair posteriors, by scaled forward-backward.

        ``scores`` [chain, word, language], ``used`` [chain, word]: unused words come last.
        """
        n, t, k = scores.shape
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        move = np.exp(self.move)
        ahead, back = np.empty((n, t, k)), np.ones((n, t, k))
        now = local[:, 0] * np.exp(self.start)
        ahead[:, 0] = now / now.sum(1, keepdims=True)
        for i in range(1, t):
            now = (ahead[:, i - 1] @ move) * local[:, i]
            ahead[:, i] = np.where(used[:, i, None], now / now.sum(1, keepdims=True), ahead[:, i - 1])
        pairs = np.zeros((k, k))
        for i in range(t - 2, -1, -1):
            now = (local[:, i + 1] * back[:, i + 1])
            after = now @ move.T
            back[:, i] = np.where(used[:, i + 1, None], after / after.sum(1, keepdims=True), 1.0)
            on = used[:, i + 1]
            both = ahead[on, i][:, :, None] * move * now[on][:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(0)
        out = ahead * back
        return out / out.sum(axis=2, keepdims=True), pairs

    def word_posteriors(self, scores: np.ndarray, used: np.ndarray) -> np.ndarray:
        """As ``posteriors`` without pair sums."""
        n, t, k = scores.shape
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        move = np.exp(self.move)
        ahead, back = np.empty((t, n, k)), np.ones((n, k))
        now = local[:, 0] * np.exp(self.start)
        ahead[0] = now / now.sum(1, keepdims=True)
        for i in range(1, t):
            now = (ahead[i - 1] @ move) * local[:, i]
            ahead[i] = now / now.sum(1, keepdims=True)
        for i in range(t - 2, -1, -1):
            after = (local[:, i + 1] * back) @ move.T
            back = np.where(used[:, i + 1, None], after / after.sum(1, keepdims=True), 1.0)
            ahead[i] *= back
        return (ahead / ahead.sum(axis=2, keepdims=True)).transpose(1, 0, 2)

    def fit(self, words: np.ndarray, truth: np.ndarray, features: list[list[int]], hashes: np.ndarray, epochs: int) -> None:
        """Adagrad on the log-likelihood of chains: ``words`` indexes the distinct words (-1: unused), ``truth`` their languages."""
        sizes = np.array([len(f) for f in features])
        flat = np.fromiter((x for f in features for x in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        used, lexical = words >= 0, self.lexical(hashes)
        right = np.eye(self.k)[truth] * used[:, :, None]
        follow = np.einsum("nti,ntj->ij", right[:, :-1], right[:, 1:] * used[:, 1:, None])
        seen = np.zeros_like(self.weights), np.zeros(1), np.zeros_like(self.move), np.zeros_like(self.start)
        for _ in range(epochs):
            by_word = self.emissions(features, hashes)
            found, pairs = self.posteriors(by_word[words], used)
            diff = (right - found) * used[:, :, None]
            per = np.stack([np.bincount(words[used], diff[:, :, j][used], len(sizes)) for j in range(self.k)], 1)
            g = np.stack([np.bincount(flat, per[owner, j], FEATURES) for j in range(self.k)], 1) - 0.3 * self.weights
            grads = (g, np.array([(per * lexical).sum()]), follow - pairs - 0.3 * self.move, diff[:, 0].sum(0))
            for target, grad, total in zip((self.weights, self.trust, self.move, self.start), grads, seen):
                total += grad * grad
                target += (0.2 * grad / np.sqrt(total + 1e-6)).astype(target.dtype)


def lexicon(known: DataFrame, languages: list[str], rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and centred language shares of frequent words, counted over all rows of (text, lang)."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            held = []
            for row, end, data, offsets in pieces(batch.column("text")):
                _, _, hashes, first = words_of(data, offsets)
                held.append(np.stack((hashes.view(np.int64), np.repeat(lang[row:end], np.diff(first)))))
            both = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            word, at = np.unique(both[0], return_inverse=True)
            cell, n = np.unique(at * len(place) + both[1], return_counts=True)
            yield pa.record_batch([pa.array(word[cell // len(place)]), pa.array(cell % len(place)), pa.array(n)], names=["word", "lang", "n"])

    counts = written(known.mapInArrow(run, "word bigint, lang bigint, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    often = counts.join(totals, "lang").groupBy("word").agg(F.max(F.col("n") * rare >= F.col("total")).alias("often"), F.collect_list(F.struct("lang", "n")).alias("by")).filter("often")
    rows = often.select("word", F.explode("by").alias("x")).select("word", "x.*").toPandas()
    names, at = np.unique(rows["word"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    table = np.full((len(names), len(languages)), 0.5)
    np.add.at(table, (at, rows["lang"].to_numpy(np.int64)), rows["n"].to_numpy(float))
    logs = np.log(table / table.sum(1, keepdims=True))
    return names, np.maximum(logs, -6) - np.maximum(logs, -6).mean(1, keepdims=True)


def chains_of(first: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word positions, ``chain`` to a row (-1 behind the last), and the text each row belongs to."""
    n = np.diff(first)
    per = -(-n // chain)
    of = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    at = first[:-1][of][:, None] + nth[:, None] * chain + np.arange(chain)
    return np.where(at < first[1:][of][:, None], at, -1), of


def fitted(known: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Field | None:
    """A field for the languages of ``known`` (id, text, lang), or None without rows."""
    languages = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    field = Field(languages, lexicon(known.select("text", "lang"), languages, RARE))
    # the sample is chosen by hashes alone, so that tasks send no more than those; then its texts are fetched
    chosen = F.xxhash64("id", "text")
    keys = written(known.select(chosen.alias("chosen")).orderBy("chosen").limit(sample))
    rows = known.withColumn("chosen", chosen).join(F.broadcast(keys), "chosen", "left_semi").dropDuplicates(["chosen"]).orderBy("chosen").select("text", "lang").toPandas()
    rng = np.random.default_rng(seed)
    texts, spelled, chains, truth = pa.array(rows["text"]), {}, [], []
    for row, end, data, offsets in pieces(texts):
        starts, ends, hashes, first = words_of(data, offsets)
        at, of = chains_of(first, CHAIN)
        for i in rng.permutation(len(at))[: max(1, CHAINS * (end - row) // max(1, len(rows)))]:
            chains.append(np.where(at[i] >= 0, hashes[at[i]], np.uint64(0)))
            truth.append(np.full(CHAIN, languages.index(rows["lang"][row + of[i]])))
            for j in at[i][at[i] >= 0]:
                spelled.setdefault(int(hashes[j]), data[starts[j] : ends[j]].tobytes().decode("utf-8", "replace"))
    if not chains:
        return field
    words, langs = np.array(chains), np.array(truth)
    whole = np.flatnonzero((words != 0).all(axis=1))
    some = whole[: len(whole) // 2 * 2].reshape(-1, 2)[: len(whole) // 6]
    for a, b in some:  # two texts in one chain
        cut = int(rng.integers(4, CHAIN - 4))
        words[a, cut:], langs[a, cut:] = words[b, cut:], langs[b, cut:]
    distinct, at = np.unique(words, return_inverse=True)
    at = at.reshape(words.shape)
    if distinct[0] == 0:
        distinct, at = distinct[1:], at - 1
    features = [features_of(spelled[int(h)]) for h in distinct]
    field.fit(at, langs, features, distinct, EPOCHS)
    return field


class WordScores:
    """Emission scores by word hash; frequent words are remembered."""

    def __init__(self, field: Field):
        self.field, self.hashes, self.scores = field, np.zeros(0, np.uint64), np.zeros((0, field.k))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words, and for each word its place among them."""
        names, where, at = np.unique(hashes, return_index=True, return_inverse=True)
        out = np.zeros((len(names), self.field.k))
        known = np.zeros(len(names), bool)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, names), len(self.hashes) - 1)
            known = self.hashes[i] == names
            out[known] = self.scores[i[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            spelled = [data[starts[j] : ends[j]].tobytes().decode("utf-8", "replace") for j in where[new]]
            out[new] = self.field.emissions([features_of(w) for w in spelled], names[new])
            keep = len(self.hashes) < CACHED_WORDS
            merged = np.concatenate((self.hashes, names[new])) if keep else names
            scores = np.concatenate((self.scores, out[new])) if keep else out
            order = np.argsort(merged)
            self.hashes, self.scores = merged[order], scores[order]
        return out, at


def labelled_words(field: Field, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
    """For each text its words with their language and posterior."""
    scores, out = WordScores(field), []
    for row, end, data, offsets in pieces(pa.array(texts, pa.string())):
        starts, ends, hashes, first = words_of(data, offsets)
        found = posteriors_of(field, scores, data, starts, ends, hashes, first)
        for i in range(end - row):
            out.append([(data[starts[j] : ends[j]].tobytes().decode("utf-8", "replace"), field.languages[int(found[j].argmax())], float(found[j].max()))
                        for j in range(first[i], first[i + 1])])
    return out


def posteriors_of(field: Field, scores: WordScores, data, starts, ends, hashes, first) -> np.ndarray:
    """Posterior of every word of a piece, a few thousand chains at a time."""
    out = np.zeros((len(hashes), field.k))
    if not len(hashes):
        return out
    table, at = scores.of(data, starts, ends, hashes)
    chains, _ = chains_of(first, CHAIN)
    for i in range(0, len(chains), 4096):
        some = chains[i : i + 4096]
        used = some >= 0
        out[some[used]] = field.word_posteriors(table[at[some]], used)[used]
    return out


def languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    doc = docs[id_column].cast("bigint")
    rows = docs.select(doc.alias("id"), held_out(doc).alias("held_out"), docs[lang_column].alias("lang"), text_of(docs, text_column).alias("text"))
    field = fitted(rows.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("id", "text", "lang"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(field) if field else None
        for batch in batches:
            names, certain = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if field:
                for row, end, data, offsets in pieces(batch.column("text")):
                    starts, ends, hashes, first = words_of(data, offsets)
                    found = posteriors_of(field, scores, data, starts, ends, hashes, first)
                    n = np.diff(first)
                    some = np.flatnonzero(n)
                    if len(some):
                        mean = np.add.reduceat(found, first[:-1][some]) / n[some, None]
                        for i, m in zip(some, mean):
                            span = data[offsets[i] : offsets[i + 1]]
                            if NO_LETTER[span[span < 128]].all() and not any(c.isalpha() for c in span.tobytes().decode("utf-8", "replace")):
                                continue
                            names[row + i], certain[row + i] = field.languages[int(m.argmax())], min(1.0, float(m.max()))
            yield pa.record_batch([batch.column("id"), batch.column("held_out"), pa.array(names), pa.array(certain)], names=["id", "held_out", "lang_pred", "score"])

    return rows.select("id", "held_out", "text").mapInArrow(run, "id bigint, held_out boolean, lang_pred string, score double")
