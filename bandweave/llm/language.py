"""Language identification by a linear-chain conditional random field over words.

Each word has features from its bytes (lower-cased): hashed n-grams of 3 and 4 bytes with the spaces around it, its first
and last three bytes, and its entry in a lexicon of frequent words. Their weights and those of transitions between
labels are learned together by maximum likelihood (Adagrad; the gradient by forward-backward). Forward-backward over a
whole text gives every word its distribution over languages, so code-switched texts get a label for each word;
a text's language is that with the most expected words.

Learning uses a bounded sample of rows: about `sample` whole texts of each language, chosen by a hash of doc_id. As a text has one label, sequences for training are put together from stretches of texts of several languages,
from which the transitions are learned. Prediction covers whole texts.

Cases: texts that are null or have no letter get `und` and score 0. Words without a letter take part in the chain and count
for no language. Rows that repeat are treated alike. Without any labelled text everything is `und`; with one language
all texts with a letter get it, at score 1. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.llm import words as W
from bandweave.llm.common import map_arrow

U32, U64 = np.uint32, np.uint64
NGRAMS = {3: 15, 4: 16}  # bytes: bits of their table
AFFIX_BITS = 13
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
LEXICON = 500
#: Bytes of text whose words move through the chain together; more take fewer steps.
STEP = 4 << 20


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """n bytes from each place on as one number; past the end zeros."""
    padded = np.concatenate([data, np.zeros(n - 1, np.uint8)]).astype(U32)
    out = padded[: len(data)].copy()
    for k in range(1, n):
        out |= padded[k : k + len(data)] << U32(8 * k)
    return out


def _bins(codes: np.ndarray, bits: int, salt: int) -> np.ndarray:
    x = (codes ^ U32(salt)) * U32(0x9E3779B1)
    x ^= x >> U32(15)
    return (x * U32(0x85EBCA6B) >> U32(32 - bits)).astype(np.int64)


@dataclass
class Features:
    """Of the words of some texts: for each n-gram table the bins by place and each word's first and last place; for
    prefix and suffix a bin, for the lexicon an entry (the last one: not in it)."""

    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    affixes: list[np.ndarray]
    entry: np.ndarray


def features(t: W.Texts, lexicon: np.ndarray) -> Features:
    """t holds lower-cased texts with a space before and after each."""
    data = np.where(W.IS_WORD[t.data], t.data, np.uint8(32))
    grams = []
    for n, bits in NGRAMS.items():
        last = np.maximum(t.ends + 2 - n, t.starts - 1)  # n-grams that begin from the space before on and end with that behind
        grams.append((_bins(_codes(data, n), bits, n), t.starts - 1, last))
    three = _codes(data, 3) if len(data) else np.empty(0, U32)
    size = t.ends - t.starts
    mask = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], U32)[np.minimum(size, 3)]
    head = three[t.starts] & mask
    tail = three[np.maximum(t.ends - 3, t.starts)] & mask
    h = W.hashed(t.data, t.starts, t.ends)
    at = np.minimum(np.searchsorted(lexicon, h), max(len(lexicon) - 1, 0))
    entry = np.where(lexicon[at] == h, at, len(lexicon)) if len(lexicon) else np.zeros(len(h), np.int64)
    return Features(grams, [_bins(head, AFFIX_BITS, 0x51), _bins(tail, AFFIX_BITS, 0xA3)], entry)


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray
    tables: list[np.ndarray]  # n-grams, prefixes, suffixes, lexicon: (bins, languages)
    moves: np.ndarray  # from, to
    first: np.ndarray

    @classmethod
    def empty(cls, languages: list[str], lexicon: np.ndarray) -> Model:
        k = len(languages)
        sizes = [*(1 << b for b in NGRAMS.values()), 1 << AFFIX_BITS, 1 << AFFIX_BITS, len(lexicon) + 1]
        return cls(languages, lexicon, [np.zeros((n, k), np.float32) for n in sizes], np.zeros((k, k)), np.zeros(k))

    def emissions(self, f: Features) -> np.ndarray:
        """The weight of each word for each language."""
        out = np.zeros((len(f.entry), len(self.languages)))
        n = len(f.grams)
        for (bins, first, last), table in zip(f.grams, self.tables[:n], strict=True):
            for k in range(out.shape[1]):
                run = np.concatenate([[0.0], np.cumsum(table[bins, k], dtype=np.float64)])
                out[:, k] += run[last] - run[first]
        for at, table in zip((*f.affixes, f.entry), self.tables[n:], strict=True):
            out += table[at]
        return out


def forward_backward(emission: np.ndarray, begins: np.ndarray, model: Model, expected: np.ndarray | None = None) -> np.ndarray:
    """Marginals of all words; text i has the rows from begins[i] to begins[i + 1]. All texts move on by a word at a time, the
    longest first. Adds the expected transitions to `expected`."""
    n = np.diff(begins)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], begins[:-1][order]
    score = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
    move, first = np.exp(model.moves - model.moves.max()), np.exp(model.first - model.first.max())
    out = np.empty_like(score)
    live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")  # texts with so many words
    now = None
    for t, c in enumerate(live):
        rows = start[:c] + t
        now = (first if now is None else now[:c] @ move) * score[rows]
        now /= now.sum(axis=1, keepdims=True)
        out[rows] = now
    back = None
    for t in range(len(live) - 1, -1, -1):
        c, rows = live[t], start[: live[t]] + t
        ahead = np.ones((c, len(first)))
        if back is not None:
            m = len(back)
            following = score[rows[:m] + 1] * back
            ahead[:m] = following @ move.T
            if expected is not None:
                joint = out[rows[:m], :, None] * move[None] * following[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            ahead /= ahead.sum(axis=1, keepdims=True)
        now = out[rows] * ahead
        out[rows] = now / now.sum(axis=1, keepdims=True)
        back = ahead
    return out


def padded(texts: pa.Array) -> pa.Array:
    """Texts in lower case with a space before and after; null counts as empty."""
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    space = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(space, low, space, pa.scalar("", pa.large_string()))


def stretches(texts: list[tuple[str, str]], rng: np.random.Generator, length: int = 120) -> tuple[list[str], list[list[str]]]:
    """Sequences of about `length` words, and the language of each word, put together from stretches of 4 to 60 words."""
    left = {}
    for lang, text in texts:
        left.setdefault(lang, []).extend(text.split())
    at, sequences, labels = dict.fromkeys(left, 0), [], []
    names = sorted(left)
    while any(at[x] < len(left[x]) for x in names):
        sequence, label = [], []
        while len(sequence) < length:
            open_ = [x for x in names if at[x] < len(left[x])]
            if not open_:
                break
            x = open_[rng.integers(len(open_))]
            part = left[x][at[x] : at[x] + int(rng.integers(4, 61))]
            at[x] += len(part)
            sequence += part
            label += [x] * len(part)
        if sequence:
            sequences.append(" ".join(sequence))
            labels.append(label)
    return sequences, labels


def trained(texts: list[tuple[str, str]], epochs: int = 25, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> Model:
    """A model from (language, text) pairs."""
    texts = sorted(texts)
    languages = sorted({lang for lang, _ in texts})
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang in languages:
        h = [W.hashed(t.data, t.starts, t.ends) for t in W.texts(padded(pa.array([x for y, x in texts if y == lang], pa.large_string())))]
        values, n = np.unique(np.concatenate(h), return_counts=True)
        top = np.lexsort([values, -n])[:LEXICON]
        counts[lang] = values[top[n[top] > 1]]
    model = Model.empty(languages, np.unique(np.concatenate([np.empty(0, U64), *counts.values()])))
    if len(languages) < 2:
        return model
    sequences, labels = stretches(texts, np.random.default_rng(seed))
    parts = []
    for t in W.texts(padded(pa.array(sequences, pa.large_string()))):
        own = [languages.index(x) for label in labels[t.first : t.first + len(t)] for x in label]
        parts.append((features(t, model.lexicon), t.words, np.array(own)))
    k = len(languages)
    total = sum(len(y) for _, _, y in parts)
    state = [np.full_like(x, 1e-8, dtype=np.float64) for x in (*model.tables, model.moves, model.first)]
    for _ in range(epochs):
        grads = [np.zeros(x.shape) for x in (*model.tables, model.moves, model.first)]
        for f, begins, y in parts:
            expected = np.zeros((k, k))
            miss = np.eye(k)[y] - forward_backward(model.emissions(f), begins, model, expected)
            inside = np.ones(len(y), bool)
            inside[begins[:-1]] = False
            later = np.flatnonzero(inside)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[later - 1], y[later]), 1)
            grads[-2] += seen - expected
            grads[-1] += miss[begins[:-1]].sum(axis=0)
            for (bins, first, last), g in zip(f.grams, grads, strict=False):
                size = last - first
                place = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                for c in range(k):
                    g[:, c] += np.bincount(bins[place], weights=np.repeat(miss[:, c], size), minlength=len(g))
            for at, g in zip((*f.affixes, f.entry), grads[len(NGRAMS) : -2], strict=True):
                for c in range(k):
                    g[:, c] += np.bincount(at, weights=miss[:, c], minlength=len(g))
        for x, g, s in zip((*model.tables, model.moves, model.first), grads, state, strict=True):
            g = g / total - decay * x
            s += g * g
            x += (rate * g / np.sqrt(s)).astype(x.dtype)
    return model


def _alphabetic(t: W.Texts, i: int) -> bool:
    return any(c.isalpha() for c in t.text(i).decode("utf-8", "replace"))


def predicted(column: pa.Array, model: Model, runs: bool = False) -> tuple[list[str], np.ndarray, list[list[tuple[str, int]]]]:
    """Language, score, and on request the runs (language, words) of each text."""
    n = len(column)
    lang, score, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    if not model.languages:
        return lang, score, found
    for t in W.texts(padded(column), step=STEP):
        letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[t.data] | (t.data >= 0x80))])
        spelled = letters[t.ends] > letters[t.starts]
        chance = forward_backward(model.emissions(features(t, model.lexicon)), t.words, model)
        owner = np.repeat(np.arange(len(t)), np.diff(t.words))
        words = np.bincount(owner, weights=spelled, minlength=len(t))
        mass = np.stack([np.bincount(owner, weights=spelled * chance[:, k], minlength=len(t)) for k in range(len(model.languages))], axis=1)
        best = mass.argmax(axis=1)
        plain = np.concatenate([[0], np.cumsum(ASCII_LETTER[t.data])])[t.at]
        for i in np.flatnonzero(words > 0):
            if plain[i + 1] > plain[i] or _alphabetic(t, i):
                lang[t.first + i] = model.languages[best[i]]
                score[t.first + i] = min(1.0, mass[i, best[i]] / words[i])
                if runs:
                    label = chance[t.words[i] : t.words[i + 1]].argmax(axis=1)
                    edge = np.flatnonzero(np.diff(label, prepend=-1, append=-1))
                    found[t.first + i] = [(model.languages[label[a]], int(b - a)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return lang, score, found


def fit(docs: DataFrame, sample: int = 100, seed: int = 17) -> Model:
    """A model from documents (doc_id, text, lang) whose lang isn't null."""
    known = docs.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, sample / n))) for x, n in sorted(counts.items()))) if counts else F.lit(0.0)
    got = known.where(unit < share).select("lang", "text").collect()  # about `sample` rows of each language
    return trained([(r.lang, r.text) for r in got])


def identify(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, and on request `runs`: the languages of its words in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, found = predicted(batch.column("text"), shared.value, runs)
            columns = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)]
            if runs:
                columns.append(pa.array([[{"lang": x, "words": n} for x, n in r] for r in found], kind))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "runs"][: len(columns)])

        return step

    schema = "doc_id long, lang_pred string, score double" + ", runs array<struct<lang: string, words: long>>" * runs
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify_held_out(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that aren't held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), **options)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
