"""Operator 13: language of texts and of their parts. Script ranges narrow the languages, then Viterbi over scores of words with a penalty for switching labels spans.

A word is a run of letters. Its script (the one that most of its letters have) leaves the languages that are written in it; each of these gets the log-probability of the word's runs of 2 to 4 letters, whose
counts stand in 2**BITS buckets for each language. Viterbi gives each word a language such that the scores less SWITCH for each change are highest; neighbouring words of one language are a span. All texts of a batch take a
step at a time. A text's language is that of most letters; its score is their share times the probability that the sums of the words' scores give it.

Learning: at most MOST_ROWS rows of each language, those of least hash, of the MOST_LANGUAGES most frequent values of lang (by name among equals); a language has a script if SCRIPT_SHARE of its letters are of it.

Results: ``und`` with score 0 for null texts and texts without a letter, and for all if nothing could be learned. Words of a script that no language has fit all alike. Ties go to the language first by name. Repeated
rows each have a row, and are learned once. Ids may be null or of any type. Very long texts are read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import held_out
from .shared import text_or_empty, without_collector

UNKNOWN = "und"
#: Bounds of the fit; buckets of the counts, and what each holds to begin with; cost of another language than the word before; characters labelled at a time.
MOST_ROWS, MOST_LANGUAGES, SCRIPT_SHARE = 4000, 64, 0.01
BITS, FLOOR, SWITCH, STEP_CHARS = 17, 0.05, 15.0, 8_000_000
_ORDERS, _FAR = (2, 3, 4), np.float32(-1e4)
_WORD = re.compile(r"[^\W\d_]+")

# Scripts and the first code points of their ranges; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x1AFF0, "kana"), (0x1B170, "other"), (0x20000, "han"),
]
NAMES = sorted({s for _, s in SCRIPTS})
_FIRST = np.array([c for c, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS], np.int64)


class Words:
    """Distinct words as runs of letters: of which word each is, and its bucket; letters of each script in each word."""

    def __init__(self, words: list[str]):
        lower = [w.lower() for w in words]
        code = np.frombuffer("".join(f"\x01{w}\x01" for w in lower).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter((len(w) + 2 for w in lower), np.int64, len(lower))
        of = np.repeat(np.arange(len(lower)), size)
        word, bucket, h = [], [], code.astype(np.uint64)
        for n in range(2, max(_ORDERS) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] if len(h) else h
            if n in _ORDERS:
                same = of[: len(h)] == of[n - 1 :]
                mixed = (h[same] ^ (h[same] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                word.append(of[: len(h)][same])
                bucket.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        self.of, self.bucket = np.concatenate(word), np.concatenate(bucket)
        letter = code != 1
        script = _SCRIPT[np.searchsorted(_FIRST, code[letter], side="right") - 1]
        self.scripts = np.bincount(of[letter] * len(NAMES) + script, minlength=len(words) * len(NAMES)).reshape(-1, len(NAMES))


def _cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, which of them stand in turn in all texts, and where each text's end. A word has a letter."""
    cut = [_WORD.findall(t) for t in texts]
    coded = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
    names, at, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum([len(c) for c in cut])
    real = np.fromiter((any(c.isalpha() for c in w) for w in names), bool, len(names))
    if not real.all():
        on = real[at]
        ends = np.concatenate([[0], np.cumsum(on)])[ends]
        at = (np.cumsum(real) - 1)[at[on]]
        names = [w for w, ok in zip(names, real) if ok]
    return names, at, ends


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages: log-probabilities
    written_in: np.ndarray  # scripts x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        own = Words(words)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(own.of, self.table[own.bucket, k], len(words))
        fits = self.written_in[own.scripts.argmax(1)]
        out[~fits.any(1)] = 0
        return np.where(fits | ~fits.any(1)[:, None], out, _FAR)


def viterbi(scores: np.ndarray, at: np.ndarray, ends: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word. scores: of the distinct words; at: the words of all texts in turn; ends: of the texts. All texts take a step at a time; the longest come first, so those that go on stand together."""
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    first, size = starts[order], size[order]
    on = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")  # texts with a word at each step
    value = np.zeros((len(size), scores.shape[1]), np.float32)
    changed, before = np.zeros((len(at), scores.shape[1]), bool), np.zeros(len(at), np.int16)
    for t, m in enumerate(on):
        here, own = first[:m] + t, value[:m]
        if t:
            best = own.argmax(1)
            other = own[np.arange(m), best] - np.float32(switch)
            own -= other[:, None]
            changed[here] = own < 0
            before[here] = best
            np.maximum(own, 0, out=own)  # from here on in parts above ``other``, which are all that comparisons need
        own += scores[at[here]]
    label, state = np.zeros(len(at), np.int16), value.argmax(1).astype(np.int16) if len(size) else np.zeros(0, np.int16)
    for t in range(len(on) - 1, -1, -1):
        here, own = first[: on[t]] + t, state[: on[t]]
        label[here] = own
        if t:
            state[: on[t]] = np.where(changed[here, own], before[here], own)
    return label


def _steps(batches: Iterator[pa.RecordBatch]):
    """Columns but the last, and texts, of about STEP_CHARS."""
    held, texts, chars = [], [], 0
    for b in batches:
        for k, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
            texts.append(t)
            chars += len(t)
        held.append(b)
        if chars >= STEP_CHARS:
            yield pa.Table.from_batches(held).combine_chunks(), texts
            held, texts, chars = [], [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), texts


def fit(docs: DataFrame, most: int = MOST_ROWS, languages: int = MOST_LANGUAGES) -> Model | None:
    """Learn from the rows with a lang that aren't held out."""
    own = docs.where(~held_out() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("_lang"), text_or_empty().alias("_text"), F.xxhash64(F.col("doc_id").cast("string"), text_or_empty()).alias("_key"))
    names = sorted(r._lang for r in own.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).collect())
    if not names:
        return None
    # the keys of the sample: at most ``most`` times ``languages``
    keys = own.where(F.col("_lang").isin(names)).groupBy("_lang", "_key").agg(F.lit(1).alias("_one"))
    keys = keys.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_key"))).where(F.col("_n") <= most).select("_lang", "_key")
    sample = own.join(F.broadcast(keys), ["_lang", "_key"]).groupBy("_lang", "_key").agg(F.min("_text").alias("_text")).select("_lang", "_text")

    def run(batches):
        counts, scripts = {}, {}
        for t, texts in _steps(batches):
            lang = np.array(t["_lang"].to_pylist(), object)
            words, at, ends = _cut(texts)
            if not words:
                continue
            x, of_word = Words(words), np.repeat(lang, np.diff(ends, prepend=0))
            for name in set(of_word):
                times = np.bincount(at[of_word == name], minlength=len(words))
                counts[name] = counts.get(name, 0) + np.bincount(x.bucket, times[x.of], 1 << BITS)
                scripts[name] = scripts.get(name, 0) + times @ x.scripts
        for name, n in counts.items():
            for kind, v in (("letters", n), ("script", scripts[name])):
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at].astype(np.int64))], ["lang", "kind", "place", "n"])

    # a row for each language and bucket that it fills
    found = sample.mapInArrow(run, "lang string, kind string, place int, n long").groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, place, n = (found[c].to_numpy() if c in ("place", "n") else np.array(found[c].to_pylist(), object) for c in ("lang", "kind", "place", "n"))
    names = sorted(set(lang))
    if not names:
        return None
    table, written_in = np.zeros((1 << BITS, len(names)), np.float32), np.zeros((len(NAMES), len(names)), bool)
    for k, name in enumerate(names):
        own, letters = lang == name, kind == "letters"
        count = np.full(1 << BITS, FLOOR)
        count[place[own & letters]] += n[own & letters]
        table[:, k] = np.log(count / count.sum())
        share = np.bincount(place[own & ~letters], n[own & ~letters], len(NAMES))
        written_in[:, k] = share >= SCRIPT_SHARE * share.sum()
        written_in[share == 0, k] = False
    return Model(tuple(names), table, written_in)


def judged(texts: list[str], model: Model):
    """The words' languages (as numbers), where each text's words end, and each text's language and score."""
    words, at, ends = _cut(texts)
    if not words:
        return np.zeros(0, np.int16), ends, [UNKNOWN] * len(texts), np.zeros(len(texts))
    scores, n = model.word_scores(words), len(model.languages)
    label = viterbi(scores, at, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    letters = np.bincount(doc * n + label, np.fromiter(map(len, words), np.int64, len(words))[at], len(texts) * n).reshape(-1, n)
    whole = np.stack([np.bincount(doc, scores[at, k], len(texts)) for k in range(n)], 1)
    best, all_ = letters.argmax(1), letters.sum(1)
    rows = np.arange(len(texts))
    likely = np.exp(whole - whole.max(1, keepdims=True))
    score = letters[rows, best] / np.maximum(all_, 1) * likely[rows, best] / likely.sum(1)
    return label, ends, [model.languages[k] if m else UNKNOWN for k, m in zip(best, all_)], np.where(all_ > 0, score, 0.0)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, and spans: start and end (characters; the next span's start), and language."""
    return _labelled(docs, model, True)


def _labelled(docs: DataFrame, model: Model | None, spans: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def cut(text: str, label: np.ndarray) -> list[dict]:
        starts = [m.start() for m in _WORD.finditer(text) if any(c.isalpha() for c in m[0])]
        new = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1)] if len(label) else []
        places = [0, *(starts[k] for k in new[1:]), len(text)]
        return [{"start": s, "end": e, "lang": model.languages[label[k]]} for k, s, e in zip(new, places, places[1:])]

    def run(batches):
        for t, texts in _steps(without_collector(batches)):
            if model is None:
                label, ends, pred, score = np.zeros(0, np.int16), np.zeros(len(texts), np.int64), [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                label, ends, pred, score = judged(texts, model)
            columns = [t["doc_id"].chunk(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array([cut(x, label[s:e]) for x, s, e in zip(texts, np.concatenate([[0], ends[:-1]]), ends)], span))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return docs.select("doc_id", text_or_empty().alias("_text")).mapInArrow(run, out)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from and said of the same table."""
    return _labelled(docs, fit(docs), False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
