"""Document and segment languages by rank-order n-gram profiles.

A profile is a language's most frequent n-grams (one to three letters, word
edges included) in rank order. A text's own n-grams are ranked the same way,
and its distance to a profile is the sum of how far each is out of place; an
n-gram that the profile lacks counts as FAR. N-grams that no profile has are
as far from all and are left out. A batch of texts is one array of code
points: all n-grams, their counts and ranks come from sorts over the batch.

Profiles are trained on labelled documents, at most SAMPLE a label, chosen by
the hash of doc_id. Labels may be wrong: the second pass learns only from the
paragraphs that the first takes for the label's language. Everything else is
computed over whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternlog.llm.words import LETTER, classes
from lanternlog.session import spread

LANGUAGES = ["de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru", "zh"]
SAMPLE, TOP, FAR = 300, 400, 400
NONE = -1


@functools.lru_cache(1)
def folded() -> np.ndarray:
    """Lower-case letter of each code point; 0 for all that is no letter."""
    out = np.zeros(0x110000, np.int64)
    letters = np.flatnonzero(classes() == LETTER)
    out[letters] = letters
    for code in letters[letters < 0x2000].tolist():
        low = chr(code).lower()
        out[code] = ord(low) if len(low) == 1 else code
    return out


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Parts of a list of texts of about `most` characters, one text at least."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, text of each) of all texts; a key holds up to three code points of 21 bits."""
    joined = "\x00".join(texts) + "\x00"
    code = folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)  # one blank for a run of others
    code, owner = code[keep], owner[keep]
    word = code != 0
    keys, owners = [code[word]], [owner[word]]
    two = word[:-1] | word[1:]
    two &= owner[:-1] == owner[1:]
    keys.append((code[:-1] << 21 | code[1:] | 1 << 62)[two])
    owners.append(owner[:-1][two])
    three = word[1:-1] & (owner[:-2] == owner[2:])
    keys.append((code[:-2] << 42 | code[1:-1] << 21 | code[2:])[three])
    owners.append(owner[:-2][three])
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class Profiles:
    """keys: ascending n-gram keys; ranks: keys x languages, FAR where a language lacks one."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        """From (language, key, rank)."""
        languages = sorted({r[0] for r in rows})
        keys = np.array(sorted({r[1] for r in rows}), np.int64)
        ranks = np.full((len(keys), len(languages)), FAR, np.int32)
        for language, key, rank in rows:
            ranks[np.searchsorted(keys, key), languages.index(language)] = rank
        return cls(languages, keys, ranks)

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest language, confidence from 0 to 1); NONE and 0 for a text without letters. Some million characters at a time, a text whole."""
        found = [self._classify(part) for part in slices(texts)] or [(np.zeros(0, np.int64), np.zeros(0))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(texts), len(self.languages)
        if not n or not k:
            return np.full(n, NONE), np.zeros(n)
        key, owner = grams(texts)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        # counts of each (text, n-gram), then ranks by falling count inside each text
        both = np.sort(owner[known] * len(self.keys) + at[known])
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(both)]]))
        owner, gram = np.divmod(both[first], len(self.keys))
        order = np.argsort(owner * (1 << 32) - np.minimum(count, (1 << 31) - 1), kind="stable")
        owner, gram = owner[order], gram[order]
        begin = np.searchsorted(owner, np.arange(n))
        rank = np.arange(len(owner)) - begin[owner]
        use = rank < TOP
        owner, gram, rank = owner[use], gram[use], rank[use]
        away = np.zeros((n, k))
        for j in range(k):
            there = self.ranks[gram, j]
            away[:, j] = np.bincount(owner, weights=np.where(there == FAR, FAR, np.abs(there - rank)), minlength=n)
        some = np.bincount(owner, minlength=n) > 0
        best = np.where(some, away.argmin(1), NONE)
        two = np.sort(away, 1)[:, :2]
        return best, np.where(some, 1 - two[:, 0] / np.maximum(two[:, -1], 1), 0.0) if k > 1 else some.astype(float)


def paragraphs(text: str | None, kinds: list | None, starts: list | None, lengths: list | None) -> list[tuple[int, int, str]]:
    """(cell_no, para_no, paragraph) of the text cells; cells that reach beyond the text end with it."""
    if not text or not kinds:
        return []
    out = []
    for i, (kind, start, length) in enumerate(zip(kinds, starts or [], lengths or [])):
        if kind == "text" and start is not None and length:
            out += [(i, j, p) for j, p in enumerate(text[start : start + length].split("\n\n"))]
    return out


def label_language(label: Column) -> Column:
    """The language that a label names, null if none: capitals, a region and blanks don't matter."""
    code = F.lower(F.trim(F.split_part(F.regexp_replace(label, "_", "-"), F.lit("-"), F.lit(1))))
    return F.when(code.rlike("^[a-z]{2,3}$") & ~code.isin("xx", "und", "mul", "zxx", "mis", "unk", "nan"), code)


COLUMNS = ["text", "cell_kind", "cell_start", "cell_len"]


def _cells(batch: pa.RecordBatch, size: int = 2000) -> Iterator[tuple[int, list[list[tuple[int, int, str]]]]]:
    """(first row, the paragraphs of each row), some rows at a time."""
    for a in range(0, batch.num_rows, size):
        part = batch.slice(a, size)
        yield a, [paragraphs(*row) for row in zip(*(part[c].to_pylist() for c in COLUMNS))]


def _count(profiles: Profiles | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch["_label"].to_pylist()
            for a, rows in _cells(batch):
                by: dict[str, list[str]] = {}
                for label, cells in zip(labels[a:], rows):
                    by.setdefault(label, []).extend(p for _, _, p in cells)
                for label, texts in by.items():
                    if profiles is not None and label in profiles.languages:
                        best, _ = profiles.classify(texts)
                        texts = [t for t, b in zip(texts, best.tolist()) if b == profiles.languages.index(label)]
                    for part in slices(texts):
                        key, n = np.unique(grams(part)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([label] * len(key)), pa.array(key), pa.array(n)], ["label", "key", "n"])

    return run


def train(documents: DataFrame, languages: list[str] = LANGUAGES, sample: int = SAMPLE, top: int = TOP) -> Profiles:
    """Profiles of the languages that some label names, from at most `sample` documents a label."""
    rows = documents.where(F.exists("cell_kind", lambda k: k == "text")).select("doc_id", label_language(F.col("lang")).alias("_label"), *COLUMNS).where(F.col("_label").isin(languages))
    chosen = Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the ids first, so that the sort by rank moves no texts
    ids = rows.select("doc_id", "_label").withColumn("_n", F.row_number().over(chosen)).where(F.col("_n") <= sample).select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids)  # at most languages x sample ids
    rows = rows.join(ids, rows["doc_id"] == ids["_id"], "left_semi")
    profiles = None
    for _ in range(2):
        counts = rows.mapInArrow(_count(profiles), "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "key")) - 1).where(F.col("rank") < top)
        got = [(r.label, r.key, r["rank"]) for r in ranked.select("label", "key", "rank").collect()]  # languages x top
        if got:
            profiles = Profiles.of(got)
    return profiles or Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int32))


def _assign(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*profiles.languages, None]
        for batch in batches:
            ids, labels = batch["doc_id"].to_pylist(), batch["_label"].to_pylist()
            for a, rows in _cells(batch):
                flat = [(a + i, c, p, t) for i, cells in enumerate(rows) for c, p, t in cells]
                if not flat:
                    continue
                best, sure = profiles.classify([t for *_, t in flat])
                doc, chars = np.array([r[0] for r in flat]), np.array([len(r[3]) for r in flat], np.int64)
                # characters of each document by language; most of them decide
                weight = np.zeros((batch.num_rows, len(names)))
                np.add.at(weight, (doc, best), chars)
                told = weight[:, :-1]
                main = np.where(told.sum(1) > 0, told.argmax(1) if told.shape[1] else NONE, NONE)
                share = told.max(1, initial=0) / np.maximum(told.sum(1), 1)
                docs = np.unique(doc)
                out = {
                    "doc_id": [ids[i] for i in docs] + [ids[i] for i in doc], "cell_no": [-1] * len(docs) + [r[1] for r in flat], "para_no": [-1] * len(docs) + [r[2] for r in flat],
                    "lang": [names[main[i]] for i in docs] + [names[b] for b in best], "confidence": [*share[docs], *sure],
                    "main_lang": [names[main[i]] for i in docs] + [names[main[i]] for i in doc], "label_lang": [labels[i] for i in docs] + [labels[i] for i in doc],
                }
                yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("cell_no", pa.int64()), ("para_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("main_lang", pa.string()), ("label_lang", pa.string())])


def assign(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, cell_no, para_no, lang, confidence, main_lang, label_lang.

    A row a document with text cells (cell_no = para_no = -1: the language of
    most characters, its confidence their share) and a row a paragraph of a
    text cell (confidence: how much nearer the best profile is than the next).
    lang is null for paragraphs without letters and documents of only such.
    Null, empty and cell-less documents give no row; equal doc_ids are
    documents of their own. No shuffle unless there are fewer files than cores.
    """
    rows = spread(documents.select("doc_id", label_language(F.col("lang")).alias("_label"), *COLUMNS))
    return rows.mapInArrow(_assign(profiles), "doc_id long, cell_no long, para_no long, lang string, confidence double, main_lang string, label_lang string")


def found(assigned: DataFrame) -> DataFrame:
    """Of assigned rows: documents whose label is missing or wrong, and paragraphs in another language than their document."""
    document = (F.col("cell_no") == -1) & ~F.col("label_lang").eqNullSafe(F.col("lang"))
    segment = (F.col("cell_no") >= 0) & (F.col("lang") != F.col("main_lang"))
    return assigned.where(F.col("lang").isNotNull() & (document | segment)).select("doc_id", "cell_no", "para_no", "lang")
