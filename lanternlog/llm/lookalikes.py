"""Visually identical text: one consistent form, on numpy code-point arrays.

The distinct texts of an Arrow batch become one array of code points. A lookup
table gives each code point the length and place of what it expands to (its
compatibility decomposition, with look-alike letters, blanks and dashes made
one and invisible characters gone); the expansion is one gather. Marks are then
put in canonical order and composed with their bases by table lookups over the
whole array. No text is handled alone. Case, accents and spelling are kept.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Letters that look like a Latin letter in common fonts, by script.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝѵӏАВЕІЈКМНОРСТУХЅҮԌԚԜѴӀ", "aeopcyxisjhdqwvlABEIJKMHOPCTYXSYGQWVl"))
GREEK = dict(zip("αγινορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ", "ayivopucjABEZHIKMNOPTYXCM"))
ARMENIAN = dict(zip("օսհոզցՕՍՏԼ", "ouhnqgOUSL"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏚᎢᏙᏔᏃ", "ABCDEGHiJKLMPSTVWZ"))
LATIN = dict(zip("ɑɡıȷᴄᴏꜱᴠᴡᴢ", "agijcosvwz"))
CHEROKEE_SMALL = dict(zip("ꭵꮁꮃꮓꮩꮪꮯ", "irwzvsc"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥⲣ", "HIKMNOPCTYXocp"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
DESERET = dict(zip("𐐄𐐕𐐛𐐠𐐬𐐽𐑈", "OCLSocs"))
ROUND = dict.fromkeys("०੦૦௦౦೦൦๐໐၀סօ", "o")
MARKS_OF_TEXT = dict(zip("‘’ʼʹ′ꞌ‛“”„‟″∶꞉ː∕⁄⧵∖․∙", "'''''''\"\"\"\"\"::://\\\\.·"))
DASHES = "‐‑‒–—―−⁃－﹣˗"
LOOKALIKES = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **CHEROKEE_SMALL, **COPTIC, **LISU, **DESERET, **LATIN, **ROUND, **MARKS_OF_TEXT, **dict.fromkeys(DASHES, "-")}
INVISIBLE = "᠎͏ᅟᅠ឴឵ㅤﾠ"
LIMIT = 0x110000
HANGUL = range(0xAC00, 0xD7A4)


def _shown(char: str) -> str:
    """What one decomposed character is shown as."""
    kind = unicodedata.category(char)
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if kind == "Cf" or char in INVISIBLE or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF:
        return ""
    return " " if kind == "Zs" else "-" if kind == "Pd" else char


@functools.lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, place, pool) of the expansions, the combining classes, and keys and values of the compositions."""
    length, place = np.ones(LIMIT, np.int64), np.arange(LIMIT)
    ccc = np.zeros(LIMIT, np.uint8)
    special: dict[int, list[int]] = {}
    pairs: dict[int, int] = {}
    for code in range(LIMIT):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.category(char) == "Cn":
            continue
        ccc[code] = unicodedata.combining(char)
        whole = unicodedata.normalize("NFKD", char)
        shown = "".join(map(_shown, whole))
        # what a look-alike, blank or dash becomes is decomposed already
        if shown != char:
            special[code] = [ord(c) for c in shown]
        if code not in HANGUL and (parts := unicodedata.decomposition(char)) and parts[0] != "<":
            two = [int(x, 16) for x in parts.split()]
            if len(two) == 2 and unicodedata.normalize("NFC", char) == char:
                pairs[two[0] << 21 | two[1]] = code
    pool_array = [np.arange(LIMIT, dtype=np.int64)]
    extra: list[int] = []
    for code, out in special.items():
        length[code], place[code] = len(out), LIMIT + len(extra)
        extra += out
    pool_array.append(np.array(extra, np.int64))
    keys = np.array(sorted(pairs), np.int64)
    return length, place, np.concatenate(pool_array), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


def consistent(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points in the consistent form, owner of each); owner: the text of each code point, ascending."""
    length, place, pool, ccc, keys, values = tables()
    if not len(codes):
        return codes.astype(np.int64), owner
    size = length[codes]
    total = int(size.sum())
    begin = np.cumsum(size) - size
    owner = np.repeat(owner, size)
    out = pool[np.repeat(place[codes] - begin, size) + np.arange(total)]
    if not total:
        return out, owner
    # marks in canonical order: swap neighbours until none is out of order
    while True:
        k = ccc[out]
        wrong = np.flatnonzero((k[:-1] > k[1:]) & (k[1:] > 0) & (owner[:-1] == owner[1:]))
        if not len(wrong):
            break
        apart = wrong[np.concatenate([[True], np.diff(wrong) > 1])]
        out[apart], out[apart + 1] = out[apart + 1], out[apart].copy()
    # compose a base with the mark next to it until nothing changes
    while len(out) > 1:
        pair = out[:-1] << 21 | out[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == pair) & (owner[:-1] == owner[1:]))
        if not len(hit):
            break
        hit = hit[np.concatenate([[True], np.diff(hit) > 1])]
        out[hit] = values[at[hit]]
        keep = np.ones(len(out), bool)
        keep[hit + 1] = False
        out, owner = out[keep], owner[keep]
    return out, owner


def consistent_texts(texts: pa.Array) -> pa.Array:
    """The consistent form of each text; null stays null, empty stays empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    codes = np.frombuffer(data[ends[0] : ends[-1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    out, owner = consistent(codes, np.repeat(np.arange(len(texts)), chars))
    # UTF-8 bytes of the new code points, and where each text's bytes end
    width = np.select([out < 0x80, out < 0x800, out < 0x10000], [1, 2, 3], 4)
    size = np.bincount(owner, weights=width, minlength=len(texts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")))


def add_form(column: str, to: str, keep: list[str]):
    """A mapInArrow function: the columns of `keep` and the consistent form of `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = pc.dictionary_encode(batch[column])
            form = consistent_texts(coded.dictionary).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), form], [*keep, to])

    return run


def match_names(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """src, row_id, field, text, name_id, name of each value that looks like a name of its field but is other characters.

    values: src, row_id, field, text; catalog: name_id, field, name. Values
    that are a name of their field character for character, null and empty
    values are no matches. Of names that look alike the smallest name_id
    counts. Blanks at the ends count like all blanks.
    """
    names = catalog.where("name is not null and field is not null").select("name_id", "field", "name").mapInArrow(add_form("name", "_form", ["name_id", "field", "name"]), "name_id long, field string, name string, _form string")
    names = names.groupBy(F.col("field").alias("_field"), "_form").agg(F.min("name_id").alias("name_id"), F.min_by("name", "name_id").alias("name"), F.collect_set("name").alias("_names"))
    forms = values.where("text is not null and text <> ''").select("src", F.col("row_id").cast("long").alias("row_id"), "field", "text").mapInArrow(add_form("text", "_form", ["src", "row_id", "field", "text"]), "src string, row_id long, field string, text string, _form string")
    met = forms.join(names, (forms["field"] == names["_field"]) & (forms["_form"] == names["_form"]))
    return met.where(~F.array_contains("_names", F.col("text"))).select("src", "row_id", "field", "text", "name_id", "name")
