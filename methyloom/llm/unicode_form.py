"""One consistent form for texts that look the same, computed on arrays of code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Letters of another script with the shape of a Latin letter, and that letter: Cyrillic, Greek, Armenian,
# Cherokee. Left out are letters whose two cases look like two different Latin letters (Greek nu and upsilon in lower
# case), as texts compared without case would then mix those up, and dotless i, which is a letter of its own.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "α": "a", "ι": "i", "κ": "k", "ρ": "p", "χ": "x",
    "օ": "o", "Օ": "O", "ս": "u", "Ս": "U", "լ": "l", "Լ": "L", "Տ": "S", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
# Ranges of characters that show nothing (soft hyphen, joiners, directions, selectors, byte order mark, controls).
INVISIBLE = ((0x0, 0x8), (0xE, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0xE0000, 0xE0FFF))
# Blanks besides those of category Zs; line ends.
BLANKS, LINE_ENDS = (0x9, 0xB, 0xC, 0x2800), (0xD, 0x85, 0x2028, 0x2029)
# Compatibility decompositions that are only another width, type face or joined form of the same letters.
FORM_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
LIGATURES = ((0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3))

#: Code points from here on have no decomposition and are kept, but for the invisible ones.
TOP = 0x30000
_HANGUL, _L, _V, _T = 0xAC00, 0x1100, 0x1161, 0x11A7


def char_form(ch: str) -> str:
    """What one character becomes before marks are composed."""
    cp = ord(ch)
    if any(a <= cp <= z for a, z in INVISIBLE):
        return ""
    if cp in LINE_ENDS:
        return "\n"
    if cp in BLANKS or unicodedata.category(ch) == "Zs":
        return " "
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if tag in FORM_TAGS and not 0xFE70 <= cp <= 0xFE7F or any(a <= cp <= z for a, z in LIGATURES):
        ch = unicodedata.normalize("NFKD", ch)
    else:
        ch = unicodedata.normalize("NFD", ch)
    return "".join(LOOKALIKES.get(c, c) for c in ch)


class Tables:
    """Lookup tables by code point: expansion, combining class; and the pairs that compose."""

    def __init__(self) -> None:
        pool: list[int] = []
        self.start = np.zeros(TOP + 1, np.int32)
        self.size = np.ones(TOP + 1, np.int32)
        self.ccc = np.zeros(TOP, np.uint8)
        #: code points that may compose with what stands before them
        self.joins = np.zeros(TOP, bool)
        same = np.arange(TOP, dtype=np.uint32)
        pairs: dict[tuple[int, int], int] = {}
        extra: dict[int, list[int]] = {}
        for cp in range(0x80):
            out = [ord(c) for c in char_form(chr(cp))]
            if out != [cp]:
                extra[cp] = out
        for cp in range(0x80, TOP):
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind in ("Cn", "Cs", "Co") or _HANGUL <= cp < _HANGUL + 11172 or 0x3400 <= cp < 0xA000 or cp >= 0x20000 and cp < 0x2F800:
                if not any(a <= cp <= z for a, z in INVISIBLE):
                    continue
            out = [ord(c) for c in char_form(ch)]
            if out != [cp]:
                extra[cp] = out
            self.ccc[cp] = unicodedata.combining(ch)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(parts[0], 16), int(parts[1], 16)] = cp
        base = list(same)
        for cp, out in extra.items():
            self.start[cp], self.size[cp] = len(base) + len(pool), len(out)
            pool += out
        plain = np.ones(TOP, bool)
        plain[list(extra)] = False
        self.start[:TOP][plain] = same[plain]
        self.size[TOP] = 0
        self.pool = np.concatenate([same, np.array(pool, np.uint32)])
        # letters that look like others were replaced, so pairs are looked up by the replaced first letter
        swap = {ord(a): ord(b) for a, b in LOOKALIKES.items()}
        keyed = {(a, b): c for (a, b), c in pairs.items() if a not in swap}
        order = sorted(keyed)
        self.pair_keys = np.array([(a << 21) | b for a, b in order], np.int64)
        self.pair_values = np.array([keyed[k] for k in order], np.uint32)
        self.joins[[b for _, b in order]] = True
        self.joins[self.ccc > 0] = True
        self.joins[_V : _V + 21] = True
        self.joins[_T + 1 : _T + 28] = True

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composed code points of pairs, 0 where none exists."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key = (a << 21) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out = np.where(self.pair_keys[at] == key, self.pair_values[at], 0).astype(np.int64)
        lv = (a >= _L) & (a < _L + 19) & (b >= _V) & (b < _V + 21)
        out[lv] = _HANGUL + ((a[lv] - _L) * 21 + b[lv] - _V) * 28
        lvt = (a >= _HANGUL) & (a < _HANGUL + 11172) & ((a - _HANGUL) % 28 == 0) & (b > _T) & (b < _T + 28)
        out[lvt] = a[lvt] + b[lvt] - _T
        return out


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins (one more at the end). Nulls have none."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if texts.null_count:
        size = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
        if size.sum() != len(raw):  # bytes under nulls
            return code_points(texts.fill_null(""))
    begins = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, begins[offsets]


def strings(codes: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Texts of code points; the inverse of :func:`code_points`."""
    raw = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.r_[0, np.cumsum(width)][offsets]
    mask = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(raw)])


def form_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the consistent form."""
    t = tables()
    at = np.minimum(codes, TOP).astype(np.int64)
    high = codes >= TOP
    size = t.size[at]
    if high.any():
        size = np.where(high & ~((codes >= 0xE0000) & (codes <= 0xE0FFF)), 1, size)
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    begins = np.r_[0, ends][offsets]
    out = t.pool[np.repeat(t.start[at] - (ends - size), size) + np.arange(total)] if not high.any() else _expand_high(t, codes, at, size, ends, total)
    return _compose(t, out, begins)


def _expand_high(t: Tables, codes: np.ndarray, at: np.ndarray, size: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
    pool = np.concatenate([t.pool, codes])
    start = np.where(codes >= TOP, len(t.pool) + np.arange(len(codes)), t.start[at])
    return pool[np.repeat(start - (ends - size), size) + np.arange(total)]


def _compose(t: Tables, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.minimum(codes, TOP - 1)
    join = t.joins[low] & (codes < TOP)
    if not join.any():
        return codes, begins
    codes = codes.astype(np.int64)
    first = np.zeros(len(codes) + 1, bool)
    first[begins] = True
    first = first[:-1]
    marks = np.flatnonzero(join)
    ccc = t.ccc[low[marks]].astype(np.int64)
    # runs of marks with a class are brought into the order of their classes
    new = np.r_[True, (np.diff(marks) != 1) | (ccc[1:] == 0) | (ccc[:-1] == 0)] | first[marks]
    run = np.cumsum(new)
    if ((ccc[1:] < ccc[:-1]) & (run[1:] == run[:-1])).any():
        order = np.lexsort((ccc, run))
        codes[marks] = codes[marks[order]]
        ccc = ccc[order]
    # chains: a character that may be composed onto, and what follows it
    chain = np.r_[True, np.diff(marks) != 1] | first[marks]
    head = np.flatnonzero(chain)
    length = np.diff(np.r_[head, len(marks)])
    has = (marks[head] > 0) & ~first[marks[head]]
    target = np.where(has, marks[head] - 1, marks[head])
    step0 = np.where(has, 0, 1)  # without a character before, the first mark of the chain is what others go onto
    last = np.where(has, 0, ccc[head])
    gone = np.zeros(len(codes), bool)
    live = np.arange(len(head))
    step = 0
    while True:
        live = live[step0[live] + step < length[live]]
        if not len(live):
            break
        m = head[live] + step0[live] + step
        at, c = marks[m], ccc[m]
        free = (last[live] == 0) | (last[live] < c)
        made = np.where(free, t.compose(codes[target[live]], codes[at]), 0)
        ok = made > 0
        codes[target[live[ok]]] = made[ok]
        gone[at[ok]] = True
        bad = live[~ok]
        starter = c[~ok] == 0
        target[bad] = np.where(starter, at[~ok], target[bad])
        last[bad] = np.where(starter, 0, c[~ok])
        step += 1
    kept = ~gone
    return codes[kept].astype(np.uint32), np.r_[0, np.cumsum(kept)][begins]


#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array):
    """``texts`` in slices of about SLICE_BYTES; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(texts)] if len(texts) else [0, 0]
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield texts.slice(int(a), int(z - a))


def consistent(texts: pa.Array) -> pa.Array:
    """The consistent form of each text; a null stays null, an empty text empty."""
    done = []
    for part in slices(texts):
        codes, offsets = code_points(part)
        codes, offsets = form_codes(codes, offsets)
        done.append(strings(codes, offsets, np.asarray(part.is_null()) if part.null_count else None).cast(pa.string()))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def consistent_form(text: Column) -> Column:
    """``text`` in one form for all texts that read the same.

    Width and ligature forms become plain letters, each kind of blank a space, each kind of line end a newline; what
    shows nothing goes; letters of another script with the shape of a Latin letter become that letter; accents are
    composed with their letters in canonical order. Letter case, accents, digits, punctuation and words stay. Null
    gives null, an empty text or one that shows nothing gives an empty text. Whole texts, whatever their length.
    """

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        return consistent(texts)

    return form(text)


def shows_something(form: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(form, "\\s", ""))) > 0


def alike_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``class_id``, ``text_id``: one row per text that shows something. Texts that read the same share
    ``class_id`` (128 bits of the form, hexadecimal), equal texts share ``text_id``. One pass, each form made once."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), consistent(b.column(2))], names=["id", "text_id", "form"])

    rows = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.md5(text).alias("text_id"), text.alias("text"))
    formed = rows.mapInArrow(run, f"id {kind}, text_id STRING, form STRING")
    return formed.where(shows_something(F.col("form"))).select("id", F.md5("form").alias("class_id"), "text_id")


#: Members of a text that are gathered in one row.
CHUNK = 1024
#: Texts of a class that meet all others of it in one task.
SIDE = 4096


def _mixed_texts(rows: DataFrame) -> DataFrame:
    """``class_id``, ``text_id``, ``n`` (its rows), ``texts`` (of its class) of the texts that others read like."""
    texts = rows.groupBy("class_id", "text_id").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("class_id").agg(F.count("*").alias("texts"), F.sum("n").alias("docs")).where("texts > 1")
    return texts.join(mixed, "class_id")


def alike_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_a``, ``id_b``: every two rows whose texts differ but read the same, the smaller id first.

    Pairs are made of different texts, not of rows: copies of one text, however many, are counted before anything is
    joined, and a class of equal texts goes no further. Where a class has more than SIDE texts, they are dealt out by a
    hash, and each deal meets the whole class in a task of its own. The ids of a text lie in rows of about CHUNK; a pair
    of texts becomes pairs of such rows, which are opened last, so a task's work is the pairs that come out of it.
    Classes are kept as a table of two hashes per row in the shared folder, so texts are read once. Ids are taken to be
    unique; null and blank texts are left out.
    """
    rows = stored(alike_classes(docs, id_col, text_col), "alike")
    texts = _mixed_texts(rows).withColumn("deals", F.ceil(F.col("texts") / SIDE).cast("int")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    a = texts.select("class_id", F.col("text_id").alias("text_a"), F.pmod(F.xxhash64("text_id"), "deals").cast("int").alias("deal"), F.col("chunks").alias("chunks_a"))
    b = texts.select("class_id", F.col("text_id").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("chunks").alias("chunks_b"))
    pairs = a.join(b, ["class_id", "deal"]).where("text_a < text_b").select("text_a", "text_b", F.explode(F.sequence(F.lit(0), F.col("chunks_a") - 1)).alias("part_a"), "chunks_b")
    pairs = pairs.select("text_a", "text_b", "part_a", F.explode(F.sequence(F.lit(0), F.col("chunks_b") - 1)).alias("part_b"))
    members = rows.join(texts.select("text_id", "chunks"), "text_id").groupBy("text_id", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("part")).agg(F.collect_list("id").alias("ids"))
    a, b = (members.select(F.col("text_id").alias(f"text_{x}"), F.col("part").alias(f"part_{x}"), F.col("ids").alias(f"ids_{x}")) for x in "ab")
    met = pairs.join(a, ["text_a", "part_a"]).join(b, ["text_b", "part_b"]).select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b"))
    return met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def alike_links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``class_id``, ``links``: each row whose text others read like, with the number of rows whose texts differ
    from its own but read the same: what :func:`alike_pairs` says, in as many rows as documents."""
    rows = stored(alike_classes(docs, id_col, text_col), "alike")
    texts = _mixed_texts(rows).select("text_id", (F.col("docs") - F.col("n")).alias("links"))
    return rows.join(texts, "text_id").select("id", "class_id", "links")
