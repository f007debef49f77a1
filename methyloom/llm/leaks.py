"""Passages of held-out texts in a corpus, by suffix arrays over shards of the corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unicode_form import LOOKALIKES, TOP, code_points, form_codes, slices

#: Words of one suffix array. A longer text makes a larger one.
SHARD_WORDS = 1 << 20
#: Bytes of held-out texts that are shipped to the tasks at once; more are searched block by block.
BLOCK_BYTES = 8 << 20


@lru_cache(1)
def _word_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to words, and a 64-bit number that letters differing only in case share."""
    in_word = np.zeros(TOP, bool)
    fold = np.arange(TOP, dtype=np.uint64)
    upper_twin = {a.lower(): b.lower() for a, b in LOOKALIKES.items() if a != a.lower()}
    for cp in range(TOP):
        ch = chr(cp)
        kind = unicodedata.category(ch)[0]
        if kind not in "LNM":
            continue
        in_word[cp] = True
        low = ch.lower()
        # a letter whose other case looks like a Latin one counts as that one: that other case was replaced before
        low = upper_twin.get(low, LOOKALIKES.get(low, low))
        fold[cp] = ord(low[0])
    with np.errstate(over="ignore"):
        x = fold + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return in_word, x


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of each word of each text, in the consistent form and without letter case, and where each text's
    words begin (one more at the end). Words are runs of letters and digits; nulls have none."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    parts = [_word_codes(p) for p in slices(texts)]
    sizes = np.concatenate([np.diff(o) for _, o in parts])
    return np.concatenate([w for w, _ in parts]), np.r_[0, np.cumsum(sizes)]


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, begins = form_codes(*code_points(texts))
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    in_word, number = _word_tables()
    at = np.minimum(codes, TOP - 1)
    inside = in_word[at] & (codes < TOP)
    first = np.zeros(len(codes) + 1, bool)
    first[begins] = True
    start = inside & np.r_[True, ~inside[:-1] | first[1:-1]]
    place = np.flatnonzero(start)
    count = np.r_[0, np.cumsum(start)][begins]
    if not len(place):
        return np.zeros(0, np.uint64), count
    # a word's code is the sum of its letters' numbers times odd powers of one factor
    letters = np.flatnonzero(inside)
    word = np.cumsum(start)[letters] - 1
    nth = letters - place[word]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(nth.max()) + 1, 0x5851F42D4C957F2D, np.uint64))
        value = np.add.reduceat(number[at[letters]] * powers[nth], np.flatnonzero(nth == 0))
    return value | np.uint64(1), count


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``symbols`` in the order of their first ``depth`` symbols or more, by doubling."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.r_[True, key[order][1:] != key[order][:-1]]
        k *= 2
        if k >= depth or step.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)


def _bounds(text: np.ndarray, order: np.ndarray, query: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the query suffixes those that occur, and for each the range of ``order`` whose suffixes begin with the same
    ``words`` symbols."""
    padded = np.r_[text, np.zeros(words, np.uint64)]

    def search(starts: np.ndarray, lo: np.ndarray, upper: bool) -> np.ndarray:
        lo, hi = lo.copy(), np.full(len(starts), len(order), np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            before = np.zeros(len(live), bool)
            same = np.arange(len(live))
            for j in range(words):
                a, b = padded[order[mid[same]] + j], query[starts[live[same]] + j]
                before[same[a < b]] = True
                same = same[a == b]
                if not len(same):
                    break
            if upper:
                before[same] = True
            lo[live[before]] = mid[before] + 1
            hi[live[~before]] = mid[~before]

    lo = search(starts, np.zeros(len(starts), np.int64), False)
    found = np.flatnonzero(lo < len(order))
    for j in range(words):
        found = found[padded[order[lo[found]] + j] == query[starts[found] + j]]
    return starts[found], lo[found], search(starts[found], lo[found], True)


#: Hits that are extended together, and words that are compared at once.
_HITS, _STEP = 1 << 17, 16


class Shard:
    """The words of some texts with their suffix array; built once, searched for every block of held-out texts."""

    def __init__(self, words: np.ndarray, begins: np.ndarray, least: int):
        self.begins, self.least = begins, least
        count = np.diff(begins)
        owner = np.repeat(np.arange(len(count)), count)
        # a 0 after each text: no word has this code
        self.text = np.zeros(len(words) + len(count), np.uint64)
        self.text[np.arange(len(words)) + owner] = words
        self.ends = begins[1:] + np.arange(1, len(count) + 1)
        self.order = suffix_array(self.text, least)

    def search(self, index: Index) -> tuple[np.ndarray, ...]:
        """Longest verbatim matches: text, item, words, place in the text (in words).

        Only hits that cannot be longer to the left are extended: those whose words before differ. Where texts and items
        repeat themselves these are few of all hits, and the longest matches are among them.
        """
        best = (np.zeros(0, np.int64),) * 4
        if not len(self.text) or not len(index.starts):
            return best
        starts, lo, hi = _bounds(self.text, self.order, index.words, index.starts, self.least)
        if not len(starts):
            return best
        # each range once, its places in the order of the words before them
        low, first = np.unique(lo, return_index=True)
        size = hi[first] - low
        base = np.r_[0, np.cumsum(size)]
        group = np.repeat(np.arange(len(low)), size)
        place = self.order[np.repeat(low - base[:-1], size) + np.arange(base[-1])]
        before = np.where(place > 0, self.text[place - 1], np.uint64(0))
        s = np.lexsort((before, group))
        place, before = place[s], before[s]
        own = np.searchsorted(low, lo)
        head = starts > index.begins[index.item[starts]]
        asked = np.where(head, index.words[starts - 1], np.uint64(0))
        # the part of a range with the same word before; an item's first word has none
        left, right = _equal_part(before, base[own], base[own + 1], asked)
        left, right = np.where(head, left, base[own]), np.where(head, right, base[own])
        a = np.r_[base[own], right]
        n = np.r_[left - base[own], base[own + 1] - right]
        q = np.r_[starts, starts]
        total = np.r_[0, np.cumsum(n)]
        for begin in range(0, int(total[-1]), _HITS):
            hit = np.arange(begin, min(begin + _HITS, int(total[-1])))
            k = np.searchsorted(total, hit, side="right") - 1
            best = self._longest(best, self._extended(index, q[k], place[a[k] + hit - total[k]]))
        return best

    def _extended(self, index: Index, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
        item = index.item[q]
        room = index.begins[item + 1] - q
        length = np.full(len(q), self.least, np.int64)
        live = np.flatnonzero(length < room)
        step = np.arange(_STEP)
        text, words = self.text, index.words
        while len(live):
            at, to = (p[live] + length[live])[:, None] + step, (q[live] + length[live])[:, None] + step
            same = (text[np.minimum(at, len(text) - 1)] == words[np.minimum(to, len(words) - 1)]) & (at < len(text)) & (step < (room - length)[live][:, None])
            run = np.where(same.all(1), _STEP, same.argmin(1))
            length[live] += run
            live = live[(run == _STEP) & (length[live] < room[live])]
        doc = np.searchsorted(self.ends, p, side="right")
        return doc, item, length, p - doc - self.begins[doc]

    @staticmethod
    def _longest(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        d, i, n, at = (np.r_[x, y] for x, y in zip(one, two))
        s = np.lexsort((at, -n, i, d))
        d, i, n, at = d[s], i[s], n[s], at[s]
        keep = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1])]
        return d[keep], i[keep], n[keep], at[keep]


def _equal_part(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range lo..hi of ``values``, in which they are sorted, the part that equals ``asked``."""

    def search(upper: bool) -> np.ndarray:
        a, z = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(a < z)
            if not len(live):
                return a
            mid = (a[live] + z[live]) >> 1
            less = values[mid] <= asked[live] if upper else values[mid] < asked[live]
            a[live[less]], z[live[~less]] = mid[less] + 1, mid[~less]

    return search(False), search(True)


class Index:
    """The words of a block of held-out texts, ready to be searched for."""

    def __init__(self, texts: list[str | None], least: int):
        self.words, self.begins = word_codes(pa.array(texts, pa.string()))
        self.item = np.repeat(np.arange(len(texts)), np.diff(self.begins))
        left = self.begins[self.item + 1] - np.arange(len(self.item))
        self.starts = np.flatnonzero(left >= least)


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator():
        n = len((row.t or "").encode())
        if ids and size + n > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += n
    if ids:
        yield ids, texts


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least_words: int = 12, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``words``, ``at_word``: the documents that hold at least ``least_words`` consecutive
    words of an item, with the longest such passage and its first place in the document.

    Words are runs of letters and digits of the consistent form, without letter case; a word is known by a 64-bit code
    of its letters. Null and empty texts hold nothing; items shorter than ``least_words`` match nothing; items with the
    same text are all reported; an empty table gives an empty result.

    Each task gathers the texts that it scans into shards of ``shard_words`` words, sorts a shard's suffixes once and
    binary-searches every item suffix in them: one pass over the corpus, no shuffle, however many items. Held-out texts
    go to the tasks in blocks of ``block_bytes``, each a broadcast of its own; a task holds one block at a time. Hits
    are extended in runs of bounded size, so a text that repeats itself needs no more room than another.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    dk, ik = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = f"`{doc_id}` {dk.simpleString()}, `{item_id}` {ik.simpleString()}, words INT, at_word INT"
    spark = docs.sparkSession
    blocks = []
    for ids, texts in _blocks(items, item_id, text, block_bytes):
        index = Index(texts, least_words)
        if len(index.starts):
            blocks.append(spark.sparkContext.broadcast((index, pa.array(ids, to_arrow_type(ik)))))
    if not blocks:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def found() -> Iterator[pa.RecordBatch]:
            keys = pa.concat_arrays([k for k, _, _ in held])
            words = np.concatenate([w for _, w, _ in held])
            begins = np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, _, o in held]))]
            held.clear()
            shard = Shard(words, begins, least_words)
            for block in blocks:
                index, names = block.value
                d, i, n, at = shard.search(index)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(d)), names.take(pa.array(i)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names=[doc_id, item_id, "words", "at_word"])
                if len(blocks) > 1:  # the next block takes its room; it is read again from the worker's disk
                    block.__dict__.pop("_value", None)

        size = 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0), *word_codes(b.column(1))))
                size += len(held[-1][1])
                if size >= shard_words:
                    yield from found()
                    size = 0
        if held:
            yield from found()

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that ``leaks`` names; documents with a null id stay."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
