"""Documents that contain passages of held-out items, by q-gram filtering and banded alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lookalike import LETTERS, invisible_ranges, letters_alike, ligatures, single_forms
from tidegraph.session import Spool, col

Q = 8  # letters of a gram; grams go over letters and digits only
BAND = 64  # letters from one diagonal band to the next at least; a band is twice as wide
DRIFT = 24  # words that an alignment may stray from its diagonal beside twice the edit budget
MOST_ITEMS = 64  # items that a gram may occur in to be looked up for all of them
DROP, BREAK = 0, 1  # in the folding table: characters without effect, characters between words
_ANSI = re.compile(r"(?:\x1b|\\+u001b|\\+x1b|\\+033)\[[0-9;]*[A-Za-z]")
_ESCAPED = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtbf](?![a-z]*\{))")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)


@cache
def folding_table(alike: str = LETTERS) -> np.ndarray:
    """For each code point what it counts as: a folded letter or digit, DROP, or BREAK."""
    forms = single_forms(alike)
    table = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x20000):
        c = chr(code)
        c = unicodedata.normalize("NFKD", forms.get(c, c))[:1] or c
        c = forms.get(c, c).lower()[:1]
        kind = unicodedata.category(c)
        table[code] = ord(c) if kind[0] == "L" or kind == "Nd" else DROP if kind == "Mn" or kind == "Cf" else BREAK
    for a, b in invisible_ranges():
        table[a : b + 1] = DROP
    return table


@cache
def _ligature_pattern() -> re.Pattern:
    return re.compile("[" + "".join(ligatures()) + "]")


def plain_text(text: str) -> str:
    """The text without colour codes, mark-up tags, entities, escapes and ligatures."""
    if "\x1b" in text or "[" in text and "\\" in text:
        text = _ANSI.sub(" ", text)
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii() and _ligature_pattern().search(text):
        text = _ligature_pattern().sub(lambda m: ligatures()[m[0]], text)
    return text


def stream(text: str, alike: str = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """The text's folded letters and digits in a row, and the places in it where words begin."""
    folded = folding_table(alike)[np.frombuffer(plain_text(text).encode("utf-32-le", "surrogatepass"), np.uint32)]
    folded = folded[folded != DROP]
    letter = folded != BREAK
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    return folded[letter], np.flatnonzero(begins[letter])


def grams(letters: np.ndarray) -> np.ndarray:
    """Hashes of all runs of Q letters."""
    n = len(letters) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, x = np.zeros(n, np.uint64), letters.astype(np.uint64)
    for i in range(Q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += x[i : i + n] + np.uint64(0x632BE59BD9B4E019)
    return out ^ (out >> np.uint64(29))


def words_of(letters: np.ndarray, begins: np.ndarray) -> list[bytes]:
    ends = np.append(begins[1:], len(letters))
    return [letters[a:b].tobytes() for a, b in zip(begins, ends)]


@dataclass
class Index:
    """The grams of a block of items, each with the places where it occurs. Items of the same words are one entry."""

    ids: list[list[int]]  # of each entry the numbers of its items
    words: list[np.ndarray]  # of each entry its words as numbers
    number: dict[bytes, int]
    keys: np.ndarray  # sorted distinct grams
    first: np.ndarray  # of each gram the first of its occurrences
    item: np.ndarray  # occurrences: entry and place
    place: np.ndarray
    word_at: list[np.ndarray]  # of each entry the word that each letter belongs to
    need: np.ndarray  # words that a passage must share
    edits: np.ndarray  # words that may be changed in it, missing or foreign
    band: np.ndarray  # letters from one diagonal band to the next; a band is twice as wide
    least_cover: np.ndarray  # letters that a passage's grams must cover at least
    present: np.ndarray  # by the low bits of a gram
    alike: str  # letters that are folded to those they look like

    @property
    def drift(self) -> np.ndarray:
        """Words that an alignment may stray from its diagonal."""
        return DRIFT + 2 * self.edits


def build_index(items: list[tuple[int, str]], share: float = 0.5, most_items: int = MOST_ITEMS, alike: str = LETTERS) -> Index:
    """The index of (number, text).

    A gram of more than ``most_items`` entries, such as those of a sentence that many items open with, would be found for all of
    them in every document with that sentence. It is kept only for entries that the rest of their grams would not tell: from the
    others' least cover go the letters that such grams cover, and what is left of it, if at least half, the rest of their grams must cover.
    """
    ids, words, word_at, cover, need, edits, band, gram = [], [], [], [], [], [], [], []
    number: dict[bytes, int] = {}
    entry: dict[tuple[bytes, bytes], int] = {}
    for item, text in items:
        letters, begins = stream(text, alike)
        at = entry.setdefault((letters.tobytes(), begins.tobytes()), len(entry))
        if at < len(ids):
            ids[at] = sorted({*ids[at], item})
            continue
        own = words_of(letters, begins)
        lengths = np.diff(np.append(begins, len(letters)))
        ids.append([item])
        words.append(np.array([number.setdefault(w, len(number)) for w in own], np.int64))
        word_at.append(np.repeat(np.arange(len(own), dtype=np.int32), lengths))
        need.append(int(np.ceil(share * len(own))))
        edits.append(need[-1] // 8 + 1)
        band.append(max(BAND, int(np.sort(lengths)[-edits[-1] :].sum())))
        cover.append(_least_cover(lengths, need[-1], edits[-1]))
        gram.append(grams(letters))
    sizes = [len(g) for g in gram]
    owner = np.repeat(np.arange(len(gram), dtype=np.int32), sizes)
    place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32)
    flat = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    keys, first, many = np.unique(flat[order], return_index=True, return_counts=True)
    least = np.array(cover, np.int64)
    hot = np.zeros(len(flat), bool)
    hot[order] = np.repeat(many > most_items, many)
    if hot.any():
        at = np.flatnonzero(hot)
        step = np.append(np.where(owner[at[1:]] == owner[at[:-1]], np.minimum(place[at[1:]] - place[at[:-1]], Q), Q), Q)
        covered = np.bincount(owner[at], step, len(ids)).astype(np.int64)
        spared = least - covered >= np.maximum(Q, least // 2)
        least = np.where(spared, least - covered, least)
        kept = ~(hot & spared[owner])
        flat, owner, place = flat[kept], owner[kept], place[kept]
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
    present = np.zeros(1 << 22, bool)
    present[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    return Index(ids, words, number, keys.astype(np.uint64), np.append(first, len(order)), owner[order], place[order], word_at, np.array(need), np.array(edits), np.array(band), least, present, alike)


def _least_cover(lengths: np.ndarray, need: int, edits: int) -> int:
    """The q-gram lemma in letters: what grams cover at least of the shortest passage of ``need`` words, with ``edits`` of them changed.

    A changed word takes away its own letters, and the unchanged stretch at either side of it is not seen if shorter than Q.
    """
    if not len(lengths) or not need:
        return 0
    total = np.concatenate([[0], np.cumsum(lengths)])
    shortest = int(np.min(total[need:] - total[:-need]))
    return max(1, shortest - int(np.sort(lengths)[-edits:].sum()) - edits * (Q - 1))


def aligned_words(pairs: list[tuple[np.ndarray, np.ndarray, int]], drift: int = DRIFT) -> np.ndarray:
    """Of each (item words, document words, start): words of the item in its best passage of the document.

    Local alignment in a band: document word i lies within ``drift`` words of item word i + start. A word alike
    counts 2, a changed or missing one -2, a foreign one between -1; the best passage is the one of the highest sum, hence one where changed words are
    now and then. All pairs go through the rows of their bands together. Words are numbers of at least 0.
    """
    width, one, low = 2 * drift + 1, 1 << 20, np.int64(-(1 << 60))
    rows = max((len(i) for i, _, _ in pairs), default=0)
    item = np.full((len(pairs), rows), -1, np.int64)
    passage = np.full((len(pairs), rows + width), -2, np.int64)
    for k, (own, doc, start) in enumerate(pairs):
        item[k, : len(own)] = own
        # column c of a passage stands for document word c - drift - start
        at = drift + start
        part = doc[max(0, -at) : rows + width - at]
        passage[k, max(0, at) : max(0, at) + len(part)] = part
    # a cell holds the sum times ``one`` plus the words alike on the way there
    last = np.zeros((len(pairs), width), np.int64)
    foreign = np.arange(width, dtype=np.int64) * one
    best = np.zeros(len(pairs), np.int64)
    for i in range(rows):
        alike = passage[:, i : i + width] == item[:, i, None]
        cell = last + np.where(alike, 2 * one + 1, -2 * one)
        cell[:, :-1] = np.maximum(cell[:, :-1], last[:, 1:] - 2 * one)
        cell = np.maximum.accumulate(cell + foreign, axis=1) - foreign
        last = np.where(cell >= one, cell, 0)
        best = np.maximum(best, np.where(item[:, i] >= 0, last.max(axis=1), low))
    return best % one


def _occurrences(index: Index, at: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, place, where) of all occurrences of the grams number ``at`` that were met at ``where``."""
    many = index.first[at + 1] - index.first[at]
    each = np.repeat(index.first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    return index.item[each], index.place[each], np.repeat(where, many)


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Successive elements whose sizes add up to at most ``most``, or single ones beyond it."""
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


def _met(index: Index, at: np.ndarray, where: np.ndarray, doc: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, entry, place, where) of the gram hits of pairs with enough of them, some ``most`` hits at a time and all of a pair together."""
    entries = len(index.ids)
    many = index.first[at + 1] - index.first[at]
    docs, starts = np.unique(doc, return_index=True)
    ends = np.append(starts[1:], len(doc))
    for part in _slices(np.add.reduceat(many, starts), most):
        a, b = starts[part][0], ends[part][-1]
        if many[a:b].sum() <= most:
            item, place, seen = _occurrences(index, at[a:b], where[a:b])
            owner = np.repeat(doc[a:b], many[a:b])
            # only pairs with as many hits as the least cover needs at the best can pass in any band
            pair = (owner - doc[a]) * entries + item
            if (doc[b - 1] - doc[a] + 1) * entries <= 4 * most:
                n = np.bincount(pair)[pair]
            else:
                _, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
                n = counts[back]
            keep = n + Q - 1 >= index.least_cover[item]
            yield owner[keep], item[keep], place[keep], seen[keep]
            continue
        # one document with very many hits: they are counted by entry first, then taken by ranges of the entries that can pass
        pieces = [slice(a + s.start, a + s.stop) for s in _slices(many[a:b], most)]
        n = sum(np.bincount(_occurrences(index, at[s], where[s])[0], minlength=entries) for s in pieces)
        n = np.where(n + Q - 1 >= index.least_cover, n, 0)
        for entry in _slices(n, most):
            if not n[entry].any():
                continue
            kept = []
            for s in pieces:
                item, place, seen = _occurrences(index, at[s], where[s])
                keep = (item >= entry.start) & (item < entry.stop) & (n[item] > 0)
                kept.append((item[keep], place[keep], seen[keep]))
            item, place, seen = (np.concatenate(x) for x in zip(*kept))
            yield np.full(len(item), doc[a]), item, place, seen


def _find(texts: list[str], index: Index, most: int = 4_000_000) -> tuple[list[int], list[int]]:
    """(number of text, entry) of the passages in texts."""
    streams = [stream(t, index.alike) for t in texts]
    sizes = np.array([len(s[0]) for s in streams])
    offsets = np.concatenate([[0], np.cumsum(sizes + Q)])
    flat = np.full(offsets[-1], BREAK, np.uint32)  # Q breaks between texts: no gram spans two
    for (letters, _), at in zip(streams, offsets):
        flat[at : at + len(letters)] = letters
    g = grams(flat)
    maybe = np.flatnonzero(index.present[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
    if not len(index.keys) or not len(maybe):
        return [], []
    at = np.searchsorted(index.keys, g[maybe])
    at[at == len(index.keys)] = 0
    hit = index.keys[at] == g[maybe]
    where, at = maybe[hit], at[hit]
    if not len(where):
        return [], []
    doc = np.searchsorted(offsets, where, side="right") - 1
    stops = [np.append(begins[1:], len(letters)) for letters, begins in streams]
    found: list[np.ndarray] = []
    for owner, item, place, seen in _met(index, at, where, doc, most):
        if len(item):
            found.append(_verified(index, streams, stops, owner * len(index.ids) + item, place.astype(np.int64), seen - offsets[owner]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return (pairs // len(index.ids)).tolist(), (pairs % len(index.ids)).tolist()


def _verified(index: Index, streams: list, stops: list, pair: np.ndarray, place: np.ndarray, local: np.ndarray) -> np.ndarray:
    """The pairs whose hits cover enough in a band and whose words align there."""
    entries = len(index.ids)
    # each hit lies in two overlapping bands, which begin at its cell and at the one before
    cell = (local - place + (1 << 30)) // index.band[pair % entries]
    pair, band, place, local = np.tile(pair, 2), np.concatenate([cell, cell - 1]), np.tile(place, 2), np.tile(local, 2)
    order = np.lexsort((place, band, pair))
    pair, band, place, local = pair[order], band[order], place[order], local[order]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])])
    # letters of the item that the band's grams cover
    step = np.append(np.where(new[1:], Q, np.minimum(place[1:] - place[:-1], Q)), Q)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(pair))
    covered = np.add.reduceat(step, starts)
    passed = np.flatnonzero(covered >= index.least_cover[pair[starts] % entries])
    # the best band of a pair comes first; what it settles needs no other
    passed = passed[np.lexsort((-covered[passed], pair[starts[passed]]))]
    lead = np.concatenate([[True], pair[starts[passed[1:]]] != pair[starts[passed[:-1]]]]) if len(passed) else np.zeros(0, bool)
    found: set[int] = set()
    words: dict[int, np.ndarray] = {}  # of each document its words as the index numbers them
    drift_of, there = index.drift, np.zeros(len(index.number) + 3, bool)  # words that are no item's have the last place
    for bands in (passed[lead], passed[~lead]):
        if found:
            bands = bands[~np.isin(pair[starts[bands]], list(found))]
        regions: list[tuple[int, np.ndarray, int]] = []
        for s in bands:
            d, k = divmod(int(pair[starts[s]]), entries)
            letters, begins = streams[d]
            if d not in words:
                words[d] = np.array([index.number.get(letters[x:y].tobytes(), -3) for x, y in zip(begins, stops[d])], np.int64)
            # the item's word at the document's first, by the hits in the middle; the region goes as far beyond the item's ends as an alignment may
            mid, drift = starts[s] + (ends[s] - starts[s]) // 2, int(drift_of[k])
            start = int(index.word_at[k][place[mid]]) - int(np.searchsorted(begins, local[mid], side="right")) + 1
            a = max(0, -start - drift)
            region = words[d][a : max(a, len(index.words[k]) - start + drift)]
            # no more words can be alike in order than are there at all
            there[region] = True
            if np.count_nonzero(there[index.words[k]]) >= index.need[k]:
                regions.append((int(pair[starts[s]]), region, start + a))
            there[region] = False
        drifts = np.array([drift_of[p % entries] for p, _, _ in regions], np.int64)
        order = np.lexsort(([len(index.words[p % entries]) for p, _, _ in regions], drifts)) if regions else []
        sizes = np.array([(2 * drifts[i] + 1) * 6 + 2 * len(index.words[regions[i][0] % entries]) for i in order], np.int64)
        for part in _slices(sizes, 2_000_000):
            chosen = [regions[i] for i in order[part]]
            alike = aligned_words([(index.words[p % entries], region, start) for p, region, start in chosen], int(drifts[order[part]].max()))
            found.update(p for (p, _, _), n in zip(chosen, alike) if n >= index.need[p % entries])
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=1)
def _index_of(file: str, share: float, alike: str) -> Index:
    """The index of a block of items, built once in a worker from the file that Spark brought to the executor."""
    held = pq.read_table(SparkFiles.get(file), columns=["item", "text"])
    return build_index(list(zip(held["item"].to_pylist(), held["text"].to_pylist())), share, alike=alike)


def _scan(file: str, share: float, letters: int, alike: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(file, share, alike)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            for part in _slices(sizes, letters):
                docs, entries = _find([t or "" for t in texts.slice(part.start, part.stop - part.start).to_pylist()], index)
                # items of the same words are told apart again; a number given to several texts counts once
                pairs = sorted({(d, i) for d, k in zip(docs, entries) for i in index.ids[k]})
                taken = pa.array([part.start + d for d, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.take(taken), pa.array([i for _, i in pairs], pa.int64())], names=["row", "item"])

    return run


def leaked_items(
    docs: DataFrame, row: str, text: str, items: DataFrame, item: str, item_text: str, share: float = 0.5, block_chars: int = 4_000_000, letters: int = 1_000_000, spool: Spool | None = None
) -> DataFrame:
    """(row, item): each document and each item of which it holds, in one passage and in order, at least ``share`` of the words.

    Texts are compared by their letters and digits alone, folded to one case and form, without mark-up, escapes, colour codes and
    invisible characters. Every run of Q letters of a document is looked up among those of the items; hits are
    gathered by (document, item, diagonal band), bands overlapping by half, and those bands are kept whose hits cover as many letters as
    a passage of that share must after its edit budget, one word in eight (the q-gram lemma). Bands are as wide as the budget can
    shift a passage, so they grow with the item. The region of a kept band is aligned with the item word by word, within
    twice the budget of the diagonal.

    Documents are read once for each block of items and not shuffled. The items are a query set: they are divided by their numbers into blocks of
    some ``block_chars`` characters, which executors write to the shared folder; Spark brings a block's file to each executor, where a worker
    builds its index (some 30 bytes a character). The driver holds the files' names alone. A document is scanned in whole, however long;
    ``letters`` characters of documents and some millions of hits are looked at together.
    Items without words, shorter than Q letters or null, and null documents, take no part. Repeated documents
    are reported each time, repeated items, and an item number with several texts, once. Empty tables give no rows.
    """
    spark = docs.sparkSession
    spool = spool or Spool(spark)
    held = items.where(col(item).isNotNull() & col(item_text).isNotNull()).select(col(item).cast("bigint").alias("item"), col(item_text).alias("text")).distinct()
    chars = held.agg(F.sum(F.length("text").cast("bigint"))).first()[0]
    schema = f"row {docs.schema[row].dataType.simpleString()}, item bigint"
    if not chars:
        return spark.createDataFrame([], schema).toDF(row, item)
    blocks = -(-chars // block_chars)
    # a task and hence a file for each block
    written, _ = spool.write(held.repartitionById(blocks, F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")))
    plain = docs.where(col(text).isNotNull()).select(col(row).alias("row"), col(text).alias("text"))
    found = []
    for file in sorted(written.inputFiles()):
        spark.sparkContext.addFile(file)
        found.append(plain.mapInArrow(_scan(file.rpartition("/")[2], share, letters, letters_alike(spark)), schema))
    return reduce(DataFrame.unionByName, found).toDF(row, item)
