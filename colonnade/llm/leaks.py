"""Evaluation passages inside corpus documents, by greedy string tiling over damage-proof words.

Words are compared by skeletons in which the usual confusions of character recognition fall together (l 1 i, o 0, e c, t f,
s 5, b 8, m rn, w vv, h li) and every stretch of accented, misdecoded or replaced characters is one mark. Words of other
scripts are themselves, ideographs one by one. What stands between the words of a passage in subtitle files (cue numbers,
times, mark-up, speaker names, sound descriptions, addresses and credits, repeated lines of rolling captions, hyphens at a
line's end) is taken out first.

Documents are read and cleaned once, whatever the number of items: the hashes of their seeds (Karp-Rabin, four words each) go
through a filter of bits of bounded size, what passes is joined to the items' seeds, and each pair of document and item that
shares a seed is tiled by itself.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colonnade.runtime import join_dimension, materialize, spread


@dataclass(frozen=True)
class Tiling:
    """Parameters: words of a seed, least consecutive words of a leak, how far damage may go that the skeletons don't cover."""

    seed: int = 4
    words: int = 12
    #: words in a row that differ, and how alike their letters must be to count as the words they stand for; a word that
    #: occurs in the items is itself and stands for no other
    differ: int = 2
    alike: float = 0.75
    #: part of an item's words that tiles of at least ``seed`` words must cover, in whatever order, to count as a leak too
    coverage: float = 0.9
    #: bits of a filter for each entry, as far as the most bits allow (64 MB)
    bits: int = 32
    most_bits: int = 1 << 29


def _table() -> bytes:
    t = bytearray(range(256))
    for i in range(256):
        c = bytes([i])
        if i >= 128 or c in b"'?`":
            t[i] = ord("*")
        elif not (c.isalnum() or c in b"-\n"):
            t[i] = ord(" ")
    for a, b in zip(b"l1cf058", b"iietosb"):
        t[a] = b
    return bytes(t)


_TABLE = _table()
#: the same with every byte of other characters kept
_KEEP = bytes(i if i >= 128 else _TABLE[i] for i in range(256))
_TIME = re.compile(rb"(?:^|\n)(?:[ \t]*\d+[ \t]*\n)?[^\n]*-->[^\n]*")
_TAG = re.compile(rb"<[^>\n]{0,12}>|\{[^}\n]{0,24}\}")
_SOUND = re.compile(rb"\[[^\]]{0,80}\]|\([^)]{0,80}\)|\*[^*\n]{1,80}\*")
#: an advert is a cue with an address, set apart from words by a dot between letters and no space on either side, or a line of credits
_ADDRESS = re.compile(rb"(?<![^\s/@(])(?:https?://)?(?:[a-z0-9_-]+\.)+[a-z]{2,}(?![a-z])|\bhttps?:")
_CREDIT = re.compile(rb"(?:^|\n)\W*(?:synced|subtitles?|encoded|ripped|captions?|captioned|translat\w+|corrected|timed)\b[^\n]*\bby\b|(?:^|\n)\s*-=|(?:^|\n)webvtt")
_SPEAKER = re.compile(rb"(?m)^(?:[ \t]*(?:-|>>)[ \t]*)?[^\s:]{2,60}:(?=\s)")
_MARKS = re.compile(rb"\*+")
_BREAK = re.compile(rb"-[ \t]*\n[\s*]*")


def _letters(b: bytes) -> bytes:
    return b.replace(b"h", b"ii").replace(b"m", b"rn").replace(b"w", b"vv")


#: letters of other scripts, two in a row (a single one may be a misdecoded accent), and those that are words by themselves
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u1fff\u2e80-\ud7ff\uf900-\ufdff\ufe70-\ufefc\U00020000-\U0003ffff]{2}")
_ALONE = re.compile("[\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|[^\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_OTHER = re.compile(rb"[\x80-\xff*]+")
_LATIN = re.compile(rb"[a-z0-9]")


def _foreign(word: bytes) -> list[bytes]:
    """Skeletons of a word that may be of another script: with a Latin letter or digit it is a damaged Latin one."""
    if word.isascii() or _LATIN.search(word):
        w = _OTHER.sub(b"*", word).strip(b"*")
        return [w] if w else []
    letters = "".join(c for c in word.decode("utf-8", "ignore") if c.isalnum() or "\u0300" <= c <= "\u1fff")
    return [w.encode() for w in _ALONE.findall(letters) if len(w) > 1 or _ALONE.fullmatch(w) and ord(w) >= 0x2E80]


def words(text: str) -> list[bytes]:
    """Skeletons of a subtitle text's words, in order."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lower()
    other = not text.isascii() and _FOREIGN.search(text) is not None
    b = text.encode("utf-8", "replace")
    cues = _TIME.split(b)
    if b"." in b or b"by" in b or b"http" in b or b"webvtt" in b or b"-=" in b:
        cues = [c for c in cues if not _is_advert(c)]
    b = b"\n".join(cues)
    if b"<" in b or b"{" in b:
        b = _TAG.sub(b"", b)
    if b"[" in b or b"(" in b or b"*" in b:
        b = _SOUND.sub(b" ", b)
    if b":" in b:
        b = _SPEAKER.sub(b"", b)
    kept: list[bytes] = []
    last: list[bytes] = [b"", b"", b""]
    for line in b.translate(_KEEP if other else _TABLE).split(b"\n"):
        line = line.strip()
        if line and line not in last:
            kept.append(line)
            last = [last[1], last[2], line]
    b = _BREAK.sub(b"", b"\n".join(kept)).replace(b"-", b"")
    if other:
        return [w for x in _letters(b).split() for w in _foreign(x)]
    return [w for w in (x.strip(b"*") for x in _letters(_MARKS.sub(b"*", b)).split()) if w]


def _is_advert(cue: bytes) -> bool:
    """A cue of credits, or one whose address stands where no sentence goes on behind it ("come home.then we left" has none)."""
    return bool(_CREDIT.search(cue) or any(not m.group().startswith(b"http") and _domain(cue, m) or m.group().startswith(b"http") for m in _ADDRESS.finditer(cue)))


def _domain(cue: bytes, m: re.Match) -> bool:
    """Whether the match is an address: nothing goes on behind it on its line, or it has a hyphen, a digit or three parts."""
    rest = cue[m.end() : (cue.find(b"\n", m.end()) + 1 or len(cue) + 1) - 1].strip(b" \t.,!)>/*-=\"'")
    name = m.group()
    return not rest or rest.startswith((b"/", b"<")) or any(c in b"0123456789-" for c in name) or name.count(b".") > 1


def item_words(text: str) -> tuple[list[bytes], list[int]]:
    """Skeletons of an item's words and the place of each among the words as written; ideographs are words of their own."""
    out, at = [], []
    text = text.lower()
    other = not text.isascii() and _FOREIGN.search(text) is not None
    place = 0
    for w in text.split():
        b = _letters(w.encode("utf-8", "replace").translate(_KEEP if other else _TABLE).replace(b"-", b""))
        parts = [x for part in b.split() for x in _foreign(part)] if other else [x for x in (part.strip(b"*") for part in _MARKS.sub(b"*", b).split()) if x]
        alone = other and len(parts) > 1 and any(not x.isascii() for x in parts)
        for k, x in enumerate(parts):
            out.append(x)
            at.append(place + (k if alone else 0))
        place += max(len(parts), 1) if alone else 1
    return out, at


_K = 0x9E3779B97F4A7C15
#: odd factors that spread a hash over the bits of a filter
_SPREAD = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def hashes_of(ws: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``cache`` holds those seen, and starts anew when it grows large."""
    if len(cache) > 500_000:
        cache.clear()
    out = []
    for w in ws:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (Karp-Rabin, modulo 2^64)."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_K) + h[j : j + n]
    return out


def _places(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits, of 2^size, that stand for each hash."""
    with np.errstate(over="ignore"):
        return [(h * np.uint64(f)) >> np.uint64(64 - size) for f in _SPREAD]


def _held(h: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Whether a filter may hold each hash: never false for one that it holds."""
    out = np.ones(len(h), bool)
    for at in _places(h, size):
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _filter(table: DataFrame, p: Tiling) -> tuple[np.ndarray, int]:
    """A filter of the column ``hash``, its bits set by the tasks and joined by byte: at most ``most_bits`` / 8 bytes, however many rows."""
    n = table.count()
    size = max(6, min(math.ceil(math.log2(max(n * p.bits, 64))), int(math.log2(p.most_bits))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(3)).astype(np.int32)), pa.array((1 << (at & np.uint64(7)).astype(np.int32)).astype(np.int32))], names=["byte", "bit"])

    set_ = table.select("hash").mapInArrow(run, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max((1 << size) // 8, 1), np.uint8)
    out[set_.column(0).to_numpy()] = set_.column(1).to_numpy()
    return out, size


def tiles(doc: np.ndarray, item: np.ndarray, at: list[int], places: list[int], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of a document and an item from their shared seeds of k words: (document place, item place, words), by item place."""
    runs: dict[int, list[int]] = defaultdict(list)
    for d, q in zip(at, places):
        runs[d - q].append(q)
    found = []
    for diagonal, qs in runs.items():
        qs.sort()
        a = qs[0]
        for x, y in zip(qs, [*qs[1:], None]):
            if y is None or y > x + k:  # further matches on the diagonal are runs of their own
                found.append((x - a + k, a + diagonal, a))
                a = y
            elif y > x + 1 and not np.array_equal(doc[x + diagonal : y + diagonal + 1], item[x : y + 1]):
                found.append((x - a + k, a + diagonal, a))
                a = y
    found.sort(key=lambda t: (-t[0], t[2], t[1]))
    mine, theirs, out = set(), set(), []
    for n, d, q in found:  # longest first; what overlaps earlier tiles is cut away
        while n and (q in mine or d in theirs):
            n, d, q = n - 1, d + 1, q + 1
        while n and (q + n - 1 in mine or d + n - 1 in theirs):
            n -= 1
        if n >= 2 and not any(q + j in mine or d + j in theirs for j in range(n)):
            mine.update(range(q, q + n))
            theirs.update(range(d, d + n))
            out.append((d, q, n))
    return sorted(out, key=lambda t: (t[1], t[0]))


class Pair:
    """A document and an item that share seeds. ``doc`` has the item's number of each of its words, -1 for words of other items, 0 for words of none."""

    def __init__(self, raw: list[bytes], doc: np.ndarray, names: list[bytes], item: np.ndarray, at: list[int], p: Tiling):
        self.raw, self.doc, self.names, self.item, self.at, self.p = raw, doc, names, item, at, p

    @classmethod
    def of(cls, raw: list[bytes], known: np.ndarray, names: list[bytes], at: list[int], p: Tiling) -> Pair:
        numbers: dict[bytes, int] = {}
        item = np.array([numbers.setdefault(w, len(numbers) + 1) for w in names], np.int64)
        doc = np.fromiter((numbers.get(w, 0) for w in raw), np.int64, len(raw))
        doc[(doc == 0) & known] = -1
        return cls(raw, doc, names, item, at, p)

    def _same(self, q: int, k: int) -> bool:
        x, y = self.names[q], self.raw[k]
        return x == y or (not self.doc[k] and min(len(x), len(y)) >= 3 and SequenceMatcher(None, x, y, False).ratio() >= self.p.alike)

    def _grow(self, a: int, z: int, d: int, dz: int) -> tuple[int, int]:
        while a > 0 and d > 0 and self._same(a - 1, d - 1):
            a, d = a - 1, d - 1
        while z < len(self.item) and dz < len(self.raw) and self._same(z, dz):
            z, dz = z + 1, dz + 1
        return a, z

    def measure(self, at: list[int], places: list[int]) -> tuple[int, int]:
        """(most consecutive words of the item, as written, in one stretch of the document; words of it that all stretches cover).

        Tiles join over a few words that differ only by damage, and grow over such words at their ends. Stretches of less than a seed cover nothing.
        """
        p, best, by_start = self.p, 0, sorted(tiles(self.doc, self.item, at, places, self.p.seed), key=lambda t: t[0])
        used: set[int] = set()
        covered: set[int] = set()
        for s in range(len(by_start)):
            if s in used:
                continue
            d, q, n = by_start[s]
            a, z, dz = q, q + n, d + n
            for t in range(s + 1, len(by_start)):
                d2, q2, n2 = by_start[t]
                gi, gd = q2 - z, d2 - dz
                if gd > p.differ + 1:
                    break
                joins = gi == gd == 0
                if 0 <= gi <= p.differ and gd >= 0 and (gi or gd):
                    x, y = b"".join(self.names[z:q2]), b"".join(self.raw[dz:d2])
                    joins = x == y or (len(y) >= 3 and not self.doc[dz:d2].all() and SequenceMatcher(None, x, y, False).ratio() >= p.alike)
                if joins:
                    z, dz = q2 + n2, d2 + n2
                    used.add(t)
            a, z = self._grow(a, z, d, dz)
            best = max(best, self.at[z - 1] - self.at[a] + 1)
            if z - a >= p.seed:
                covered.update(range(self.at[a], self.at[z - 1] + 1))
        return best, len(covered)


class Run:
    """A document and an item that share a single run of seeds: only the words at its ends are looked at."""

    def __init__(self, raw: list[bytes], known: bytes, names: list[bytes], at: list[int], p: Tiling):
        self.raw, self.known, self.names, self.at, self.p = raw, known, names, at, p

    def _same(self, q: int, k: int) -> bool:
        x, y = self.names[q], self.raw[k]
        return x == y or (not self.known[k] and min(len(x), len(y)) >= 3 and y not in self.names and SequenceMatcher(None, x, y, False).ratio() >= self.p.alike)

    def measure(self, d: int, q: int, n: int) -> tuple[int, int]:
        """As ``Pair.measure`` of the one tile of n words at d and q."""
        a, z, dz = q, q + n, d + n
        while a > 0 and d > 0 and self._same(a - 1, d - 1):
            a, d = a - 1, d - 1
        while z < len(self.names) and dz < len(self.raw) and self._same(z, dz):
            z, dz = z + 1, dz + 1
        stretch = self.at[z - 1] - self.at[a] + 1
        return stretch, stretch


class Items:
    """A few items in memory, for texts at hand: what ``find_leaks`` does with tables."""

    def __init__(self, rows: list[tuple], p: Tiling):
        self.p, self.ids, self.words, self.at, self.seeds, cache = p, [], [], [], defaultdict(list), {}
        for key, text in rows:
            w, at = item_words(text or "")
            if usable_item(w, at, p):
                for q, h in enumerate(rolling(hashes_of(w, cache), p.seed).tolist()):
                    self.seeds[h].append((len(self.ids), q))
                self.ids.append(key)
                self.words.append(w)
                self.at.append(at)
        self.vocabulary = {w for ws in self.words for w in ws}

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(place of the text, item, longest stretch in words) of all pairs that share a seed."""
        out, cache = [], {}
        for k, text in enumerate(texts):
            raw = words(text) if text else []
            hits = defaultdict(lambda: ([], []))
            for d, h in enumerate(rolling(hashes_of(raw, cache), self.p.seed).tolist()):
                for i, q in self.seeds.get(h, ()):
                    hits[i][0].append(d)
                    hits[i][1].append(q)
            known = np.array([w in self.vocabulary for w in raw], bool)
            out += [(k, i, Pair.of(raw, known, self.words[i], self.at[i], self.p).measure(*hits[i])[0]) for i in sorted(hits)]
        return out


def usable_item(w: list[bytes], at: list[int], p: Tiling) -> bool:
    return len(w) >= p.seed and at[-1] - at[0] + 1 >= p.words


def _items(p: Tiling, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, cache = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1).to_pylist()):
                w, at = item_words(text or "")
                if usable_item(w, at, p):
                    h = hashes_of(w, cache)
                    rows.append((i, (part << 40) + n, b" ".join(w), at, h.view(np.int64).tolist(), rolling(h, p.seed).view(np.int64).tolist()))
                    n += 1
            if rows:
                i, iid, w, at, h, seeds = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(iid, pa.int64()), b.column(0).take(pa.array(i)).cast(kind), pa.array(w, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["iid", "item_id", "item", "at", "hashes", "seeds"])

    return run


def _candidates(p: Tiling, sent, kind: pa.DataType):
    """Documents with a seed that may be an item's: their words, which of them may be words of the items, and those seeds with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (seeds, seed_size), (vocabulary, word_size) = sent.value
        part, n, cache = TaskContext.get().partitionId(), 0, {}
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                raws = [words(t) if t else [] for t in b.column(1).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
                h = hashes_of([w for r in raws for w in r], cache)
                runs = rolling(h, p.seed)
                hit = np.flatnonzero(_held(runs, seeds, seed_size))
                doc = np.searchsorted(starts, hit, "right") - 1
                inside = hit + p.seed <= starts[doc + 1]
                hit, doc = hit[inside], doc[inside]
                rows = []
                for k in np.unique(doc).tolist():
                    at, a, z = hit[doc == k], starts[k], starts[k + 1]
                    known = _held(h[a:z], vocabulary, word_size).astype(np.uint8).tobytes()
                    rows.append((k, (part << 40) + n, b" ".join(raws[k]), known, (at - a).tolist(), runs[at].view(np.int64).tolist()))
                    n += 1
                if rows:
                    k, key, w, known, at, found = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b.column(0).take(pa.array(k)).cast(kind), pa.array(w, pa.binary()), pa.array(known, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], names=["key", "doc_id", "words", "known", "places", "hashes"])

    return run


def _one_run(pos: list[int], places: list[int]) -> bool:
    """Whether the seeds follow one another on one diagonal: then they are one tile, whatever else the document holds."""
    n = len(pos) - 1
    return len({d - q for d, q in zip(pos, places)}) == 1 and max(pos) - min(pos) == n


def _tiled(p: Tiling, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, raw = None, []
        items: dict[int, tuple] = {}
        for b in batches:
            found = []
            hits, ends = b.column("hits"), b.column("hits").offsets.to_pylist()
            every, places = (hits.values.field(x).to_pylist() for x in ("pos", "place"))
            # words of a document and of an item are taken apart once while they come in a row
            for i, (key, iid, known) in enumerate(zip(*[b.column(c).to_pylist() for c in ("key", "iid", "known")])):
                if key != last:
                    last, raw = key, b.column("words")[i].as_py().split(b" ")
                if iid not in items:
                    if len(items) > 20_000:
                        items.clear()
                    items[iid] = (b.column("item")[i].as_py().split(b" "), b.column("at")[i].as_py())
                names, at = items[iid]
                pos, place = every[ends[i] : ends[i + 1]], places[ends[i] : ends[i + 1]]
                if _one_run(pos, place):
                    found.append((*Run(raw, known, names, at, p).measure(min(pos), min(place), len(pos) + p.seed - 1), at[-1] - at[0] + 1))
                else:
                    pair = Pair.of(raw, np.frombuffer(known, np.uint8) == 1, names, at, p)
                    found.append((*pair.measure(pos, place), at[-1] - at[0] + 1))
            best, covered, of = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            keep = pa.array((best >= p.words) | ((covered >= p.words) & (covered >= p.coverage * of)))
            columns = [b.column("doc_id"), b.column("item_id"), pa.array(best, pa.int32()), pa.array(covered, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.filter(keep).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, p: Tiling = Tiling()) -> DataFrame:
    """Documents with the items that they leak: (doc_id, item_id, words, covered), words being the longest stretch, covered all words of the item found.

    A pair leaks if one stretch has ``p.words`` words, or stretches in any order cover ``p.coverage`` of the item. Documents
    are read once, and only those that share a seed with an item go further. Both filters are of bounded size and let through
    more than they need to; the join of seeds decides. Null and empty texts and items of fewer than ``p.words`` words leak
    nothing; an empty table on either side gives no rows. Documents that repeat count each; rows with the same item_id are
    items of their own.
    """
    spark = documents.sparkSession
    key, item_key = documents.schema[doc_id].dataType, items.schema[item_id].dataType
    longs = T.ArrayType(T.LongType())
    made = T.StructType([T.StructField("iid", T.LongType()), T.StructField("item_id", item_key), T.StructField("item", T.BinaryType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("hashes", longs), T.StructField("seeds", longs)])
    held = materialize(items.select(item_id, item_text).mapInArrow(_items(p, to_arrow_schema(made).field("item_id").type), made), "items")
    seeds = held.select("iid", F.posexplode("seeds").alias("place", "hash"))
    vocabulary = held.select(F.explode("hashes").alias("hash")).distinct()
    sent = spark.sparkContext.broadcast((_filter(seeds, p), _filter(vocabulary, p)))

    fields = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", key), T.StructField("words", T.BinaryType()), T.StructField("known", T.BinaryType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("hashes", longs)])
    found = spread(documents.select(doc_id, text)).mapInArrow(_candidates(p, sent, to_arrow_schema(fields).field("doc_id").type), fields)
    found = materialize(found, "candidates")
    hits = found.select("key", F.explode(F.arrays_zip(F.col("places").alias("pos"), F.col("hashes").alias("hash"))).alias("h")).select("key", "h.pos", "h.hash")
    pairs = join_dimension(hits, seeds, ["hash"], "inner").groupBy("key", "iid").agg(F.collect_list(F.struct("pos", "place")).alias("hits"))  # of one document and one item
    pairs = materialize(pairs, "pairs")
    pairs = join_dimension(pairs, found.select("key", "doc_id", "words", "known"), ["key"], "inner")
    pairs = join_dimension(pairs, held.select("iid", "item_id", "item", "at"), ["iid"], "inner")
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("item_id", item_key), T.StructField("words", T.IntegerType()), T.StructField("covered", T.IntegerType())])
    return pairs.select("doc_id", "item_id", "key", "iid", "words", "known", "item", "at", "hits").mapInArrow(_tiled(p, to_arrow_schema(schema)), schema)
