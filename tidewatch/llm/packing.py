"""Best-fit packing of token sequences, improved by swaps between underfull bins.

Pieces are dealt into groups of bounded size. Each group is packed best-fit decreasing and then improved by
local search; the pieces of bins that stay open are dealt anew and packed again, until one group is left or a
level saves no sequence.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 4096
GROUP_ITEMS = 20_000
#: A bin is closed, and not packed again, when less than this share of it is free.
OPEN_SHARE = 0.005
#: Bins of one window of the local search; None makes all underfull bins of a group one window.
SEARCH_BINS: int | None = 48
#: Words with more bytes are not kept in the cache; the cache has two generations of so many words.
CACHE_WORD_BYTES, CACHE_WORDS = 64, 300_000
WORD_END = re.compile(rb"(?<=[A-Za-z0-9])[.,](?=\s|$)")


class WordIds:
    """Token ids of texts, as little-endian bytes, from the library's ids of their words.

    The tokenizer removes white space and has no piece that spans it, so a text's ids are its words' ids one
    after the other. Words are split at ASCII white space only; whatever else the tokenizer takes for white
    space stays inside a word and is handled by it. Ids of frequent words are kept in two generations.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        self.raw = [i.to_bytes(4, "little") for i in range(size)]
        self.last = [(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def split(text: str) -> list[bytes]:
        """Words, fewer different ones where that can't matter to a tokenizer that lowers case itself: A-Z are
        lowered and a full stop or comma at a word's end is a word, unless a combining mark, which might
        compose with a lower-case letter only, or a special token is in the text."""
        raw = text.encode("utf-8")
        if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw:
            return raw.split()
        return WORD_END.sub(rb" \g<0>", raw).lower().split()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Words of letters only are one symbol run each and encoded many at a time, cut where a run ends."""
        decoded = [w.decode("utf-8") for w in words]
        plain = [i for i, w in enumerate(decoded) if w.isalpha()]
        out: list[bytes] = [b""] * len(words)
        alone = [i for i, w in enumerate(decoded) if not w.isalpha()]
        parts = [plain[at : at + 128] for at in range(0, len(plain), 128)]
        raw, last = self.raw, self.last
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join([decoded[i] for i in p]) for p in parts], add_special_tokens=False)):
            ids = e.ids
            ends = [k + 1 for k, x in enumerate(ids) if last[x]]
            if len(ends) != len(part):
                alone += part
                continue
            begin = 0
            for i, end in zip(part, ends):
                out[i] = b"".join([raw[x] for x in ids[begin:end]])
                begin = end
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([decoded[i] for i in alone], add_special_tokens=False)):
            out[i] = b"".join([raw[x] for x in e.ids])
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        wanted = set().union(*split)
        if len(self.new) + len(wanted) > CACHE_WORDS:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        here: dict[bytes, bytes] = {}
        missing = []
        for w in wanted.difference(new):
            if (ids := old.get(w)) is not None:
                new[w] = ids
            else:
                missing.append(w)
        for at in range(0, len(missing), 8192):
            part = missing[at : at + 8192]
            for w, ids in zip(part, self._encode(part)):
                (new if len(w) <= CACHE_WORD_BYTES else here)[w] = ids
        get = {**new, **here}.__getitem__ if here else new.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's token sequence.

    A document is its token ids and ``end_id``; a null text counts as empty and is ``end_id`` alone. Only
    documents above ``capacity`` are cut, each piece but the last being full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = _encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            at, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += last
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    raw.append(part)
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Bins:
    """Bins of item numbers; lengths decide, numbers only break ties, so that results repeat."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []

    def best_fit_decreasing(self, lengths: list[int]) -> None:
        """Each item goes to the fullest bin that has room for it; rooms in use are the bits of one integer."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        used = 0
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            n = lengths[i]
            fits = used >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    used &= ~(1 << r)
            else:
                r, b = self.capacity, len(self.items)
                self.items.append([])
                self.room.append(r)
            r -= n
            self.items[b].append(i)
            self.room[b] = r
            if r:
                by_room[r].append(b)
                used |= 1 << r

    def improve(self, lengths: list[int], bins: int | None = SEARCH_BINS) -> None:
        """Search all underfull bins, in windows of ``bins`` (None: all at once) by room, until a whole pass empties none."""
        while True:
            live = sorted((b for b in range(len(self.items)) if self.items[b] and self.room[b]), key=lambda b: (-self.room[b], b))
            width = bins or max(1, len(live))
            for at in range(0, len(live), width):
                self._search(live[at : at + width], lengths)
            if all(self.items[b] for b in live):
                return

    def _search(self, live: list[int], lengths: list[int]) -> None:
        """Empty the least full of ``live``: each exchange moves length to a fuller bin, which raises the squared fill.

        From the emptiest bin, one item moves, or one item is exchanged for one or two shorter ones, or two
        items for one; the exchange that fills the other bin most is made. A bin from which none is possible
        is left as it is.
        """
        stuck: set[int] = set()
        while len(live) > 1:
            live = [b for b in live if self.items[b] and self.room[b]]
            source = max((b for b in live if b not in stuck), key=lambda b: (self.room[b], -b), default=None)
            if source is None:
                return
            best = None
            given = self._choices(source, lengths)
            for b in live:
                if b != source and self.room[b] <= self.room[source]:
                    if (found := self._exchange(given, b, lengths)) and (best is None or found[0] > best[0]):
                        best = (*found, b)
            if best is None:
                stuck.add(source)
                continue
            gain, out, back, target = best
            for x in out:
                self.items[source].remove(x)
            for x in back:
                self.items[target].remove(x)
            self.items[source] += back
            self.items[target] += out
            self.room[source] += gain
            self.room[target] -= gain
            stuck.clear()

    def _choices(self, b: int, lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
        """Sums of one and two items of a bin, one example of each, ascending."""
        one: dict[int, list[int]] = {}
        for i in self.items[b]:
            one.setdefault(lengths[i], []).append(i)
        sums = {2 * n: (x[0], x[1]) for n, x in one.items() if len(x) > 1}
        sums |= {m + n: (one[m][0], one[n][0]) for m, n in combinations(one, 2)}
        sums |= {n: (x[0],) for n, x in one.items()}
        return sorted(sums.items())

    def _exchange(self, given, target: int, lengths: list[int]):
        """(gain, items out, items back) of the best exchange with ``target``, the gain filling its room at most."""
        room, best = self.room[target], None
        back = [(0, ()), *self._choices(target, lengths)]
        sizes = [n for n, _ in given]
        for n, came in back:
            at = bisect_right(sizes, n + room) - 1
            while at >= 0 and sizes[at] > n:
                if len(given[at][1]) + len(came) <= 3:
                    if best is None or sizes[at] - n > best[0]:
                        best = (sizes[at] - n, given[at][1], came)
                    break
                at -= 1
            if best and best[0] == room:
                break
        return best

    def placed(self) -> list[list[int]]:
        return [x for x in self.items if x]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, search_bins: int | None = SEARCH_BINS) -> list[list[int]]:
    bins = Bins(capacity)
    bins.best_fit_decreasing(lengths)
    bins.improve(lengths, search_bins)
    return bins.placed()


def _pack_groups(items: DataFrame, groups: int, level: int, capacity: int, search_bins: int | None) -> DataFrame:
    """Columns of ``items`` with sequence_id, offset and open; sequence ids hold level, group and bin."""
    allowed = capacity * OPEN_SHARE

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].tolist()
        base = (level << 48) | (int(pdf["grp"].iloc[0]) << 24)
        seq, offset, is_open = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for b, members in enumerate(pack_lengths(lengths, capacity, search_bins)):
            at = 0
            free = capacity - sum(lengths[i] for i in members)
            for i in members:
                seq[i], offset[i], is_open[i] = base | b, at, free > allowed
                at += lengths[i]
        return pdf.drop(columns="grp").assign(sequence_id=seq, offset=offset, open=is_open)

    kept = [f for f in items.schema.fields if f.name not in ("sequence_id", "offset", "open", "grp")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long, open boolean"
    dealt = items.select(*[f.name for f in kept]).withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, search_bins: int | None = SEARCH_BINS) -> DataFrame:
    """``items`` (a long ``length`` of 1 to ``capacity``, any other columns) with sequence_id and offset.

    Each sequence's items lie gapless from offset 0 and sum to at most ``capacity``. Ties and repeated rows
    are told apart by their place in the written table; an empty table stays empty. Columns named
    sequence_id, offset, uid, open or grp are replaced. Full items are sequences of their own.

    The search has two bounds: groups of about ``group_items`` pieces are packed each on its own, and exchanges
    are looked for inside windows of ``search_bins`` underfull bins of a group (None: all of them). All
    underfull bins are searched, and open bins are dealt again while a level saves sequences.
    """
    drop = [c for c in items.columns if c in ("sequence_id", "offset", "uid", "open", "grp")]
    table = written(items.drop(*drop)).withColumn("uid", F.monotonically_increasing_id())
    table = written(table)
    done = table.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    rest, level, opened, most = table.where(F.col("length") < capacity), 1, None, None
    while True:
        groups = max(1, -(-rest.count() // group_items))
        tried = written(_pack_groups(rest, groups, level, capacity, search_bins))
        used = tried.select("sequence_id").distinct().count()
        if most is not None and used >= most:  # this level saves no sequence: the open bins stay as they were
            done = done.unionByName(opened.drop("open"))
            break
        opened = tried.where("open")
        done = done.unionByName((tried if groups == 1 else tried.where("not open")).drop("open"))
        if groups == 1 or not (most := opened.select("sequence_id").distinct().count()):
            break
        rest, level = opened.drop("open", "sequence_id", "offset"), level + 1
    return done.drop("uid")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty, null ids and repeated rows are packed like any other row, extra columns are
    ignored, and an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer_path, end_id, capacity), capacity)
