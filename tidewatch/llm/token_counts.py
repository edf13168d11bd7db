"""Token counts of whole texts; huge texts by overlapping chunks that are spliced at stable boundaries.

A boundary between two characters is *stable* when no piece of the vocabulary has these two characters
next to each other: no merge can then ever cross it, so what lies left and right of it is encoded
independently of the other side. A chunk's tokens are only counted between two stable boundaries that
both neighbouring encodings have as token ends, so the sum equals the count of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts above this many characters are encoded in chunks.
HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
#: First width of the overlap of two chunks; doubled until the encodings share a stable boundary.
OVERLAP_CHARS = 256


@lru_cache(maxsize=4)
def _load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    joined = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            joined.update(zip(piece, piece[1:]))
    return model, joined


def _ends(model, chunk: str) -> list[int]:
    """Character offsets at which a token of ``chunk`` ends; the parts of a character share its end."""
    pieces = model.encode(chunk, return_type="proto").pieces
    raw = chunk.encode("utf-8")
    if pieces and pieces[-1].end == len(chunk):
        return [p.end for p in pieces]
    at = {0: 0}
    b = 0
    for i, c in enumerate(chunk):
        b += len(c.encode("utf-8"))
        at[b] = i + 1
    assert not pieces or pieces[-1].end == len(raw)
    return [at[p.end] for p in pieces]


def _stable(joined: set, text: str, at: int) -> bool:
    a, b = text[at - 1].replace(" ", "▁"), text[at].replace(" ", "▁")
    return (a, b) not in joined


def count_spliced(model, joined: set, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, from encodings of overlapping chunks only.

    The next chunk begins ``overlap`` characters before the end of the last one. If the two encodings have
    no common stable token end in the overlap, it is widened to twice its width, in both directions; once it
    covers the rest of the text, the rest is one chunk.
    """
    n, total = len(text), 0
    start, counted = 0, -1  # tokens that end up to ``counted`` are in total; the leading one may end at 0
    end = min(n, chunk)
    ends = [start + e for e in _ends(model, text[start:end])]
    while end < n:
        width = overlap
        while True:
            begin = max(counted, 0, end - width)
            stop = min(n, begin + max(chunk, 2 * width))
            nxt = [begin + e for e in _ends(model, text[begin:stop])]
            shared = set(nxt)
            # the last characters of the left chunk and the first of the right one lack their neighbours
            cut = next((e for e in reversed(ends) if max(begin, counted) < e < end and e in shared and _stable(joined, text, e)), None)
            if cut is not None:
                break
            if begin <= max(counted, 0):
                # no stable boundary anywhere in the left chunk: lengthen it
                end = min(n, end + max(chunk, width))
                ends = [start + e for e in _ends(model, text[start:end])]
                if end == n:
                    break
            width *= 2
        if end == n:
            break
        total += sum(counted < e <= cut for e in ends)
        counted, start, end, ends = cut, begin, stop, nxt
    return total + sum(e > counted for e in ends)


def count_tokens(texts: list[str], path: str, huge_chars: int = HUGE_CHARS) -> list[int]:
    model, joined = _load(path)
    small = [t for t in texts if len(t) <= huge_chars]
    counts = iter([len(x) for x in model.encode(small, num_threads=1)] if small else [])
    return [next(counts) if len(t) <= huge_chars else count_spliced(model, joined, t) for t in texts]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """Bytes and tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    Needs ``doc_id`` and ``text``; other columns are ignored. A null text counts as empty (0 bytes, 0
    tokens); a null ``doc_id`` and repeated rows pass through, one row out for each row in. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = count_tokens(texts, model_path, huge_chars)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
