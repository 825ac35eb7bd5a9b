"""Quality rules with compression bands: word counts, repeated windows, and zstandard ratios over whole texts and chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import batches, map_batches

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20


@dataclass(frozen=True)
class Bands:
    """Compressed over raw bytes must lie within (low, high). `whole` and `chunk` list (least raw bytes, low, high) in ascending
    order; the last that applies to a length holds. Below the first entry nothing is rejected: a frame header and an
    untrained entropy coder tell nothing about some tens of bytes.

    The upper limits lie between prose and printable noise, which part further the longer a text is. Most that was measured (zstandard level 3) for prose of sf0.1
    and for licences and Korean interface texts, as single words the densest, against the least of base64, of letters of both cases with spaces and of lower case:
    256 bytes 0.89 against 0.94, 0.88 and 0.73; 512: 0.78 against 0.84, 0.79 and 0.66; 1024: 0.68 against 0.80, 0.74 and 0.62; 2048: 0.59 against 0.77, 0.72 and
    0.61; 4096: 0.55 against 0.76, 0.71 and 0.60. So base64 is out from 320 bytes, mixed-case letters from 768, lower case with digits from 1536 and lower case alone
    from 4096; below that noise passes, as it is no denser than some prose. A short text repeated over and over falls below 0.1. Hexadecimal noise is as dense as
    prose and passes."""

    level: int = 3
    chunk_bytes: int = 4096
    whole: tuple[tuple[int, float, float], ...] = (
        (64, 0.12, 1.15), (256, 0.18, 0.91), (320, 0.18, 0.87), (384, 0.18, 0.83), (512, 0.18, 0.78), (768, 0.18, 0.73), (1024, 0.18, 0.69), (1536, 0.18, 0.65), (2048, 0.18, 0.62),
        (4096, 0.16, 0.58), (32768, 0.14, 0.58),
    )
    #: A last chunk may be short: under 2048 bytes it has an upper limit alone.
    chunk: tuple[tuple[int, float, float], ...] = ((512, 0.0, 0.78), (768, 0.0, 0.73), (1024, 0.0, 0.69), (1536, 0.0, 0.65), (2048, 0.16, 0.62), (4096, 0.16, 0.58))
    #: Share of a text's chunks that must be out of their band before it is rejected for them.
    chunk_share: float = 0.25


def band(limits: tuple[tuple[int, float, float], ...], size: int) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, lo, hi in limits:
        if size >= least:
            low, high = lo, hi
    return low, high


def repeated_words(words: list[bytes]) -> int:
    """Words covered by some 5-word window that occurs twice or more in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n > LONG:
        again = _windows_met_again(words)
    else:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        seen = Counter(windows)
        if len(seen) == n:
            return 0
        again = [i for i, w in enumerate(windows) if seen[w] > 1]
    covered, free = 0, 0  # free: the first position that is not yet covered
    for i in again:
        covered += i + WINDOW - max(free, i)
        free = i + WINDOW
    return covered


#: Windows of longer texts are numbered in arrays, as objects for each would take some 130 bytes a word.
LONG = 100_000


def _windows_met_again(words: list[bytes]) -> list[int]:
    """Places of the windows that occur twice or more: words are numbered, then ever longer runs by the pair of a run and the word after it."""
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    run = word
    for k in range(1, WINDOW):
        _, run = np.unique(run[:-1] * len(numbers) + word[k:], return_inverse=True)
    return np.flatnonzero(np.bincount(run)[run] > 1).tolist()


def compression(raw: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole text, number of chunks, chunks out of band, and whether the bands accept the text."""
    if not raw:
        return None, 0, 0, True
    ratio = len(compressor.compress(raw)) / len(raw)
    low, high = band(bands.whole, len(raw))
    good = low < ratio < high
    n, out = 0, 0
    if len(raw) > bands.chunk_bytes:
        for at in range(0, len(raw), bands.chunk_bytes):
            piece = raw[at : at + bands.chunk_bytes]
            low, high = band(bands.chunk, len(piece))
            r = len(compressor.compress(piece)) / len(piece)
            n += 1
            out += not low < r < high
        good = good and out <= bands.chunk_share * n
    return ratio, n, out, good


def judge(text: str | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeats = repeated_words(words)
    chars = sum(len(w) for w in words) if len(raw) == len(text or "") else len("".join((text or "").translate(SPACES)))
    symbols = sum(raw.count(s) for s in SYMBOL_BYTES)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * len(words)
    ratio, n_chunks, out, good = compression(raw, bands, compressor)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed, not failed and good, ratio, n_chunks, out


SPACES = dict.fromkeys(map(ord, " \t\n\v\f\r"))
SYMBOL_BYTES = [s.encode() for s in SYMBOLS]
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks int, n_chunks_out int"
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64(), pa.int32(), pa.int32())


def quality_rules(docs: DataFrame, bands: Bands = Bands(), keep_text: bool = False) -> DataFrame:
    """Measures and verdict of every whole text, in one pass without a shuffle.

    docs needs doc_id and text; every row gives one row, repeated rows and equal texts included. A null or empty text
    has no words and fails the base rule. keep_text: all input columns stay (a measure's name is then taken over by the
    measure), else doc_id alone does. An empty table gives no rows. Memory: a batch, and one text with its words and windows at a time.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    keep = [c for c in docs.columns if c not in names] if keep_text else ["doc_id"]
    picked = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches(parts, "text"):
            found = [judge(t.as_py(), bands, compressor) for t in batch.column("text")]
            measured = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *measured], names=[*keep, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in keep)
    return map_batches(picked, run, f"{kept}, {MEASURES}")
