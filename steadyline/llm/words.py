"""Words of whole texts as flat numpy arrays, one Arrow batch at a time."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: byte for byte, so that offsets stay as they are
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z, other ASCII that is neither letter nor digit to a blank; all bytes of longer characters are kept
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Words(NamedTuple):
    code: np.ndarray  # number of each word in ``vocab``
    start: np.ndarray  # of each text: its first word; one entry more than texts
    vocab: pa.Array  # distinct words, binary

    def counts(self):
        return np.diff(self.start)

    def text_no(self):
        return np.repeat(np.arange(len(self.start) - 1), self.counts())


def translated(texts: pa.Array, table: bytes | None) -> pa.Array:
    """The texts as large_string, mapped byte for byte; null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if table is None or not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    mapped = bytes(memoryview(data)[at[0] : at[-1]]).translate(table) if data else b""
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(mapped))


def words_of(texts: pa.Array, table: bytes | None = None) -> Words:
    """Words between blanks (space and \\x09-\\x0D) after mapping by ``table``; a null text has none."""
    lists = pc.ascii_split_whitespace(translated(texts, table))
    flat = lists.flatten()
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    text_no = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if (size == 0).any():  # blanks at either end
        flat, text_no = flat.filter(pa.array(size > 0)), text_no[size > 0]
    start = np.concatenate([[0], np.cumsum(np.bincount(text_no, minlength=len(lists)))]).astype(np.int64)
    coded = flat.cast(pa.large_binary()).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), start, coded.dictionary)


def listed(values: pa.Array) -> list[bytes]:
    """Values of a binary array; far faster than to_pylist for many short ones."""
    return values.to_numpy(zero_copy_only=False).tolist()


def hashes(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit halves of each word's XXH3-128."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in listed(vocab)]), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values, so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions near the end of a text run into the next one."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + word[i : len(word) - n + 1 + i]
    return mixed(out)


def gram_starts(start: np.ndarray, n: int) -> np.ndarray:
    """True at each position from which n words of the same text follow; as long as gram_hashes' result."""
    total = int(start[-1])
    inside = np.zeros(max(0, total - n + 1), bool)
    if len(inside):
        text_end = np.repeat(start[1:], np.diff(start))
        inside[:] = np.arange(len(inside)) + n <= text_end[: len(inside)]
    return inside
