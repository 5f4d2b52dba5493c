"""Exact token ids of whole texts, with the tokenizers library.

The library encodes each distinct chunk of text once per task; a text's ids are
its chunks' ids in order. Chunks are cut only where the tokenizer itself always
cuts, so the ids equal those of encoding the whole text at once:

* ``spaces``: at ASCII white space, for tokenizers that drop white space and
  whose pieces never cross it;
* ``space_prefix``: before a single space between two non-space characters,
  for byte-level tokenizers whose pieces may start with one space. A text with
  other white space next to a space is encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagesift.llm.arrays import gather_runs
from pagesift.llm.common import worker_object

# distinct chunks kept in a task before its memory is given back
CACHE_CHUNKS = 500_000
_SEPARATOR = "<|endoftext|>"
_UNSAFE = r"^$|^[\s\pZ\x0B\x1C-\x1F\x85]|[\s\pZ\x0B\x1C-\x1F\x85]$|<\|"


class ChunkTokenizer:
    """Token ids of batches of texts; one object per task."""

    def __init__(self, path: str, cut: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        if cut not in ("spaces", "space_prefix"):
            raise ValueError(cut)
        self.tok, self.cut = Tokenizer.from_file(path), cut
        self.sep_id = self.tok.token_to_id(_SEPARATOR)
        if cut == "space_prefix":  # tokens that begin with the mapped space byte open a chunk
            vocab = self.tok.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.empty(1 << 15, dtype=np.int64)
        self.length = np.empty(1 << 15, dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in
                self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk. Many chunks go to the library as one text, set
        apart by the end-of-text token, which the library never merges."""
        plain = [i for i, c in enumerate(chunks) if "<|" not in c]
        out: list = [None] * len(chunks)
        if self.cut == "space_prefix":  # a chunk's only space is its first character
            plain = [i for i in plain if chunks[i][:1] == " "]
            for lo in range(0, len(plain), 1000):
                part = plain[lo:lo + 1000]
                ids = self._whole(["".join([chunks[i] for i in part])])[0]
                starts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
                if len(starts) != len(part) + 1:
                    raise ValueError("a chunk was cut at another place")
                for k, i in enumerate(part):
                    out[i] = ids[starts[k]:starts[k + 1]]
            plain = []
        for lo in range(0, len(plain), 1000):
            part = plain[lo:lo + 1000]
            ids = self._whole([_SEPARATOR.join([chunks[i] for i in part])])[0]
            ends = np.append(np.flatnonzero(ids == self.sep_id), len(ids))
            if len(ends) != len(part):
                raise ValueError("the separator was merged")
            begin = 0
            for i, end in zip(part, ends):
                out[i] = ids[begin:end]
                begin = end + 1
        odd = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(odd, self._whole([chunks[i] for i in odd])):
            out[i] = ids
        return out

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """Cache slot of each of the distinct chunks; new ones are encoded."""
        if len(self.known) > CACHE_CHUNKS:
            self._clear()
        get = self.known.get
        slots = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            fresh = [chunks[i] for i in missing]
            new = self._encode(fresh)
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            ends = self.used + np.cumsum(lengths)
            if ends[-1] > len(self.pool):
                self.pool = np.concatenate([self.pool[:self.used], np.empty(2 * ends[-1] - self.used, np.int32)])
            n = len(self.known)
            if n + len(new) > len(self.start):
                more = np.empty(2 * (n + len(new)) - len(self.start), np.int64)
                self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
            self.pool[self.used:ends[-1]] = np.concatenate(new)
            self.start[n:n + len(new)], self.length[n:n + len(new)] = ends - lengths, lengths
            self.used = int(ends[-1])
            slots[missing] = np.arange(n, n + len(new))
            self.known.update(zip(fresh, range(n, n + len(new))))
            if len(self.known) != n + len(new):
                raise ValueError("chunks must be distinct")
        return slots

    def _join(self, parts: pa.ListArray):
        """Ids and offsets of rows that are lists of chunks."""
        enc = parts.flatten().dictionary_encode()
        slots = self._slots(enc.dictionary.to_pylist())
        codes = slots[enc.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[codes]
        ids = self.pool[gather_runs(self.start[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[parts.offsets.to_numpy(zero_copy_only=False) - parts.offsets[0].as_py()]

    def encode(self, texts: pa.Array):
        """(ids, offsets) of a batch; a null text is an empty one."""
        texts = pc.fill_null(texts, "")
        if len(texts) == 0:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        if self.cut == "spaces":
            return self._join(pc.ascii_split_whitespace(texts))
        parts = pc.split_pattern(texts, " ")
        off = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        enc = parts.flatten().dictionary_encode()
        codes = enc.indices.to_numpy(zero_copy_only=False)
        # words that are empty or have white space at an end, or a special token's text
        bad = pc.match_substring_regex(enc.dictionary, _UNSAFE).to_numpy(zero_copy_only=False).astype(bool)
        bad_before = np.concatenate([[0], np.cumsum(bad[codes])])
        odd = bad_before[off[1:]] > bad_before[off[:-1]]
        words = enc.dictionary.to_pylist()
        slots = np.zeros(len(words), dtype=np.int64)
        good = np.flatnonzero(~bad)
        first_codes = codes[off[:-1][~odd]]
        firsts, inv = np.unique(first_codes, return_inverse=True)
        # one call for both: a later call could empty the cache under the first one
        found = self._slots([" " + words[i] for i in good] + [words[i] for i in firsts])
        slots[good] = found[:len(good)]
        keep = np.repeat(~odd, np.diff(off))
        chunk = slots[codes[keep]]
        offs = np.concatenate([[0], np.cumsum(np.diff(off)[~odd])])
        chunk[offs[:-1]] = found[len(good):][inv]
        lengths = self.length[chunk]
        ids = self.pool[gather_runs(self.start[chunk], lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[offs]
        if not odd.any():
            return ids, offsets
        whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        rows, k = [], 0
        for is_odd in odd:
            if is_odd:
                rows.append(next(whole))
            else:
                rows.append(ids[offsets[k]:offsets[k + 1]])
                k += 1
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def tokenizer_for(path: str, cut: str) -> ChunkTokenizer:
    """The worker's tokenizer, with what it has cached in earlier tasks."""
    return worker_object((path, cut), lambda: ChunkTokenizer(path, cut))


def with_end_id(ids: np.ndarray, offsets: np.ndarray, end_id: int):
    """Append ``end_id`` to each row."""
    n = len(offsets) - 1
    out_offsets = offsets + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, dtype=np.int32)
    keep = np.ones(len(out), dtype=bool)
    keep[out_offsets[1:] - 1] = False
    out[keep] = ids
    return out, out_offsets
