"""Token ids of texts, exactly as the ``tokenizers`` library makes them, with words encoded once.

The library is slow next to a table look-up, and words come back again and again.  A slice of texts is
cut at single spaces, which no token of the two supported layouts crosses; the different pieces
are cut into words, and words the worker has not met yet go through the library's merges, a
thousand at a time.  Cutting, numbering and putting together are Arrow and NumPy calls over the
whole slice.  Where a cut could change a token (two spaces in a row, a space at the end, special
tokens, letters outside a plain set) the library encodes the text or piece whole.

Layouts: byte-level merges with the space in front of a word as part of it, and merges with word
ends where white space is dropped.  Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import in_slices, worker_state

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = _CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


def pick_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes lists of texts; ``keep`` bounds the words held between slices."""

    def __init__(self, path: str, keep: int = 100_000):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        vocab = self.library.get_vocab(True)
        self.size = 1 + max(vocab.values(), default=0)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.layout, self.keep = self._layout(spec), keep
        if self.layout == "other":
            return
        # Letters whose class and lower case all Unicode versions agree on.
        big, letters = ("", "a-zß-öø-ÿ") if self.layout == "words" else (" ?", "A-Za-zÀ-ÖØ-öø-ÿ")
        one = "[0-9]" if self.layout == "words" else " ?[0-9]+"
        self.cut = f"({_CONTRACTIONS}|{big}[{letters}]+|{one}|{big}[^\\s{letters}0-9]+|\\n)"
        # The library's merges alone, for words cut and mapped to byte characters beforehand.
        bare = {**spec, "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "decoder": None}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        self.chars = byte_chars() | {0: " "}  # a zero byte parts two words
        self.lengths = np.zeros(self.size, np.int64)  # bytes of text behind each id
        for token, i in vocab.items():
            self.lengths[i] = len(token.removesuffix("</w>") if self.layout == "words" else token)
        self._forget()

    @staticmethod
    def _layout(spec: dict) -> str:
        pre, norm, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
        if spec["post_processor"] is None and model.get("type") == "BPE" and not model.get("dropout"):
            if (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None
                    and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])):
                return "bytes"
            kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
            parts = pre.get("pretokenizers", [])
            if (kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]
                    and parts[0]["invert"] and parts[0]["pattern"].get("Regex", "") == _WORDS):
                return "words"
        return "other"

    def _forget(self) -> None:
        self.slots: dict[str, int] = {"\n": 0} if self.layout == "words" else {}
        self.starts, self.counts = [np.zeros(1, np.int64)] * len(self.slots), [np.zeros(1, np.int64)] * len(self.slots)
        self.stock, self.filled = np.zeros(1 << 20, self.dtype), 0

    def _keep(self, ids: np.ndarray) -> int:
        at = self.filled
        if at + len(ids) > len(self.stock):
            self.stock = np.concatenate([self.stock[:at], np.zeros(len(ids) + len(self.stock), self.dtype)])
        self.stock[at:at + len(ids)] = ids
        self.filled = at + len(ids)
        return at

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for at in range(0, len(texts), 2000)
                for e in self.library.encode_batch_fast(texts[at:at + 2000], add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Many words as one text to the library, cut again where the bytes of a word end."""
        for at in range(0, len(words), 1000):
            raw = [a.encode() for a in words[at:at + 1000]]
            text = b"\0".join(raw).decode("latin-1").translate(self.chars)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(a) for a in raw])) + 1
            starts = np.concatenate([[0], ends[:-1]])
            self.starts.append(starts + self._keep(ids))
            self.counts.append(ends - starts)

    def _pieces(self, pieces: pa.Array, front: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) of different pieces; ``front``: a space stands before each."""
        n = len(pieces)
        if self.layout == "words":
            odd = pc.invert(pc.match_substring_regex(pieces, "^[\\n!-~À-ÖØ-öø-ÿ]*$"))
        else:
            odd = pc.invert(pc.match_substring_regex(pieces, "^\\n?([!-~À-ÖØ-öø-ÿ]+\\n?)*$"))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(pieces, s))
        odd = odd.to_numpy(zero_copy_only=False)
        texts = pc.binary_join_element_wise(" ", pieces, "") if front and self.layout == "bytes" else pieces
        cut = pc.replace_with_mask(texts, pa.array(odd), pa.scalar(""))
        if self.layout == "words":
            cut = pc.utf8_lower(cut)
        cut = pc.split_pattern(pc.replace_substring_regex(cut, self.cut, "\\1\x01"), "\x01")
        flat = cut.flatten()
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = flat.dictionary_encode()
        slots, new, get = [], [], self.slots.get
        for w in coded.dictionary.to_pylist():
            slot = get(w) if w else -1
            if slot is None:
                slot = len(self.slots)
                self.slots[w] = slot
                new.append(w)
            slots.append(slot)
        self._learn(new)
        self.starts, self.counts = [np.concatenate([*self.starts, np.zeros(0, np.int64)])], [np.concatenate([*self.counts, np.zeros(0, np.int64)])]
        slot = np.array(slots, np.int64)
        real = slot >= 0
        wcount, wstart = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        wcount[real], wstart[real] = self.counts[0][slot[real]], self.starts[0][slot[real]]
        if self.layout == "words" and len(self.slots):
            wcount[slot == 0] = 0  # a line feed has no token
        at = coded.indices.to_numpy().astype(np.int64)
        per = wcount[at]
        ids = self.stock[pick_runs(wstart[at], per)]
        sums = np.concatenate([[0], np.cumsum(per)])
        starts, counts = sums[offsets[:-1]], sums[offsets[1:]] - sums[offsets[:-1]]
        if odd.any():
            where = np.flatnonzero(odd)
            own = self._whole(texts.take(pa.array(where)).to_pylist())
            counts[where] = [len(x) for x in own]
            starts[where] = len(ids) + np.cumsum(counts[where]) - counts[where]
            ids = np.concatenate([ids, *own])
        assert len(starts) == n
        return ids, starts, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.layout == "other":
            return self._whole(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        whole, split = [], []
        for i, t in enumerate(texts):
            unsafe = self.layout == "bytes" and ("  " in t or t[-1:] == " " or any(s in t for s in self.special))
            (whole if unsafe or "\0" in t or "\x01" in t else split).append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        if not split:
            return out
        if len(self.slots) > self.keep:
            self._forget()
        lists = pc.split_pattern(pa.array([texts[i] for i in split], pa.string()), " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        ids, starts, counts = self._pieces(coded.dictionary, True)
        if self.layout == "bytes":  # the first piece of a text has no space before it
            heads, inverse = np.unique(at[offsets[:-1]], return_inverse=True)
            ids1, starts1, counts1 = self._pieces(coded.dictionary.take(pa.array(heads)), False)
            at[offsets[:-1]] = len(starts) + inverse
            starts, counts = np.concatenate([starts, starts1 + len(ids)]), np.concatenate([counts, counts1])
            ids = np.concatenate([ids, ids1])
        per = counts[at]
        all_ids = ids[pick_runs(starts[at], per)]
        sums = np.concatenate([[0], np.cumsum(per)])
        for i, a, b in zip(split, sums[offsets[:-1]].tolist(), sums[offsets[1:]].tolist()):
            out[i] = all_ids[a:b]
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its words stay between tasks."""
    state = worker_state().setdefault("encoders", {})
    if path not in state:
        state[path] = Encoder(path)
    return state[path]


def encode_slices(rows, path: str, weight: int = 2 << 20, keep: int = 100_000):
    """(row, ids) for rows (id, text, ...), a slice of the texts at a time; ``keep`` words stay between slices."""
    enc = encoder(path)
    enc.keep = keep
    for part in in_slices(rows, weight):
        yield from zip(part, enc.encode([r[1] for r in part]))
