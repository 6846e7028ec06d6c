"""Array-at-a-time use of a public tokenizer: pre-tokens found by character class, distinct ones encoded once.

Pre-tokens are found for whole slices of documents with array operations, hashed, and looked up in a memo that starts
with the vocabulary strings proven to be one token alone. Only pre-tokens never seen before go through the library's
merges. A hash only finds a candidate: its characters are compared with those of the pre-token, within the slice and in
the memo. Texts with rare characters (whose class or case may differ between Unicode versions), with strings of special
tokens, with very long pre-tokens or with one whose hash another string has go to the library whole, so results are
always the library's.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from corpusmem.llm.util import mix, powers, slices, utf8

#: Character ranges whose class and case are settled: up to Latin Extended, Greek and Cyrillic, common marks, kana, Han, Hangul.
_SETTLED = [(0x00, 0x2AF), (0x386, 0x52F), (0x2010, 0x2052), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x3000, 0x3002), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE, UNSETTLED = range(5)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The memo of a task is emptied beyond so many entries.
MEMO = 600_000
#: Bytes of text cut and hashed at once, and new pre-tokens given to the library at once.
SLICE, NEW = 1_000_000, 4_096
#: A text with a longer pre-token goes to the library whole.
LONG = 64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of each code point of the basic plane, and random words to hash them with."""
    kind, low = np.full(1 << 16, UNSETTLED, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    for a, b in _SETTLED:
        for cp in range(a, b + 1):
            c = chr(cp)
            if unicodedata.category(c) == "Cn" or unicodedata.normalize("NFC", c) != c or len(c.lower()) != 1:
                continue
            kind[cp] = LETTER if letter.match(c) else NUMBER if number.match(c) else OTHER
            low[cp] = ord(c.lower())
    kind[_SPACES] = SPACE
    return kind, low, np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, other bytes follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> list[tuple[str, int]]:
    """Proves, with the library itself, which vocabulary strings encode alone as exactly one token: (string, id).

    The list is bounded by the vocabulary (about 50,000 short strings), so it may be broadcast.
    """
    tok, alphabet, found = load(path), byte_alphabet(), []
    for shown, token_id in tok.get_vocab(with_added_tokens=False).items():
        try:
            found.append((bytes(alphabet[c] for c in shown.removesuffix("</w>")).decode("utf-8"), token_id))
        except (KeyError, UnicodeDecodeError):
            continue
    kept = []
    for i in range(0, len(found), 5_000):
        part = found[i : i + 5_000]
        kept += [x for x, e in zip(part, tok.encode_batch([s for s, _ in part], add_special_tokens=False), strict=True) if e.ids == [x[1]]]
    return kept


def _differ(a: np.ndarray, at: np.ndarray, lengths: np.ndarray, b: np.ndarray, bt: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether runs of a differ from runs of b, pair by pair."""
    out = lengths != others
    n = np.where(out, 0, lengths)
    ends = np.cumsum(n)
    place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    wrong = a[np.repeat((at - ends + n).astype(np.int32), n) + place] != b[np.repeat((bt - ends + n).astype(np.int32), n) + place]
    if wrong.any():
        out[np.searchsorted(ends, np.flatnonzero(wrong), "right")] = True
    return out


class Encoder:
    """Encodes Arrow string columns. words: the vocabulary of lower-cased words with ends; else byte-level pre-tokens."""

    def __init__(self, path: str, whole: list[tuple[str, int]], words: bool):
        self.tok, self.words = load(path), words
        self.kind, self.low, self.table = _tables()
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.start = whole
        self.forget()

    def forget(self) -> None:
        """Empties the memo but for the vocabulary strings that are one token alone and stay one pre-token."""
        data, offsets = utf8(pa.array([s for s, _ in self.start], pa.string()))
        fit = ~self._odd(data, offsets) & (np.diff(offsets) > 0)
        codes = np.frombuffer("".join(s for (s, _), ok in zip(self.start, fit, strict=True) if ok).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for (s, _), ok in zip(self.start, fit, strict=True) if ok])]).astype(np.int64)
        starts, ends = self._cut(codes, at)
        one = np.diff(np.searchsorted(starts, at)) == 1
        one &= np.isin(at[:-1], starts) & np.isin(at[1:], ends)
        keys = self._hashes(codes, at[:-1][one], at[1:][one])
        order = np.argsort(keys)
        self.keys, self.sizes, self.firsts = keys[order], np.ones(len(keys), np.int64), np.arange(len(keys))
        self.ids = np.array([i for _, i in self.start], np.uint32)[fit][one][order]
        self.text, self.begins, self.lengths = codes.astype(np.uint16), at[:-1][one][order], np.diff(at)[one][order]

    def _hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.table[codes] * up[: len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def _cut(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of documents that begin at `at`."""
        n, kind = len(codes), self.kind[codes]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        first = cut.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        cut[0] = cut[n] = True
        space = kind == SPACE
        if self.words:
            cut[:n] |= kind == NUMBER
            attached = np.zeros(n, bool)
        else:
            # the last white space before something else stands apart, and a plain space joins what follows
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
            cut[last] = True
            joined = last[codes[last] == 32]
            cut[joined + 1] = False
            attached = np.zeros(n + 1, bool)
            attached[joined + 1] = True
        quotes = np.flatnonzero(codes[:-1] == 39) if n > 1 else np.zeros(0, np.int64)
        if len(quotes):
            alone = ((kind[quotes + 1] == LETTER) & cut[quotes + 1] & ~first[quotes + 1]) & cut[quotes]
            for q in quotes[alone & ~attached[quotes]]:
                for c in _CONTRACTIONS:
                    end = q + 1 + len(c)
                    if end <= n and not first[q + 1 : end].any() and "".join(map(chr, codes[q + 1 : end])) == c:
                        cut[q + 1] = False
                        cut[end] = True
                        break
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        if self.words:
            keep = kind[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Memo entries of all pre-tokens of settled documents, how many each document has, and which ones need the library."""
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        if self.words:
            codes = self.low[codes]
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, bool)
        starts, ends = self._cut(codes, at)
        n = np.diff(np.searchsorted(starts, at))
        doc = np.repeat(np.arange(len(n)), n)
        bad = np.zeros(len(n), bool)
        bad[doc[ends - starts > LONG]] = True
        if bad.any():
            keep = ~bad[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        hashes = self._hashes(codes, starts, ends)
        order = np.argsort(hashes)
        new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(order) else np.zeros(0, bool)
        first = order[new]
        entry, wrong = self._entries(hashes[first], starts[first], ends[first], codes)
        group = np.empty(len(order), np.int32)
        group[order] = np.cumsum(new, dtype=np.int32) - 1
        wrong = wrong[group] | _differ(codes, starts, ends - starts, codes, starts[first][group], (ends - starts)[first][group])
        each = entry[group]
        if wrong.any():
            bad[doc[wrong]] = True
            each = each[~bad[doc]]
        return each, np.where(bad, 0, n), bad

    def _entries(self, each: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memo entries of distinct pre-tokens by their hashes, new ones added; and where another string has the hash."""
        if len(self.keys) > MEMO:
            self.forget()
        i = np.minimum(np.searchsorted(self.keys, each), max(0, len(self.keys) - 1))
        known = self.keys[i] == each if len(self.keys) else np.zeros(len(each), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            text = codes.tobytes().decode("utf-32-le")
            got = []
            for k in range(0, len(new), NEW):
                some = new[k : k + NEW]
                got += [e.ids for e in self.tok.encode_batch_fast([text[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], add_special_tokens=False)]
            sizes, lengths = np.array([len(x) for x in got], np.int64), ends[new] - starts[new]
            keys = np.concatenate([self.keys, each[new]])
            order = np.argsort(keys, kind="stable")
            firsts = np.concatenate([self.firsts, len(self.ids) + np.cumsum(sizes) - sizes])
            begins = np.concatenate([self.begins, len(self.text) + np.cumsum(lengths) - lengths])
            self.ids = np.concatenate([self.ids, np.array([y for x in got for y in x], np.uint32)])
            self.text = np.concatenate([self.text, codes[np.repeat(starts[new] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())].astype(np.uint16)])
            self.keys, self.sizes, self.firsts = keys[order], np.concatenate([self.sizes, sizes])[order], firsts[order]
            self.begins, self.lengths = begins[order], np.concatenate([self.lengths, lengths])[order]
            i = np.searchsorted(self.keys, each)
        return i, _differ(codes, starts, ends - starts, self.text, self.begins[i], self.lengths[i])

    def batches(self, column: pa.Array, want_ids: bool):
        """Yields (row range, token counts, ids or None), about SLICE bytes of text at a time; ids of all rows follow each other."""
        data, offsets = utf8(column)
        for a, b in slices(offsets, SLICE):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            odd = self._odd(part, off)
            if odd.any():
                keep = np.repeat(~odd, np.diff(off))
                lengths = np.where(odd, 0, np.diff(off))
                entry, n, bad = self._plain(part[keep], np.concatenate([[0], np.cumsum(lengths)]))
            else:
                entry, n, bad = self._plain(part, off)
            odd |= bad
            docs = np.repeat(np.arange(b - a), n)
            sizes = self.sizes[entry]
            counts = np.bincount(docs, sizes, b - a).astype(np.int64)
            whole = {int(i): self.tok.encode(part[off[i] : off[i + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids for i in np.flatnonzero(odd)}
            ids = None
            if want_ids:
                begin = np.cumsum(sizes) - sizes
                ids = self.ids[np.repeat(self.firsts[entry] - begin, sizes) + np.arange(sizes.sum())]
                for i, x in sorted(whole.items(), reverse=True):
                    ids = np.insert(ids, counts[:i].sum(), np.array(x, np.uint32))
            for i, x in whole.items():
                counts[i] = len(x)
            yield (a, b), counts, ids

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents with a character that isn't settled or a string of a special token."""
        odd = np.zeros(len(offsets) - 1, bool)
        raw = data.tobytes()
        if len(raw) and (not raw.isascii()):
            codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            bad = np.flatnonzero((codes >= 1 << 16) | (self.kind[np.minimum(codes, 0xFFFF)] == UNSETTLED))
            if len(bad):
                at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
                odd[np.unique(np.searchsorted(at, bad, "right") - 1)] = True
        elif len(raw) and (self.kind[np.unique(data)] == UNSETTLED).any():
            bad = np.flatnonzero(self.kind[data] == UNSETTLED)
            odd[np.unique(np.searchsorted(offsets, bad, "right") - 1)] = True
        for s in self.special:
            p = raw.find(s)
            while p >= 0:
                odd[np.searchsorted(offsets, p, "right") - 1] = True
                p = raw.find(s, p + 1)
        return odd
