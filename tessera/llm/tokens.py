"""Token ids of whole texts under the public word-level BPE vocabulary, fast enough for a corpus.

The vocabulary file is read with the `tokenizers` library, whose `encode` defines the ids. White space always separates
tokens in it, so a text's ids are its words' ids in a row. Words are cached; new words are merged many at a time in
numpy. Texts with anything unusual (letters beyond Latin, control characters, the special tokens' strings) and very
long words go to the library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Words kept by a Python worker.
CACHE_WORDS = 600_000
#: Longest pre-token, in bytes, that is merged in numpy.
LONGEST = 48
NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        end = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        #: The library's own split of a lower-cased word; white space never occurs inside one here.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether the library must encode the text: letters beyond Latin, control characters or its special strings."""
        if "<|" in text and ("<|startoftext|>" in text or "<|endoftext|>" in text):
            return True
        code = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        if not len(code):
            return False
        if code.max() > 0x24F:
            return True
        low = code[code < 0x20]
        return bool(((low < 9) | (low > 13)).any())

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 17 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge(self, tokens) -> list[bytes]:
        """Ids (little-endian uint32) of pre-tokens of one length each: lowest rank first, all pre-tokens in step."""
        n = len(tokens[0])
        raw = np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, n)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        length = np.full(len(tokens), n)
        if n > 1:
            rank = np.full((len(tokens), n), NONE)
            rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(tokens))
            columns = np.arange(n)
            while len(live):
                at = rank[live].argmin(1)
                best = rank[live, at]
                going = best < NONE
                live, at, best = live[going], at[going], best[going]
                if not len(live):
                    break
                ids[live, at] = self.made[best]
                shift = np.minimum(columns + (columns > at[:, None]), n - 1)
                ids[live] = np.take_along_axis(ids[live], shift, 1)
                rank[live] = np.take_along_axis(rank[live], shift, 1)
                length[live] -= 1
                size = length[live]
                rank[live, size - 1] = NONE
                right = at + 1 < size
                rows, cols = live[right], at[right]
                rank[rows, cols] = self._rank(ids[rows, cols], ids[rows, cols + 1])
                left = at > 0
                rows, cols = live[left], at[left] - 1
                rank[rows, cols] = self._rank(ids[rows, cols], ids[rows, cols + 1])
        flat = ids.astype("<u4").tobytes()
        return [flat[k : k + 4 * size] for k, size in zip(range(0, len(flat), 4 * n), length.tolist())]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        whole = [w for w in words if w.isalpha()]
        parts = {w: self.split(w) for w in words if not w.isalpha()}
        tokens = set(whole)
        tokens.update(t for some in parts.values() for t in some)
        groups: dict[int, list[tuple[str, bytes]]] = {}
        ids: dict[str, bytes] = {}
        for t in tokens:
            raw = t.encode()
            if len(raw) > LONGEST:
                ids[t] = np.array(self.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                groups.setdefault(len(raw), []).append((t, raw))
        for group in groups.values():
            for k in range(0, len(group), 20_000):
                names, raws = zip(*group[k : k + 20_000])
                ids.update(zip(names, self._merge(raws)))
        out = {w: ids[w] for w in whole}
        out.update((w, b"".join([ids[t] for t in some])) for w, some in parts.items())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32, without special tokens."""
        out: list = [None] * len(texts)
        split = []
        for k, text in enumerate(texts):
            if self._odd(text):
                out[k] = np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                split.append((k, text.lower().split()))
        cache = self.cache
        missing = {w for _, words in split for w in words if w not in cache}
        if missing:
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
                missing = {w for _, words in split for w in words}
            cache.update(self._learn(list(missing)))
        get = cache.__getitem__
        for k, words in split:
            out[k] = b"".join(map(get, words))
        return out


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def forget() -> None:
    """Gives up the words that this Python worker has kept; workers outlive the tasks and stages that they run."""
    load.cache_clear()
