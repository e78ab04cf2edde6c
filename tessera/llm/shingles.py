"""Word-shingle sets and SuperMinHash signatures of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Words in a shingle; places of a signature; bands and values in a band.
WORDS = 5
PLACES = 128
BANDS, IN_BAND = 32, 4

U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_GOLDEN) + U(seed)) | U(1)


#: Two families of hashes that share nothing: one to find candidates, one to confirm them.
_BYTES = _odd(256, 11), _odd(256, 5003)
_PLACES = _odd(WORDS, 23), _odd(WORDS, 6007)
_PLACE = _PLACES[0]
_STEPS = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F  # odd


def _powers(n: int, family: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEPS[family], dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(texts: list[bytes], family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lower-cased texts, and where each text's begin (one more than texts).

    A text of fewer words than a shingle has, but at least one, is one shingle as a whole.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.array([len(t) for t in texts], np.int64).cumsum() + np.arange(len(texts))
    space = _SPACE[raw]
    letter = np.flatnonzero(~space)
    if not len(letter):
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    first = np.concatenate([[True], letter[1:] != letter[:-1] + 1])
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(letter)))
    inside = np.arange(len(letter)) - np.repeat(start, length)
    places = _PLACES[family]
    word = mix(np.add.reduceat(_BYTES[family][raw[letter]] * _powers(int(length.max()), family)[inside], start) + length.astype(U))
    counts = np.diff(np.searchsorted(letter[start], ends), prepend=0)
    begin = np.concatenate([[0], counts.cumsum()])
    padded = np.concatenate([word, np.zeros(WORDS, U)])
    full = sum((padded[k : len(word) + k] * places[k] for k in range(WORDS)), np.zeros(len(word), U))
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    at = np.repeat(begin[:-1] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
    out = full[at]
    bounds = np.concatenate([[0], n.cumsum()])
    for k in np.flatnonzero((counts > 0) & (counts < WORDS)):
        some = word[begin[k] : begin[k] + counts[k]]
        out[bounds[k]] = np.append(some * places[: len(some)], U(_GOLDEN * int(counts[k]) & _MASK)).sum(dtype=U)
    return mix(out), bounds


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def superminhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures, (texts, PLACES) of uint64; texts without shingles get the largest number throughout.

    Each element ranks the places by a random permutation of its own; the element of rank j and fraction r offers j + r
    to its place, and a place keeps the least offer. All elements make their offers rank by rank, and a text is done as
    soon as all its places hold offers of ranks made, since later ones are larger. The integer rank is kept in the high
    bits and the fraction in the 52 low ones.
    """
    texts = len(bounds) - 1
    sig = np.full((texts, PLACES), _MASK, U)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(texts), counts)
    draws: list[np.ndarray] = []
    x, perm = hashes, None
    for rank in range(PLACES):
        if not len(x):
            break
        offer = (mix(x + U(_GOLDEN * (2 * rank + 1) & _MASK)) >> U(12)) | U(rank << 52)
        pick = (rank + ((mix(x + U(_GOLDEN * (2 * rank + 2) & _MASK)) >> U(32)) * U(PLACES - rank) >> U(32)).astype(np.int64)).astype(np.int16)
        # The pick-th place of what is left of the permutation (Fisher-Yates): in closed form for the first two ranks.
        if rank == 0:
            place = pick
        elif rank == 1:
            place = np.where(pick == draws[0], 0, pick)
        else:
            rows = np.arange(len(x))
            if perm is None:
                perm = np.tile(np.arange(PLACES, dtype=np.int16), (len(x), 1))
                for k, drawn in enumerate(draws):
                    perm[rows, drawn], perm[:, k] = perm[:, k].copy(), perm[rows, drawn]
            place = perm[rows, pick]
            perm[rows, pick] = perm[:, rank]
            perm[:, rank] = place
        if rank < 2:
            draws.append(pick)
        np.minimum.at(sig.reshape(-1), owner * PLACES + place, offer)
        open_ = (sig.max(1) >= U((rank + 1) << 52))[owner]
        x, owner = x[open_], owner[open_]
        draws = [d[open_] for d in draws]
        if perm is not None:
            perm = perm[open_]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) of int64: each band's values and number in one hash."""
    parts = mix(sig.reshape(len(sig), BANDS, IN_BAND) * _PLACE[:IN_BAND]).sum(2, dtype=U)
    return mix(parts + np.arange(1, BANDS + 1, dtype=U) * U(_GOLDEN)).view(np.int64)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], at_once: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of 0/1 matrices over what both sides hold."""
    out = np.zeros((len(a), len(b)), np.float32)
    all_a, all_b = np.concatenate([*a, np.zeros(0, U)]), np.concatenate([*b, np.zeros(0, U)])
    both = np.intersect1d(all_a, all_b)
    if not len(both):
        return out.astype(np.int64)

    def entries(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns, ascending, and rows of a side's ones."""
        column = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        ok = both[column] == flat
        column, row = column[ok], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[ok]
        order = column.argsort(kind="stable")
        return column[order], row[order]

    sides = [entries(a, all_a), entries(b, all_b)]
    for first in range(0, len(both), at_once):
        width = min(at_once, len(both) - first)
        dense = []
        for (column, row), n in zip(sides, (len(a), len(b))):
            x, y = np.searchsorted(column, [first, first + width])
            m = np.zeros((n, width), np.float32)
            m[row[x:y], column[x:y] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether 100 * intersection >= 75 * union, for each set of a with each of b; empty sets are linked with nothing."""
    inter = overlaps(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - inter
    return (100 * inter >= 75 * union) & (inter > 0)
