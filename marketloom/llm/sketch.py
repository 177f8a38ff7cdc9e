"""SuperMinHash signatures of many sets at once, their bands and bit sketches."""

from __future__ import annotations

import numpy as np

from marketloom.llm.text_arrays import GOLD, U64, mix


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (one row of ``m`` 32-bit values per set) of non-empty sets of hashes.

    Element e has a random permutation p_e of the m slots; slot p_e[j] is
    offered j + u(e, j), u uniform in [0, 1), and keeps the least offer.  The
    offers are made step by step for the elements of all sets: once every slot
    of a set holds less than j + 1 no later step can lower one, so the set
    leaves early.  Permutations are Fisher-Yates shuffles advanced one swap a
    step, kept only for sets that need more than one step.
    """
    count = len(sets)
    if count == 0:
        return np.empty((0, m), dtype=np.uint32)
    best = np.full(count * m, np.inf)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    perm = None
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mix(element + U64(j + 1) * GOLD)
        place = j + ((draw >> U64(32)) * U64(m - j) >> U64(32)).astype(np.int64)
        offer = j + (draw & U64(0xFFFFFFFF)).astype(np.float64) / 4294967296.0
        rows = np.arange(len(element))
        slot = place if perm is None else perm[rows, place]
        np.minimum.at(best, owner * m + slot, offer)
        live = (best.reshape(count, m).max(axis=1) >= j + 1)[owner]
        left = int(live.sum())
        if left == 0:
            break
        if perm is None:
            element, owner, place = element[live], owner[live], place[live]
            perm = np.tile(np.arange(m, dtype=np.int16), (left, 1))
            perm[np.arange(left), place] = 0
            continue
        perm[rows, place] = perm[rows, j]
        if left < 0.6 * len(element):
            element, owner, perm = element[live], owner[live], perm[live]
    with np.errstate(over="ignore"):
        return mix((best * 4294967296.0).astype(np.uint64)).astype(np.uint32).reshape(count, m)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """For each signature one signed 64-bit key per band; the band's number is part of it."""
    rows = signatures.shape[1] // bands
    part = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(U64)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, bands + 1, dtype=U64), (len(signatures), 1))
        for i in range(rows):
            key = mix(key * U64(5) + part[:, :, i] + GOLD)
    return key.view(np.int64)


def bit_sketch(signatures: np.ndarray, n_words: int) -> np.ndarray:
    """The lowest bit of every signature value, packed into 64-bit words."""
    bits = np.zeros((len(signatures), n_words * 64), dtype=np.uint8)
    use = min(signatures.shape[1], n_words * 64)
    bits[:, :use] = signatures[:, :use] & np.uint32(1)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)
