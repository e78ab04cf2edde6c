"""The decoder on images that it didn't write: AC terms, colour, subsampling, with and without restarts, from an encoder of our own."""

import random

import numpy as np
import pytest

from tessera.llm import media

DC = tuple(range(12))
AC = tuple(sorted([0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]))


class Bits:
    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value, size):
        for k in range(size - 1, -1, -1):
            self.held, self.n = self.held << 1 | value >> k & 1, self.n + 1
            if self.n == 8:
                self.out.append(self.held)
                if self.held == 0xFF:
                    self.out.append(0)
                self.held = self.n = 0

    def end(self):
        while self.n:
            self.put(1, 1)


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def table(kind, symbols, size):
    return bytes([kind]) + bytes(len(symbols) if k == size else 0 for k in range(1, 17)) + bytes(symbols)


def amplitude(bits, value, code):
    """The code of a number's size, then its bits."""
    size = abs(value).bit_length()
    code(size)
    bits.put(value if value > 0 else value + (1 << size) - 1, size)


def encoded(dice, width, height, sampling, restart, wide):
    """A stream, and the luminance thumbnail that it stands for."""
    if len(sampling) == 1:
        sampling = [(1, 1)]
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    step = dice.randrange(1, 300 if wide else 256)
    quant = segment(0xDB, bytes([16]) + b"".join(x.to_bytes(2, "big") for x in [step, *[1] * 63])) if wide else segment(0xDB, b"\x00" + bytes([step, *[1] * 63]))
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    scan = bytes([len(sampling)]) + b"".join(bytes([c + 1, 0x00]) for c in range(len(sampling))) + b"\x00\x3f\x00"
    head = b"\xff\xd8" + segment(0xE0, b"any") + quant + segment(0xFE, b"a comment \xff\xd9") + segment(0xC0, frame) + segment(0xC4, table(0x00, DC, 4)) + segment(0xC4, table(0x10, AC, 8))
    head += (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"") + segment(0xDA, scan)
    data, bits, before = bytearray(), Bits(), [0] * len(sampling)
    blocks = np.zeros((down * sampling[0][1], across * sampling[0][0]))
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            bits.end()
            data += bits.out + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            bits, before = Bits(), [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    dc = dice.randrange(-900, 900) // step
                    amplitude(bits, dc - before[c], lambda size: bits.put(DC.index(size), 4))
                    before[c] = dc
                    if c == 0:
                        blocks[mcu // across * v + y, mcu % across * h + x] = dc
                    terms = [dice.choice([0, 0, 0, 0, 1, -1, dice.randrange(-500, 500)]) if dice.random() < 0.4 else 0 for _ in range(63)]
                    run = 0
                    last = max((k for k, t in enumerate(terms) if t), default=-1)
                    for value in terms[: last + 1]:
                        if not value:
                            run += 1
                            continue
                        while run > 15:
                            bits.put(AC.index(0xF0), 8)
                            run -= 16
                        amplitude(bits, value, lambda size, run=run: bits.put(AC.index(run << 4 | size), 8))
                        run = 0
                    if last < 62:
                        bits.put(AC.index(0x00), 8)
    bits.end()
    thumb = np.clip(np.rint(blocks * step / 8) + 128, 0, 255).astype(np.uint8)
    return head + bytes(data + bits.out) + b"\xff\xd9", thumb[: -(-height // 8), : -(-width // 8)]


SAMPLING = {"grey": [(1, 1)], "4:4:4": [(1, 1)] * 3, "4:2:0": [(2, 2), (1, 1), (1, 1)], "4:2:2": [(2, 1), (1, 1), (1, 1)], "4:1:1": [(4, 1), (1, 1), (1, 1)], "two": [(1, 2), (1, 1)]}


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("kind", SAMPLING)
def test_thumbnails_of_foreign_images(kind, restart):
    dice = random.Random(f"{kind} {restart}")
    for width, height, wide in ((8, 8, False), (17, 33, True), (70, 41, False), (1, 100, True)):
        stream, want = encoded(dice, width, height, SAMPLING[kind], restart, wide)
        got = media.read_thumbnail(stream)
        assert got.shape == want.shape and (got == want).all()
        image, end = media.parse(stream)
        assert (image.width, image.height, image.restart, end) == (width, height, restart, len(stream))


def test_images_of_different_kinds_in_one_stream():
    dice = random.Random(3)
    made = [encoded(dice, 30, 20, SAMPLING[k], r, False) for k in SAMPLING for r in (0, 2)]
    thumbs = media.thumbnails([media.parse(s)[0] for s, _ in made])
    assert all(a.shape == b.shape and (a == b).all() for a, (_, b) in zip(thumbs, made))


@pytest.mark.parametrize("broken", ["progressive", "cut", "twelve bits", "no image", "no scan", "no end"])
def test_what_is_no_baseline_image_raises(broken):
    stream, _ = encoded(random.Random(1), 40, 40, SAMPLING["4:2:0"], 0, False)
    frame, scan = stream.index(b"\xff\xc0"), stream.index(b"\xff\xda")
    bad = {
        "progressive": stream[: frame + 1] + b"\xc2" + stream[frame + 2 :], "cut": stream[: scan + 60] + b"\xff\xd9", "twelve bits": stream[: frame + 4] + b"\x0c" + stream[frame + 5 :],
        "no image": b"GIF89a", "no scan": stream[:scan], "no end": stream[:-2],
    }
    with pytest.raises(ValueError):
        media.read_thumbnail(bad[broken])
