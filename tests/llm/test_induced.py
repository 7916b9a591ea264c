import random

import numpy as np
import pytest

from quillmeter.llm import induced


def text(s):
    return np.array([*s, 0], np.uint8)


def naive(t):
    data = t.tobytes()
    return sorted(range(len(data)), key=lambda i: data[i:])


def prefixes(t, order):
    data, out = t.tobytes(), [0] * len(t)
    for a, b in zip(order, order[1:], strict=False):
        while data[a + out[b]] == data[b + out[b]]:
            out[b] += 1
    return out


SAMPLES = [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"banana", b"mississippi" * 30, b"abracadabra", b"zyxwv", b"ab" * 200, b"\xff\x01\xff\x01\x02" * 9]
SAMPLES += [bytes(random.Random(i).choice(b"abc" if i % 2 else bytes(range(1, 256))) for _ in range(40 * i)) for i in range(1, 30)]


@pytest.mark.parametrize("s", SAMPLES)
@pytest.mark.parametrize("front", [1, 3, 1 << 16])
def test_suffix_array_and_prefixes(s, front, monkeypatch):
    monkeypatch.setattr(induced, "FRONT", front)
    t = text(s)
    order = induced.suffix_array(t.astype(np.int64), 256)
    assert order.tolist() == naive(t)
    before, common = induced.common_prefixes(t, order)
    assert common.tolist() == prefixes(t, order.tolist())
    assert before[order[1:]].tolist() == order[:-1].tolist() and before[order[0]] == -1


def test_long_text_of_repeats():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"etaoin") for _ in range(rng.randrange(2, 9))) for _ in range(50)]
    t = text(b" ".join(rng.choice(words) for _ in range(9000)))
    order = induced.suffix_array(t.astype(np.int64), 256)
    data = t.tobytes()
    assert all(data[a : a + 400] <= data[b : b + 400] for a, b in zip(order, order[1:], strict=False))
    assert np.array_equal(np.sort(order), np.arange(len(t)))
