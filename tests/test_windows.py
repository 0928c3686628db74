"""Objects in windows: the same types at every window size."""

import io
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilscan import rules
from veilscan.sources import windows as W

PATTERNS = {t: re.compile(p) for t, p in rules.CONTENT_PATTERNS.items()}


def types_of(data: bytes):
    text = data.decode("utf-8", errors="ignore").replace("�", "")
    return {t for t, p in PATTERNS.items() if p.search(text)}


def types_in_windows(data: bytes, length: int):
    found = set()
    for at in range(0, len(data), length):
        part = W.window(io.BytesIO(data), len(data), at, length)
        if part is not None:
            found |= types_of(part)
    return found


PIECES = [
    b"jane.doe@mail.example.org", b"a@b.co", b"123-45-6789", b"9123-45-6789", b"tel(415)\n555-1234", b"(415) 555-1234", b"415.555.1234",
    b"4111 1111 1111 1111", b"4111-1111-1111-1111", b"01/31/1990", b"101/31/1990", b"12-05-2001", "é123-45-6789".encode(),
    "٣٣٣-٤٤-٥٥٥٥".encode(), "漢字123-45-6789".encode(), "漢字".encode(), b"\xe9\xff", b"\xe3\x81", b" ", b"\n", b"/", b",", b"x", b"@", b".", b"-",
    b"(", b"5", b"77", b"word", b"%40", b"_", b"+", b"|", " ".encode(), "　".encode(), "�".encode(), "🙂".encode(), b"a" * 40, b"7" * 40,
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=14), st.sampled_from([1, 2, 3, 5, 8, 13, 29, 64]))
def test_any_window_size_gives_the_same_types(pieces, length):
    data = b"".join(pieces)
    assert types_in_windows(data, length) == types_of(data)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(100, 3000))
def test_types_of_long_objects(seed, length):
    rng = random.Random(seed)
    data = b"".join(rng.choice(PIECES[13:]) if rng.random() < 0.98 else rng.choice(PIECES[:13]) for _ in range(3000))
    assert types_in_windows(data, length) == types_of(data)


def test_every_byte_is_in_a_window():
    data = b" ".join(b"%d" % i for i in range(5000))
    parts = [W.window(io.BytesIO(data), len(data), at, 100) for at in range(0, len(data), 100)]
    assert all(len(p) < 100 + 2 * W.OVERLAP for p in parts if p)
    for i in range(5000):
        assert any(re.search(rb"(^| )%d( |$)" % i, p) for p in parts if p)


class Endless:
    """A file of one repeated byte with something at its end, which holds nothing in memory."""

    def __init__(self, byte: bytes, n: int, tail: bytes) -> None:
        self.byte, self.n, self.tail, self.place, self.most = byte, n, tail, 0, 0

    def seek(self, place):
        self.place = place

    def read(self, k):
        self.most = max(self.most, k)
        body = self.byte * max(0, min(k, self.n - self.place))
        rest = self.tail[max(0, self.place - self.n) :][: k - len(body)] if self.place + k > self.n else b""
        self.place += len(body) + len(rest)
        return body + rest


@pytest.mark.parametrize("byte,tail,types", [
    (b"x", b"@mail.org", {"EMAIL"}), (b"7", b" 123-45-6789", {"SSN"}), (b"x", b"123-45-6789", set()), (b"7", b"-45-6789", set()),
])
def test_long_objects_without_any_cut(byte, tail, types):
    n, length = 96 << 20, 4 << 20
    size, found, largest = n + len(tail), set(), 0
    for at in (0, length, n - length, n):  # the first, two inside, and the last range
        part = W.window(Endless(byte, n, tail), size, at, length)
        if part is not None:
            largest = max(largest, len(part))
            found |= types_of(part)
    assert found == types and largest < 8 << 20


def test_a_gigabyte_is_cut_into_ranges():
    n, length = 1 << 30, 16 << 20
    part = W.window(Endless(b" ", n, b"a@b.org"), n + 7, n - length, length)
    assert len(part) <= length + 7


def test_objects_of_any_size(spark, scratch):
    from veilscan.plans.scan import scan_objects_under

    root = os.path.join(scratch, "objects")
    os.makedirs(os.path.join(root, "a b", "_hidden"))
    rng = random.Random(4)
    held = {
        "empty.txt": b"",
        "a b/phone#1.txt": b"line\n" * 5000 + b"tel(415)\n555-1234" + b"\nline" * 5000,
        "a b/long.bin": b"z" * 300000 + b"@host.org" + b"z" * 300000,
        "ü%20.txt": b"".join(rng.choice(PIECES[13:]) for _ in range(20000)) + b" 123-45-6789 ",
        "clean.txt": b"nothing here " * 40000,
    }
    for name, data in {**held, "a b/_hidden/x.txt": b"a@b.org", ".hidden": b"a@b.org"}.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    os.symlink(os.path.join(root, "gone"), os.path.join(root, "broken.txt"))
    for length in (W.WINDOW_BYTES, 50000, 1777):
        found = {r["path"].replace(f"file:{root}/", ""): r for r in scan_objects_under(spark, root, window_bytes=length).collect()}
        broken = found.pop("broken.txt", None)
        assert broken is None or broken["status"] == "unreadable"
        assert {n: set(r["pii_types"]) for n, r in found.items()} == {n: types_of(d) for n, d in held.items()}
        assert {n: r["status"] for n, r in found.items()} == {n: "empty" if n == "empty.txt" else "scanned" for n in held}
        assert {n: r["size_bytes"] for n, r in found.items()} == {n: len(d) for n, d in held.items()}
