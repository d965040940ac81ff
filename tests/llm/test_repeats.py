"""op10: what reaches the merge of transforms, and spans held against brute force. No Spark session."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sheetspark.llm import repeats


def group_of(runs: list[bytes], gram: list[int]) -> pa.Table:
    """Runs of differing bytes as a group, a document and a shard each."""
    heads = []
    for i, (text, place) in enumerate(zip(runs, gram)):
        head = np.zeros(1, repeats.HEAD)
        for field, value in (("doc", i), ("content", i + 1), ("length", len(text)), ("gram", place), ("mixed", True)):
            if field in repeats.HEAD.names:
                head[field] = value
        heads.append(head.tobytes())
    n = len(runs)
    return pa.table({**{k: pa.nulls(n, pa.int64()) for k in ("doc", "hash", "start", "end")}, "heads": pa.array(heads, pa.binary()), "bytes": pa.array(runs, pa.binary())})


def merged_places(monkeypatch) -> list[int]:
    sizes, merge = [], repeats.merge
    monkeypatch.setattr(repeats, "merge", lambda *a: sizes.append(len(a[0])) or merge(*a))
    return sizes


def test_runs_that_share_only_their_minimizer_are_not_merged(monkeypatch):
    r = random.Random(3)
    text = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    word, same = text(40), text(110)
    runs = [text(50) + word + text(60) for _ in range(300)] + [text(25) + same + text(9), text(4) + same + text(16)]
    sizes = merged_places(monkeypatch)
    got = repeats._mark(group_of(runs, [54] * 300 + [25 + 60, 4 + 60]))
    assert got.to_pylist() == [{"doc": 301, "hash": 0, "start": 4, "end": 114}]
    assert sum(sizes) <= 2 * (110 + 18)


def test_a_large_group_is_merged_in_parts(monkeypatch):
    r = random.Random(4)
    text = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    shared = [text(120) for _ in range(200)]
    sizes = merged_places(monkeypatch)
    monkeypatch.setattr(repeats, "PART_BYTES", 4096, raising=False)
    got = repeats._mark(group_of([s + b"0" + text(4) for s in shared] + [s + b"1" + text(6) for s in shared], [60] * 400))
    assert got.to_pylist() == [{"doc": 200 + i, "hash": 0, "start": 0, "end": 120} for i in range(200)]
    assert max(sizes) <= 4096 + 2 * 168 and len(sizes) > 8


def test_bitmaps_grow_with_the_names_that_are_repeated():
    def rows(n):
        out = np.zeros(2 * n, repeats.NAME)
        out["name"], out["content"] = np.repeat(np.arange(n) * 7919, 2), np.arange(2 * n) // 2
        return pa.table({"group": pa.array([5], pa.int32()), "names": pa.array([out.tobytes()], pa.binary())})

    for n in (1, 1000, 50_000):
        part = repeats._section(1 << 20)(rows(n))
        assert len(part["twice"][0].as_py()) == 3 * n and len(part["mixed"][0].as_py()) == 3
        on = repeats.Bitmap({5: part["twice"][0].as_py()}, 8)
        assert on.on(np.full(n, 5), (np.arange(n) * 7919).astype(np.uint32)).all()
        assert not on.on(np.full(n, 4), np.arange(n, dtype=np.uint32)).any()
    assert len(repeats._section(1000)(rows(1000))["twice"][0].as_py()) == 1000


def covered(texts: list[bytes], ranges: int = 3) -> list[np.ndarray]:
    """The bytes of each text that op10's steps mark, over two tasks."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.decode() for t in texts])], names=["doc_id", "text"])
    tasks = [batch.slice(0, len(texts) // 2), batch.slice(len(texts) // 2)]
    names = pa.Table.from_batches([b for t in tasks for b in repeats._names(ranges)(iter([t]))])
    parts = {g: repeats._section(1000)(names.filter(pc.equal(names["group"], g))).to_pylist()[0] for g in set(names["group"].to_pylist())}
    shared = SimpleNamespace(value=tuple(repeats.Bitmap({g: p[k] for g, p in parts.items()}, ranges) for k in ("twice", "mixed")))
    columns = ["doc", "hash", "start", "end", "group", "heads", "bytes"]
    runs = pa.Table.from_batches([b.select(columns) for t in tasks for b in repeats._runs(shared, ranges)(iter([t]))])
    gone = [np.zeros(len(t), bool) for t in texts]
    for g in set(runs["group"].to_pylist()):
        for m in repeats._mark(runs.filter(pc.equal(runs["group"], g))).to_pylist():
            gone[m["doc"]][m["start"] : m["end"]] = True
    return gone


def test_spans_of_edited_copies_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 2000)
    monkeypatch.setattr(repeats, "BLOCK", 128)
    for seed in range(12):
        r = random.Random(seed)
        letters = [b"ab", b"abcdefgh", b"abcdefghijklmnopqrstuvwxyz "][seed % 3]
        text = lambda n: bytes(r.choice(letters) for _ in range(n))
        stock = [text(r.choice([99, 100, 101, 109, 110, 119, 120, 150, 169, 300, 700])) for _ in range(8)] + [b"a" * 260, b"ab" * 130]
        texts = []
        for _ in range(30):
            t = bytearray()
            for _ in range(r.randrange(4)):
                t += text(r.choice([0, 1, 3, 9, 10, 11, 40])) + r.choice(stock)
            for _ in range(r.randrange(3)):
                if t:
                    t[r.randrange(len(t))] = r.choice(letters)
            texts.append(bytes(t) + text(r.randrange(30)))
        seen, want = set(), []
        for t in texts:
            gone = np.zeros(len(t), bool)
            for k in range(len(t) - 99):
                if t[k : k + 100] in seen:
                    gone[k : k + 100] = True
                seen.add(t[k : k + 100])
            want.append(gone)
        got = covered(texts)
        assert all(np.array_equal(a, b) for a, b in zip(got, want)), seed
        assert 0 < sum(int(g.sum()) for g in got) < sum(map(len, texts))
