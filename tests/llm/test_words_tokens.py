import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from diglot.llm import packing, words
from diglot.llm.registry import public_tokenizer
from diglot.llm.token_files import NO_ID, ShardReader, ShardWriter, read_shards, token_files, write_shards
from diglot.llm.tokens import Encoder

ALPHA = "ab c\n.,!'1 é\t　<|#Z"


def odd_texts(n=400, seed=1):
    r = random.Random(seed)
    some = [None, "", " ", "a  b", "a b ", "\n\na\n b", "x\ty z", "don't 's", "<|endoftext|> a", "é ́a", "a\r\nb", "word*** WORD!! a.", "x" * 3000]
    return some + ["".join(r.choice(ALPHA) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_words_are_those_of_the_regex():
    texts = odd_texts()
    w = words.split(pa.array(texts))
    raw = w.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(w.first, w.last)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [x for t in want for x in t] and w.count.tolist() == [len(t) for t in want]
    by = {}
    for text, h in zip(got, w.hash.tolist()):
        assert by.setdefault(text, h) == h
    assert len(set(by.values())) == len(by)


def test_a_slice_of_a_column_and_windows():
    whole = pa.array(["p q", "a b c d", None, "a b"])
    w = words.split(whole.slice(1))
    assert w.count.tolist() == [4, 0, 2]
    h, row = words.windows(w, 2)
    assert row.tolist() == [0, 0, 0, 2] and h[0] == h[3] and len(set(h.tolist())) == 3
    assert words.windows(words.split(pa.array(["x"])), 5)[1].tolist() == [0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole(name):
    enc = Encoder(public_tokenizer(name), most_cached=200)
    texts = odd_texts(1500, 3)
    want = [x.ids for x in enc._tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == want
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts[::-1])] == want[::-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_that_become_marks_and_words_met_before(name, monkeypatch):
    """Some letters' normal forms end in a mark, which joins the marks after it; known words leave no Python strings."""
    enc, letters = Encoder(public_tokenizer(name), most_cached=300), [chr(c) for c in [*range(0x3400), *range(0xA000, 0xA100), *range(0xF900, 0x10600)] if chr(c).isalpha()]
    texts = [f"{c} {c}. a{c}b, A{c}\n{c}{c}" for c in letters]
    assert enc.encode(texts) == enc._ids(texts)
    again, learnt = Encoder(public_tokenizer(name)), []
    learn = again._learn
    monkeypatch.setattr(again, "_learn", lambda keys: learnt.extend(keys.to_pylist()) or learn(keys))
    first = again.encode(["one two, \x85three. two"])
    assert again.encode(["two. one!! \x85three. two,"]) == again._ids(["two. one!! \x85three. two,"]) and first == again._ids(["one two, \x85three. two"])
    # of the second text, its first word and a word after a space that was the first of its text
    assert len(learnt) - len(set(learnt)) == 0 and len(learnt) <= 5


DOCS = [(5, "five five"), (2, None), (9, "same"), (1, "one two three " * 400), (5, "five again"), (7, ""), (None, "no id")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_made_a_string_once_a_call(name, monkeypatch):
    """Texts of any size, also more words than are gathered at once; only distinct words leave Arrow."""
    enc, seen = Encoder(public_tokenizer(name)), []
    texts = ["one two\nthree two", None, "", "lone " * 200_000 + "end", "two\n" * 150_000 + "end", "last", " a  b\u3000c\x85d "]
    whole = [x.ids for x in enc._tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    lookup = enc._lookup
    monkeypatch.setattr(enc, "_lookup", lambda pieces: seen.extend(pieces) or lookup(pieces))
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(pa.array(texts))] == whole
    assert len(seen) == len(set(seen)) < 30
    assert enc.encode([]) == [] and enc.encode(pa.array([None], pa.string())) == [b""]


def ids_of(name, end):
    enc = Encoder(public_tokenizer(name))
    return lambda t: [*np.frombuffer(enc.encode([t])[0], enc.dtype).tolist(), end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    encode = ids_of("byte_bpe_50k.json", 2)
    got = token_files(docs(spark), public_tokenizer("byte_bpe_50k.json")).orderBy("start").collect()
    rows = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = encode(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_nothing(spark):
    assert token_files(docs(spark, []), public_tokenizer("byte_bpe_50k.json")).count() == 0


def test_readers_open_only_the_frames_they_need(spark, tmp_path):
    w = ShardWriter(f"file://{tmp_path}/s/a.zst", 2, frame_bytes=100)
    want = {}
    for i in range(50):
        want[i] = np.arange(i, 2 * i + 3)
        w.add(i, want[i].astype("<u2").tobytes())
    w.close()
    r = ShardReader(f"file://{tmp_path}/s/a.zst")
    got = r.documents([3, 40, 99])
    assert r.opened <= 2 < len(r.frames) and {k: v[0].tolist() for k, v in got.items()} == {k: want[k].tolist() for k in (3, 40)}
    import zstandard

    raw = (tmp_path / "s/a.zst").read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as z:
        assert z.read() == b"".join(want[i].astype("<u2").tobytes() for i in range(50))
    # the table at the end is that of the public seekable format: sizes and the low half of XXH64
    import struct

    import xxhash

    frames, flags, magic = struct.unpack("<IBI", raw[-9:])
    table = np.frombuffer(raw[-9 - 12 * frames : -9], "<u4").reshape(-1, 3)
    assert (magic, flags, struct.unpack("<II", raw[-17 - 12 * frames : -9 - 12 * frames])) == (0x8F92EAB1, 0x80, (0x184D2A5E, 12 * frames + 9))
    at = 0
    for size, full, check in table.tolist():
        content = zstandard.ZstdDecompressor().decompress(raw[at : at + size])
        assert len(content) == full and xxhash.xxh64_intdigest(content) & 0xFFFFFFFF == check
        at += size
    damaged = bytearray(raw)
    damaged[len(raw) // 4] ^= 255
    (tmp_path / "s/b.zst").write_bytes(damaged)
    with pytest.raises(Exception):
        list(ShardReader(f"file://{tmp_path}/s/b.zst"))
    assert NO_ID < 0 and [p.name for p in (tmp_path / "s").iterdir() if "tmp" in p.name] == []
    shards = write_shards(docs(spark), f"file://{tmp_path}/t", public_tokenizer("byte_bpe_50k.json"))
    assert read_shards(shards).count() == len(DOCS)


def test_packing(spark):
    encode = ids_of("word_bpe_49k.json", 1)
    rows = [(i, t) for i, (_, t) in enumerate(DOCS)] + [(i, f"some text number {i} " * (i % 90)) for i in range(10, 150)]
    got = packing.pack_documents(docs(spark, rows), public_tokenizer("word_bpe_49k.json")).toPandas()
    texts = dict(rows)
    for i, p in got.sort_values("start").groupby("doc_id"):
        ids, at = encode(texts[i]), 0
        for r in p.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert set(got.doc_id) == set(texts)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.sequence_tokens.nunique() == 1
        size = int(s.length.sum())
        assert size == s.sequence_tokens.iloc[0] <= 2048 and (size == 2048 or size & (size - 1) == 0)
    assert packing.pack_documents(docs(spark, []), public_tokenizer("word_bpe_49k.json")).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_alike_documents_are_near_on_the_curve():
    r = np.random.default_rng(0)
    base = [r.integers(0, 40000, 400) for _ in range(40)]
    near = [np.concatenate([b[:380], r.integers(0, 40000, 20)]) for b in base]
    z = packing.coordinates(base + near)
    gap = np.sqrt(((z[:40] - z[40:]) ** 2).sum(1))
    other = np.sqrt(((z[:40] - np.roll(z[40:], 1, 0)) ** 2).sum(1))
    assert np.median(gap) < 0.5 * np.median(other)
