"""Byte BPE ids and files of zstandard frames: round trips, and what a reader decompresses."""

import io
import json
import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from helixframe.llm import bytebpe, frames, queries
from tests.llm.test_operators import LONG, ROWS, SCHEMA, prose

ODD = [
    "don't we'll 'tis 'S it''s x's! ('s) '1 5's rock'n'roll", " lead", "trail ", "  a   b \n\n c\n\td\t e \r\n", "\n\n\nx\n \ny \n", "a,b.c;d e,, f...g 12ab34 1,000.5% a1-b2", "“quoted”, «é», naïve—dash… ½ × ÷ ª²", "日本語 テキスト,です。", "a\xa0b   c d",
    "x<|endoftext|>y z", "\x1c\x1d a", "é ñandú Ñ ß ſ Ż ż ǆ ά", "😀😀 👨‍👩‍👧", "", " ", "\n", "   ", "a\x00b \x7f", "_under__score_ #tag @x $5 ^~`", LONG,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_is_the_tokenizer(tokenizer):
    r = np.random.default_rng(8)
    alphabet = list("ab'sS ,.1\n\té×“  <|") + ["'ll", "<|endoftext|>", "  "]
    texts = [*ODD, *("".join(r.choice(alphabet, r.integers(0, 25))) for _ in range(2000))]
    encode = bytebpe.ByteEncoder(most=50)
    for some in (texts, texts[:7], [None, *texts[5:]]):
        found = encode.ids(pa.array(some, pa.string()))
        for t, a, n in zip(some, found.start, found.count):
            assert found.ids[a : a + n].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(frames, "FRAME_IDS", 100)
    r = np.random.default_rng(1)
    docs = [(i if i > 2 else None, r.integers(0, 50257, int(r.choice([0, 1, 30, 99, 100, 101, 950])))) for i in range(40)]
    out = io.BytesIO()
    w = frames.FrameWriter(out)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    data = out.getvalue()
    whole = np.concatenate([ids for _, ids in docs]).astype("<u4").tobytes()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == whole
    f = frames.FrameReader(io.BytesIO(data), len(data))
    assert f.doc_ids[~f.null].tolist() == [d for d, _ in docs if d is not None] and f.null.sum() == 3
    for at in r.permutation(len(docs)):
        assert f.document(at) == docs[at][1].astype("<u4").tobytes()
    alone = frames.FrameReader(io.BytesIO(data), len(data))
    small = next(i for i, (_, ids) in enumerate(docs) if len(ids) == 30)
    alone.document(small)
    assert alone.decompressed <= 2 < len(alone.packed)
    broken = bytearray(data)
    broken[int(f.places[3]) + 20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frames.FrameReader(io.BytesIO(bytes(broken)), len(broken)).frame(3)
    # a wrong sum in the seek table is seen as well
    broken, at = bytearray(data), len(data) - 9 - 12 * len(f.packed) + 8
    broken[at] ^= 1
    with pytest.raises(ValueError, match="frame 0"):
        frames.FrameReader(io.BytesIO(bytes(broken)), len(broken)).frame(0)
    with pytest.raises(ValueError, match="seek table"):
        frames.FrameReader(io.BytesIO(data[:-1]), len(data) - 1)
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1


def plain_rows(rows, tokenizer):
    """start, n_tokens and crc32 of each row, in ascending doc_id order (null first)."""
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_folder(spark, tmp_path, tokenizer, monkeypatch):
    rows = [(i * 5, t) for i, t in enumerate([*ODD, *(r[1] for r in ROWS)])]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "c", "c", 1, "c") for d, t in rows], SCHEMA).repartition(3)
    folder = str(tmp_path / "a")
    frames.write_ids(df, folder)
    found = frames.read_ids(spark, folder)
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in found.collect()]
    assert sorted(got) == plain_rows(rows, tokenizer)
    few = frames.documents_of(spark, folder, [5, 50, 999])
    assert sorted(r["doc_id"] for r in few.collect()) == [5, 50]
    assert {r["doc_id"]: r["ids"] for r in few.collect()}.items() <= {r["doc_id"]: r["ids"] for r in found.collect()}.items()
    listed = json.load(open(f"{folder}/manifest.json"))["files"]
    assert sum(x["documents"] for x in listed) == len(rows) and sorted(os.listdir(folder)) == sorted(["manifest.json", *(x["name"] for x in listed)])


def test_repeated_and_missing_ids(spark, tmp_path, tokenizer):
    rows = [(None if i % 3 == 0 else i // 4, t) for i, t in enumerate([prose(20), None, "", "x"] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = str(tmp_path / "b")
    frames.write_ids(df, folder)
    got = frames.read_ids(spark, folder).orderBy("start").collect()
    want = plain_rows(rows, tokenizer)
    assert [r["doc_id"] for r in got] == [x[0] for x in want]
    assert sorted((r["doc_id"] or -1, zlib.crc32(r["ids"])) for r in got) == sorted((x[0] or -1, x[3]) for x in want)
    ends = [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()]
    assert [r["start"] for r in got] == ends[:-1]
    empty = str(tmp_path / "c")
    frames.write_ids(df.limit(0), empty)
    assert frames.read_ids(spark, empty).count() == 0


def test_a_failed_write_leaves_no_manifest(spark, tmp_path):
    folder = str(tmp_path / "d")
    frames.register(spark)
    df = spark.createDataFrame([(2, b""), (1, b"")], "doc_id long, ids binary").coalesce(1)
    with pytest.raises(Exception, match="ascending doc_id order"):
        df.write.format("token_frames").mode("append").save(folder)
    assert not os.path.exists(f"{folder}/manifest.json")


def test_query(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op11_token_files(spark, folder).collect()) == plain_rows(rows, tokenizer)
