import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from matrixlake.llm import packing, queries, token_files
from matrixlake.llm.tokens import Encoder

ODD = ["", " ", "a  b", "  x \n y", "don't  'S!", "x\x85 y", "é́ ́a", "a\x1c b", "\n\n a", "ΑΣ ΑΣΑ", "a　 b c", "ab " * 3000, "İ xİy İİ", "ǅ ſ K ẞ"]
ODD += ["<|endoftext|> x", "a<|endoftext|>", "a  <|endoftext|>  b", "a \n<|startoftext|>\nb", "<|ENDOFTEXT|>,", "<|endoftext|><|endoftext|> <|endoftext", "x <|startoftext|>y <|endoftext|>."]


def plain(name):
    """The ids of whole texts by the library alone."""
    tokenizer = Tokenizer.from_file(queries.vocabulary(name))
    return lambda texts: [np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", [queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY])
def test_pieces_give_the_ids_of_whole_texts(name):
    e, want = Encoder(queries.vocabulary(name)), plain(name)
    assert e.kind != "whole"
    pieces = st.one_of(st.sampled_from([*"abéİ '\n\t.,!9́\x85　<|>", "<|endoftext|>", "<|startoftext|>", "  ", "word"]), st.characters(exclude_categories=["Cs"]))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(pieces, max_size=20).map("".join), max_size=4))
    def same(texts):
        assert e.encode(texts) == want(texts)

    same()
    assert e.encode(ODD) == want(ODD)
    letters = [f"{c} a{c} {c}b x{c}." for c in map(chr, range(0x80, 0x2000))]
    assert e.encode(letters) == want(letters)


ROWS = [(5, "some words here", "x"), (11, "İ said <|endoftext|> twice <|endoftext|>", "x"), (2, None, "y"), (9, "", None), (2, "again", "z"), (2, "again", "z"), (None, "no id", "q"), (7, "a long text " * 2000, "x")]
SCHEMA = "doc_id bigint, text string, part string"
MORE = {c: "7" for c in ("start", "length", "offset", "ids", "path", "sequence_id")}


def clashing(df):
    return df.selectExpr("*", *[f"'{v}' AS {c}" for c, v in MORE.items()])


def test_token_files_round_trip(spark):
    path = queries.vocabulary(queries.WORD_VOCABULARY)
    docs = clashing(spark.createDataFrame(ROWS, SCHEMA))
    manifest = token_files.write_token_files(docs, path, 2, frame_bytes=64)
    rows = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids_of, at, want = plain(queries.WORD_VOCABULARY), 0, []
    for doc, text, _ in order:
        ids = ids_of([text])[0] + np.uint32(2).tobytes()
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert rows == want
    for file in manifest.collect():
        fs, p = pafs.FileSystem.from_uri(file.path)
        with fs.open_input_file(p) as f:
            r = token_files.Reader(f)
            assert len(r.seek) == len(r.frames)
            assert [d for _, d, _ in r.documents({2})] == [d for d in (None if z else int(x) for x, z in zip(r.ids, r.null, strict=True)) if d == 2]
        with fs.open_input_file(p) as f:
            raw = bytearray(f.read())
        raw[6] ^= 1
        with fs.open_output_stream(p, compression=None) as f:
            f.write(bytes(raw))
        with fs.open_input_file(p) as f, pytest.raises(Exception):  # noqa: B017, PT011
            list(token_files.Reader(f).documents())


def test_token_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert token_files.read_token_files(token_files.write_token_files(docs, queries.vocabulary(queries.WORD_VOCABULARY), 2)).collect() == []


def check_pieces(rows, docs):
    ids_of, ids = plain(queries.BYTE_VOCABULARY), {}
    for doc, text, _ in docs:
        ids.setdefault(doc, []).append(ids_of([text])[0] + np.uint32(0).tobytes())
    for doc, texts in ids.items():
        mine = [r for r in rows if r.doc_id == doc]
        assert sum(r.length for r in mine) == sum(len(t) for t in texts) // 4
        assert all(any(zlib.crc32(t[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and len(t) == 4 * r.doc_tokens for t in texts) for r in mine)
    fills = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert all(f <= 1024 for f in fills.values())
    return sum(1024 - f for f in fills.values() if f & (f - 1)), sum(fills.values())


def test_packing(spark):
    path = queries.vocabulary(queries.BYTE_VOCABULARY)
    rows = packing.pack(clashing(spark.createDataFrame(ROWS, SCHEMA)).coalesce(1), path, 0).collect()
    waste, total = check_pieces(rows, ROWS)
    assert waste < 0.02 * total + packing.LOOSE
    same = [(i, "word " * 600, "x") for i in range(200)]  # lengths that best fit alone can't pair
    rows = packing.pack(spark.createDataFrame(same, SCHEMA).coalesce(1), path, 0, group=50).collect()
    waste, total = check_pieces(rows, same)
    assert waste < 0.02 * total
    assert packing.pack(spark.createDataFrame([], SCHEMA), path, 0).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    pieces = [(i, 0, b"\0\0\0\0" * n, n) for i, n in enumerate(lengths)]
    got = packing.best_fit(pieces)
    want: list[list[int]] = []
    for _, _, b, _ in sorted(pieces, key=lambda p: (-len(p[2]), p[0])):
        n = len(b) // 4
        fits = [w for w in want if 1024 - sum(w) >= n]
        if fits:
            min(fits, key=lambda w: 1024 - sum(w)).append(n)
        else:
            want.append([n])
    assert sorted(packing.fill(w) for w in got) == sorted(map(sum, want))
