"""Token counts, packing and token files against the library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from knotwork.llm import packing, token_counts, token_files
from knotwork.llm.common import new_path
from knotwork.llm.encoding import Encoder

from .helpers import prose, rows, table, texts

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
NASTY = ["", " ", "\n", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "x\t y", "  z", "a\0b", "'s't", "it's,,, 'S", "ΑΣ. Σ", "<|endoftext|>", "a<|endoftext|>.", "<|STARTOFTEXT|>, b", "é. É,", "ǅ. ǅ", "3.5, 4!", "...", "..., a", "İ. İ", "ß. ß", "́ a", "a ́."]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    library = Tokenizer.from_file(path)
    for kept in (1000, 3):  # a table that holds all, and one that is full at once
        for t, ids in zip(NASTY * 2, Encoder(path, kept).encode(NASTY * 2)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_counts(spark):
    library = Tokenizer.from_file(BYTE)
    docs = [*texts(), *((100 + i, t) for i, t in enumerate(NASTY))]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in docs]
    assert rows(token_counts.token_counts(table(spark, docs), BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(table(spark, []), BYTE).collect() == []
    assert rows(token_counts.token_counts(table(spark, [(1, None)]), BYTE), "doc_id", "n_tokens") == [(1, 0)]


def test_packing(spark):
    library, want = Tokenizer.from_file(WORD), []
    for i, t in texts():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    got = packing.packed_documents(table(spark, texts()), WORD)
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    by: dict = {}
    for s, o, n in rows(got, "sequence_id", "offset", "length"):
        by.setdefault(s, []).append((o, n))
    for placed in by.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(w[3] for w in want)
    assert len(by) <= -(-total // 4096) + 1
    assert packing.packed_documents(table(spark, []), WORD).collect() == []


def test_genetic_search_keeps_items_and_never_loses_to_best_fit():
    rng = np.random.default_rng(0)
    for seed in range(5):
        lengths = rng.integers(900, 2300, 150)
        plain = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 4096)
        bins = packing.evolve(lengths, 4096, seed, [])
        again = packing.evolve(lengths, 4096, seed + 1, [bins, packing.evolve(lengths, 4096, seed + 2, [])])
        for b in (bins, again):
            assert np.bincount(b, weights=lengths).max() <= 4096
            assert b.max() + 1 <= len(plain.items)


def test_token_files_round_trip(spark):
    library, want, start = Tokenizer.from_file(BYTE), [], 0
    docs = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    manifest = token_files.write_token_files(table(spark, texts()), BYTE, new_path(spark, "files"), length=64)
    got = token_files.read_token_files(spark, manifest)
    assert rows(got, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    for r in sorted(got.collect(), key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    for f in manifest.collect():
        s = token_files.sequences(f["file"].removeprefix("file:").replace("//", "/", 1))
        assert {len(x) for x in s.column("ids").to_pylist()} == {64}
        assert sum(map(sum, s.column("mask").to_pylist())) == f["n_tokens"]
    assert token_files.written_and_read(table(spark, []), BYTE).collect() == []


def test_a_sequence_is_read_by_its_offset(spark):
    docs = table(spark, [(i, prose(i, 2000)) for i in range(60)])
    to = new_path(spark, "sequences")
    files = token_files.write_token_files(docs, BYTE, to, 2, 16).collect()
    for f in files:
        whole = token_files.sequences(f["file"].removeprefix("file://"))
        assert len(whole) > token_files.ROWS
        for k in (0, 1, token_files.ROWS - 1, token_files.ROWS, len(whole) - 1):
            ids, mask = token_files.sequence(f["file"], k)
            assert ids.tolist() == whole.column("ids")[k].as_py() and mask.tolist() == whole.column("mask")[k].as_py()
