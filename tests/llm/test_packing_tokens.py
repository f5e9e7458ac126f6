import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing, token_counts
from scriptorium.llm.queries import tokenizer_path
from scriptorium.llm.tokenizing import encode_ids, tokenizer

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def test_pieces_cover_every_document_once(edge, edge_rows):
    tok = tokenizer(BYTES)
    want = Counter()
    for d, t, *_ in edge_rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += Counter((d, i, len(ids[i : i + 256]), zlib.crc32(np.array(ids[i : i + 256], "<u4").tobytes()), len(ids)) for i in range(0, len(ids), 256))
    rows = packing.pack(edge, BYTES, capacity=256, group_rows=7).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


def test_packing_of_nothing(empty):
    assert packing.pack(empty, BYTES).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tournament_finds_the_first_bin(sizes):
    bins, offsets, used = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
    room: list[int] = []
    for i in np.argsort(-np.array(sizes, np.int64), kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(50)
        assert (bins[i], offsets[i]) == (k, 50 - room[k])
        room[k] -= sizes[i]
    assert used == len(room)


def test_ids_are_the_librarys(edge_rows):
    texts = [t or "" for _, t, *_ in edge_rows]
    tok = tokenizer(BYTES)
    assert encode_ids(texts, BYTES) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts(edge, edge_rows):
    tok = tokenizer(WORDS)
    want = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048) for d, t, *_ in edge_rows)
    for chunk in (1 << 15, 700):
        got = token_counts.count_tokens(edge, WORDS, chunk_chars=chunk, overlap_chars=64).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab C'é́\n  中<|endoftext|>1!"), max_size=400), st.integers(8, 60), st.integers(2, 20))
def test_splices_agree_with_whole_texts(text, chunk, overlap):
    for path in (WORDS, BYTES, tokenizer_path("piece_bpe_32k.model")):
        tok = tokenizer(path)
        whole = len(tok.encode(text)) if path.endswith(".model") else len(tok.encode(text, add_special_tokens=False))
        assert token_counts.count_long(text, path, chunk, overlap) == whole


def test_token_counts_of_nothing(empty):
    assert token_counts.count_tokens(empty, WORDS).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abC'é́ \n\t\r\x0b\x1c\x85\xa0\u2003\u3000中ﬁ½<|endoftext|>1!sreSRE"), max_size=60), max_size=6))
def test_counts_by_words_are_those_of_whole_texts(texts):
    assert token_counts.words_stand_alone(WORDS) and not token_counts.words_stand_alone(BYTES)
    tok = tokenizer(WORDS)
    assert token_counts._counter(WORDS)(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_an_endless_word_is_encoded_a_few_times_only(monkeypatch):
    seen = []
    real = token_counts.encode_spans
    monkeypatch.setattr(token_counts, "encode_spans", lambda texts, path: seen.append(len(texts[0])) or real(texts, path))
    tok = tokenizer(WORDS)
    for text in ("ab" * 150_000, "word " * 2000 + "xy" * 100_000 + " tail" * 3000, "a " * 40 + "q" * 70_000 + "\n" + "b c " * 30_000):
        seen.clear()
        assert token_counts.count_long(text, WORDS, 4096, 64) == len(tok.encode(text, add_special_tokens=False).ids)
        assert sum(seen) < 6 * len(text)


def test_a_foreign_pattern_beside_ranks_is_left_to_its_library(tmp_path):
    import json
    import shutil

    found = json.load(open(BYTES, encoding="utf-8"))
    found["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "\\s+"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    path = tmp_path / "byte_bpe_50k.json"
    path.write_text(json.dumps(found), encoding="utf-8")
    shutil.copy(BYTES[:-5] + ".tiktoken", tmp_path / "byte_bpe_50k.tiktoken")
    texts = ["don't stop1234 it's", "plain words here"]
    tok = tokenizer(str(path))
    assert encode_ids(texts, str(path)) == [tok.encode(t, add_special_tokens=False).ids for t in texts] != encode_ids(texts, BYTES)
    found["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[^ ]+"
    path.write_text(json.dumps(found), encoding="utf-8")
    assert token_counts.words_stand_alone(WORDS) and not token_counts.words_stand_alone(str(path))
