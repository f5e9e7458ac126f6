"""Adapters that give token ids and character offsets of public tokenizer files.

The path of the file is a parameter; workers load it once per process.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

#: The word pattern of the byte-level vocabulary (fixed value, as published with it).
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which all Unicode tables agree; texts with others go the slower way.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ȳ‐-‧‰-⁞€]")


def _characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_CHARACTER = _characters()


@lru_cache(maxsize=8)
def tokenizer(path: str):
    """A tokenizers.Tokenizer for .json, a SentencePieceProcessor for .model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=8)
def _ranks_beside(path: str) -> str | None:
    """The ranks beside a .json file whose steps are those of the byte-level vocabulary, and no others."""
    ranks = path[: -len(".json")] + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks):
        return None
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps, model = found.get("pre_tokenizer") or {}, found.get("model") or {}
    plain = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and found.get("normalizer") is None
    whole = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    fixed = not any(t.get(k) for t in found.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and whole and fixed):
        return None
    vocabulary = {"".join(map(_CHARACTER.__getitem__, t)): i for t, i in _ranked(ranks)._mergeable_ranks.items()}
    return ranks if all(model["vocab"].get(t) == i for t, i in vocabulary.items()) else None


@lru_cache(maxsize=4)
def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_ids(texts: list[str], path: str) -> list[list[int]]:
    """Ids without added special tokens, as the file's own library gives them.

    A byte-level .json file with the same vocabulary as ranks beside it (`_ranks_beside`
    compares the two) is encoded from the ranks, several times faster: the merges, the word pattern
    and so the ids are the same. Its special strings are cut out first, as the
    library does; texts with characters that the two libraries' Unicode
    tables could class differently use the library itself.
    """
    tok = tokenizer(path)
    if path.endswith(".model"):
        return tok.encode(texts, num_threads=1)
    ranks = _ranks_beside(path)
    if ranks is None:
        return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    fast = _ranked(ranks)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    out: list[list[int]] = []
    for text in texts:
        if _PLAIN.search(text):
            out.append(tok.encode(text, add_special_tokens=False).ids)
        elif cut and cut.search(text):
            ids: list[int] = []
            for part in cut.split(text):
                ids += [special[part]] if part in special else fast.encode_ordinary(part)
            out.append(ids)
        else:
            out.append(fast.encode_ordinary(text))
    return out


def encode_spans(texts: list[str], path: str) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """Ids with the character span of each."""
    tok = tokenizer(path)
    if path.endswith(".model"):
        out = []
        for text in texts:
            pieces = tok.encode(text, return_type="proto").pieces
            at = list(range(len(text) + 1))
            if not text.isascii():  # offsets are of bytes; a byte inside a character counts as its start
                at = [k for k, c in enumerate(text) for _ in c.encode()] + [len(text)]
            out.append(([p.id for p in pieces], [(at[p.begin], at[p.end]) for p in pieces]))
        return out
    return [(e.ids, e.offsets) for e in tok.encode_batch(texts, add_special_tokens=False)]
