import os
import random
import zlib

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from assayer.llm.packing import Ids, _tokenizer, hilbert, pack, split  # noqa: E402
from assayer.llm.tokens import Splitter, count_tokens  # noqa: E402


def encode(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_tokenizer(docs, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, block_bytes=3000).collect())
    sizes = [(r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(encode("byte_bpe_50k.json", r[1]))) for r in rows]
    assert got == sorted((*s, s[2] > 1024) for s in sizes)


def test_no_rows(nothing):
    assert count_tokens(nothing).count() == 0
    assert pack(nothing).count() == 0


def test_pre_tokens_join_to_the_text():
    rng = random.Random(1)
    signs = ["a", "B", "é", "1", " ", "  ", "\n", "\t", "'s", "'", "!", "<|endoftext|>", "文", "　", "\x1c", "ll"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        book = {}
        places, times = Splitter()(text.encode(), book)
        found = list(book)
        total = sum(len(tokenizer.encode(found[p].decode(), add_special_tokens=False).ids) * t for p, t in zip(places, times, strict=True))
        assert total == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("size", [64, 2048])
def test_every_id_is_packed_once(docs, rows, size):
    found = pack(docs, size=size, partitions=3).collect()
    want = sorted((r[0] if r[0] is not None else -1, *encode("word_bpe_49k.json", r[1]), 1) for r in rows)
    texts = {}
    for p in found:
        ids = np.frombuffer(p.ids, np.uint16).astype("<u4")
        assert len(ids) == p.length and zlib.crc32(ids.tobytes()) == p.ids_crc32
        texts.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids.tolist()))
    total = sum(len(w) - 1 for w in want)
    assert sum(p.length for p in found) == total
    single = {(d, n): [x for _, part in sorted(parts) for x in part] for (d, n), parts in texts.items() if sum(len(x) for _, x in parts) == n}
    for (doc, _), ids in single.items():
        assert (doc if doc is not None else -1, *ids) in want
    sequences = {}
    for p in found:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= size


def test_the_curve_visits_all_and_steps_to_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        keys = hilbert(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_words_split_as_the_tokenizer_does():
    book = Ids(_tokenizer(None))
    assert book.split is split
    cases = [
        "a.. b", "Ä.Öß! ÇA, va?", "it's. 'S. x.'s IT'S, don't.", "é.", "İstanbul. ΣΑΣ.", "a1. 1. a_. (a). a).", "..., .a",
        "Á. é,", "ſ. K. x̀.", "<|endoftext|>. <|ENDOFTEXT|>, a<|startoftext|>.", " a. b.  c.\x85d.",
        "ŉ. ǅ, Ǆ. ẞ!", "a.̸ b!̸", "", "A|B. c|, |", "日本。 語, ok",
    ]
    for text in cases:
        words = book.split(text)
        book.learn([words])
        assert list(np.frombuffer(b"".join(book.known[w] for w in words), np.uint16)) == book.tokenizer.encode(text, add_special_tokens=False).ids, text
