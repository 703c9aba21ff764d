"""Arrow helpers: blocks, regrouped batches, word codes, and the store of known strings."""

import numpy as np
import pyarrow as pa

from custval.llm import common as C


def batch(texts):
    return pa.record_batch([pa.array(list(range(len(texts))), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_blocks_and_larger_keep_every_row_in_order():
    batches = [batch(["a" * n for n in sizes]) for sizes in ([1, 5, 0], [], [30], [2, 2, 2, 2], [0])]
    for limit in (1, 4, 10, 1000):
        cut = list(C.blocks(iter(batches), limit=limit))
        assert [t for b in cut for t in b.column("text").to_pylist()] == [t for b in batches for t in b.column("text").to_pylist()]
        assert all(b.num_rows == 1 or C.byte_lengths(b.column("text")).sum() <= limit for b in cut)
        put = list(C.larger(iter(batches), limit=limit))
        assert [t for b in put for t in b.column("text").to_pylist()] == [t for b in batches for t in b.column("text").to_pylist()]
        assert all(C.byte_lengths(b.column("text")).sum() >= limit for b in put[:-1])


def test_word_codes():
    codes, offsets, words = C.word_codes(pa.array([" a b\x1cc d a", None, "", "\x0b\x0c", "b\x1cc d"]))
    names = words.to_pylist()
    assert [[names[c] for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == [
        ["a", "b\x1cc d", "a"], [], [], [], ["b\x1cc d"],
    ]
    assert C.word_codes(pa.array([], pa.string()))[0].tolist() == []


def test_known_strings_are_learned_once():
    seen = []

    def learn(new):
        seen.extend(new.to_pylist())
        return np.array([len(s) for s in new.to_pylist() for _ in range(len(s))], np.uint32), np.array([len(s) for s in new.to_pylist()])

    known = C.Known(most=5)
    for strings in (["ab", "", "c"], ["c", "ddd"], ["ab", "ddd", ""]):
        flat, at = known.of(known.numbers(pa.array(strings), learn))
        assert [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [[len(s)] * len(s) for s in strings]
    assert seen == ["ab", "", "c", "ddd"]
    known.numbers(pa.array(["x", "y"]), learn)
    known.numbers(pa.array(["ab"]), learn)  # six strings are known: the store starts anew
    assert seen[-1] == "ab"
