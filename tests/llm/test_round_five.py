"""Encoding without searches for cycles."""

import gc

from screenloom.llm.bpe_tree import Encoder


def test_encoding_makes_no_search_for_cycles():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    encoder, phases = Encoder(ranks, r"\S+|\s+"), []
    watch = lambda phase, info: phases.append(phase)
    texts = [" ".join(f"abc{i}xyz{i * 7}" for i in range(20_000))]
    gc.collect()
    gc.callbacks.append(watch)
    try:
        ids, counts = encoder.batch(texts)
    finally:
        gc.callbacks.remove(watch)
    assert len(phases) <= 4 and gc.isenabled()
    assert b"".join(encoder.token[i] for i in ids.tolist()) == texts[0].encode() and counts.sum() == len(ids)
