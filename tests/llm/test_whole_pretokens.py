"""Pretokens of more than 2**20 bytes are encoded like the rest."""

import os

import numpy as np
import pytest

from pathloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.default_rank_file()), reason="no rank file")


def test_a_pretoken_longer_than_a_million_bytes():
    enc = bpe.BytePairEncoder()
    # a letter that merges with nothing here, so that the merges are all beyond 2**20
    quiet = next(c for c in map(chr, range(0x1200, 0x1300)) if c.isalpha() and len(enc.encode_long((c * 3).encode())) == 9)
    many = (1 << 20) // 3 + 100
    tail = enc.encode_long((quiet + "therefore" + quiet).encode()).tolist()
    single = enc.encode_long(quiet.encode()).tolist()
    assert len(tail) < 15
    text = quiet * many + "therefore" + quiet
    assert enc.find(text) == [text]
    assert np.frombuffer(enc.encode_bytes([text])[0], np.int32).tolist() == single * (many - 1) + tail
