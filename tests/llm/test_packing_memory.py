"""What the tokenizing step remembers of words."""

import numpy as np
import pyarrow as pa

from candlemill.llm import packing
from candlemill.llm.queries import tokenizer_path


def test_few_pieces_are_remembered_and_ids_stay(monkeypatch):
    """Words are remembered in arrays, pieces up to a bound; forgetting changes no id."""
    monkeypatch.setattr(packing, "_CACHE_PIECES", 50)
    monkeypatch.setattr(packing, "_CACHE_WORDS", 300)
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 6)))) + rng.choice(["", ",", "'s"]) for _ in range(60)) for _ in range(40)]
    encoder = packing.Encoder(tokenizer_path())
    for at in range(0, 40, 5):
        for rows, ids, starts in encoder.encode(pa.array(texts[at : at + 5])):
            for r, s, e in zip(rows, starts, starts[1:]):
                assert ids[s:e].tolist() == [*encoder.tok.encode(texts[at + r], add_special_tokens=False).ids, packing.END]
        assert isinstance(encoder.place, np.ndarray) and (np.diff(encoder.known.astype(object)) > 0).all()
    encoder._forget()
    assert len(encoder.pieces) <= 50 and len(encoder.place) <= 300
