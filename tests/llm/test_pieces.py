import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from henhouse.llm import sentencepiece_codec as codec
from henhouse.llm.pieces import PieceModel
from tests.llm.conftest import awkward_texts

ODD = ["", " ", "   ", "a", "▁", " ▁x ▁", "hello   world\n\ttab  ", "Ａ①ﬁ é", "日本語テキスト", "\x00\x01", "naïve café 🙂🙂 ok",
       "aaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 50 + "end", "1234567890 12.5%", "the quick brown fox " * 50, "ﷺ" * 5, "x​y"]


def _library(serialized):
    return sentencepiece.SentencePieceProcessor(model_proto=serialized)


def _variants():
    """The public model as it is, read as a unigram model, and without byte pieces."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(codec.model_path(), "rb").read())
    yield "bpe", proto.SerializeToString()
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == 6:
            p.type = 5
    yield "bpe without bytes", proto.SerializeToString()
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(codec.model_path(), "rb").read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(3)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -rng.uniform(5, 15) + 0.5 * len(p.piece)
    yield "unigram", proto.SerializeToString()


def _texts():
    rng = random.Random(11)
    vocab = [_library(open(codec.model_path(), "rb").read()).id_to_piece(i).replace("▁", " ") for i in range(300, 32000, 37)]
    mixed = ["".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    letters = ["".join(rng.choice("abehlnorst é") for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    return ODD + mixed + letters + [t for _, t, *_ in awkward_texts() if t and len(t) < 5000]


@pytest.mark.parametrize("name, serialized", list(_variants()), ids=lambda v: v if isinstance(v, str) else "")
def test_equals_the_library(name, serialized):
    library, own = _library(serialized), PieceModel(serialized)
    for text in _texts():
        assert own.encode(text) == library.encode(text), (name, text)


def test_border_rule_equals_merging():
    """Whether two pieces keep apart, read off their histories, against merging the two."""
    own = PieceModel(open(codec.model_path(), "rb").read())
    rng = random.Random(5)
    pieces = sorted(p for p in own.ids if own._stays(p))
    spaces = [p for p in pieces if not p.strip("▁")]
    short = [p for p in pieces if len(p) < 4]
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(4000)] + [(rng.choice(short), rng.choice(short)) for _ in range(8000)]
    pairs += [(a, b) for a in spaces for b in spaces + rng.sample(pieces, 60)]
    assert len({own._keep_apart(a, b) for a, b in pairs}) == 2
    for a, b in pairs:
        assert own._keep_apart(a, b) == (own._merged(a + b) == [a, b]), (a, b)
    for p in rng.sample(sorted(own.ids), 2000):
        assert own._stays(p) == (own._merged(p) == [p])


def test_round_trip():
    own = PieceModel(open(codec.model_path(), "rb").read())
    for text in _texts():
        assert own.decode(own.encode(text)) == text.replace("▁", " ")


def test_memory_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr("henhouse.llm.pieces.REMEMBERED_BYTES", 900)
    monkeypatch.setattr("henhouse.llm.pieces.REMEMBERED_PAIRS", 3)
    serialized = open(codec.model_path(), "rb").read()
    library, own = _library(serialized), PieceModel(serialized)
    for text in ODD:
        assert own.encode(text) == library.encode(text)
    assert len(own._known) <= 3 and len(own._pairs) <= 3


def test_tables(spark, awkward, awkward_docs, no_docs):
    library = _library(open(codec.model_path(), "rb").read())
    got = codec.digests(awkward_docs).collect()
    want = []
    for d, t, *_ in awkward:
        ids = library.encode(t or "")
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), sum(library.is_byte(i) for i in ids),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert codec.digests(no_docs).count() == 0
    both = codec.decode(codec.encode(awkward_docs))
    assert both.columns == [*awkward_docs.columns, "ids", "decoded"]
    assert both.filter("decoded <> coalesce(text, '')").count() == 0
    with pytest.raises(ValueError):
        codec.encode(awkward_docs, target="kept")
