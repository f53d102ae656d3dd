import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from henhouse.llm import token_alignment, tokens
from henhouse.llm.common import written
from tests.llm.conftest import DOC_SCHEMA


@pytest.fixture(scope="module")
def libraries():
    level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    level.encode_special_tokens = True
    return level, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _sign_bytes():
    signs, extra = {}, 0
    for b in range(256):
        if b in range(33, 127) or b in range(161, 173) or b in range(174, 256):
            signs[chr(b)] = b
        else:
            signs[chr(256 + extra)] = b
            extra += 1
    return signs


def _brute(rows, libraries):
    """rows: (doc_id, text). Result rows, by comparing all byte ranges."""
    level, pieces = libraries
    signs = _sign_bytes()
    docs = []
    for d, t in rows:
        want = (" " + (t or "")).encode()
        a = level.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        bytes_a = [bytes(signs[c] for c in level.id_to_token(i)) for i in a]
        names = [pieces.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("\u2581", " ").encode() for p in names]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((d, [], [], [], []))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            ends.append(own)
        links = [(x, y) for x, (s, e) in zip(a, ends[0]) for y, (u, v) in zip(b, ends[1]) if s < v and u < e]
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        low, groups = 0, []
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own) if low <= s and e <= cut) for ids, own in zip((a, b), ends)))
            low = cut
        docs.append((d, a, b, links, groups))
    count = Counter(p for *_, links, _ in docs for p in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for d, a, b, links, groups in docs], count


def test_equals_brute_force(spark, awkward, libraries, monkeypatch):
    rows = [(d, t) for d, t, *_ in awkward if len(t or "") < 3000]
    rows += [(9000, "<|endoftext|> plain <s> text </s>"), (9001, "a \u2581 lower block is not given back"), (9002, " lead  and trail  "),
             (9003, "\U0001f600\u00bd\ufb01 \u65e5\u672c"), (9004, "\r\n\t\x00"), (9005, "x" * 300)]
    docs = written(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC_SCHEMA).withColumn("pair", F.lit("x"))
                   .withColumn("chunk", F.lit(0)).withColumn("doc", F.lit(1)).repartition(3), "align")
    want, count = _brute(rows, libraries)
    result, table = token_alignment.token_links(docs)
    assert Counter(map(tuple, result.collect())) == Counter(want)
    assert {(r.a, r.b): r["count"] for r in table.collect()} == dict(count)
    assert sum(n for _, n, *_ in want) > 10_000


def test_blocks_and_chunks(libraries):
    """The links of texts together are those of each alone."""
    level = token_alignment.Side([token_alignment.level_bytes(t, token_alignment.byte_signs()) for t in _tokens(libraries[0])])
    level.encode = lambda texts: _flat([libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts])
    piece = token_alignment.Side([token_alignment.piece_bytes(libraries[1].id_to_piece(i)) for i in range(libraries[1].get_piece_size())])
    piece.encode = lambda texts: _flat(libraries[1].encode(texts))
    texts = ["some words", "\u2581 not given back", "more \u00e9\u00e9 words", "z"]
    counts, pairs = token_alignment.align(level, piece, texts)
    for i, t in enumerate(texts):
        alone, own = token_alignment.align(level, piece, [t])
        assert {k: v[0] for k, v in alone.items()} == {k: v[i] for k, v in counts.items()}
        assert own.drop_columns("doc").to_pylist() == [{"pair": p["pair"], "times": p["times"]} for p in pairs.to_pylist() if p["doc"] == i]


def _tokens(level):
    return [level.id_to_token(i) or "" for i in range(level.get_vocab_size())]


def _flat(lists):
    import numpy as np

    return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)


def test_many_chunks(spark, libraries, monkeypatch):
    rows = [(i, f"word{i % 7} and number {i} of many") for i in range(300)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC_SCHEMA).repartition(5)
    assert Counter(map(tuple, token_alignment.align_documents(docs).collect())) == Counter(_brute(rows, libraries)[0])


def test_empty_table(no_docs):
    assert token_alignment.align_documents(no_docs).collect() == []


def test_remembered_parts_are_bounded_by_bytes():
    """Long texts without spaces, and many parts, stay under the stated bytes."""
    own = tokens.Encoder(tokens.byte_bpe_path(), remembered=200_000)
    library = Tokenizer.from_file(tokens.byte_bpe_path())
    for k in range(200):
        texts = [chr(0x4E00 + (k * 10 + i) % 5000) * 300 for i in range(10)] + [f"part{k}x{i} " * 3 for i in range(40)]
        for t, ids in zip(texts, own.encode(texts)):
            if k % 50 == 0:
                assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        held = [d for d in (own._young, own._old)]
        assert max(len(p) for d in held for p in d) <= tokens.PART_CHARS
        assert sum(len(p) + len(i) + tokens.ENTRY_BYTES for d in held for p, i in d.items()) <= 400_000


def test_words_give_the_model_s_ids(libraries, monkeypatch):
    own = token_alignment.PieceSide.__new__(token_alignment.PieceSide)
    own._load(public_tokenizers.path("piece_bpe_32k.model"))
    assert own._by_words
    texts = ["a  b", " lead", "trail ", "  ", "one", "a b c", "a \n b", "\t x  y   z", "\u65e5\u672c \u8a9e", "\U0001f600 \u00bd", "<s> </s> <0x41>", "x\u00a0y z", "'s 12 3"]
    texts += [" ".join(f"w{i % 50}{'' if i % 7 else ' '}" for i in range(k, k + 40)) for k in range(60)]
    for held in (token_alignment.WORD_BYTES, 3000):
        monkeypatch.setattr(token_alignment, "WORD_BYTES", held)
        for size in (1, 9):
            for i in range(0, len(texts), size):
                ids, sizes = own.encode(texts[i:i + size])
                want = libraries[1].encode(texts[i:i + size])
                assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert own.encode(["\u2581 a"])[0].tolist() == libraries[1].encode("\u2581 a")
