import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from henhouse.llm import elias_fano, packing, token_files
from henhouse.session import scratch_path
from tests.llm.conftest import awkward_texts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (7, 3), (1000, 10), (5000, 10**6), (300, 2**64 - 1), (2000, 2**40), (513, 1)])
def test_elias_fano_round_trip(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n, np.uint64, endpoint=True))
    data = elias_fano.encode(values)
    back = elias_fano.EliasFano(data)
    assert (back.values() == values).all()
    assert [back.select(i) for i in range(n)] == values.tolist()
    assert len(data) * 8 <= 400 + n * (3 + max(0, np.log2(max(1, (top + 1) / max(n, 1)))) + 0.2)


def test_files_round_trip(spark, awkward, awkward_docs, no_docs):
    folder = scratch_path(spark, "files")
    manifest = token_files.write(awkward_docs, folder, ids_per_file=3000)
    assert len(manifest) > 4
    got = token_files.read(spark, folder, manifest).collect()
    want = Counter((d, len(_ids(t)) + 1, _crc([*_ids(t), 2])) for d, t, *_ in awkward)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[r.n_tokens for r in order[:-1]]]).tolist()
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in order[:len(order) - len(known)]] == [None] * (len(order) - len(known))
    # single documents by select
    file = token_files.TokenFile(f"{folder}/{manifest[1][0]}")
    texts = defaultdict(list)
    for d, t, *_ in awkward:
        texts[d].append([*_ids(t), 2])
    for i in range(len(file)):
        assert file.document(i).tolist() in texts[file.doc_id(i)]
    assert token_files.documents_via_files(no_docs).count() == 0


def test_patterns_place_every_length_once():
    rng = random.Random(1)
    for _ in range(30):
        size = rng.choice([8, 64, 2048])
        histogram = Counter(rng.choice([size, rng.randint(1, size)]) for _ in range(rng.randint(0, 3000)))
        found = packing.patterns(histogram, size)
        used = Counter()
        for lengths, n in found:
            assert sum(lengths) <= size and n > 0 and list(lengths) == sorted(lengths, reverse=True)
            for length in lengths:
                used[length] += n
        assert used == histogram
        covered = defaultdict(list)
        for length, low, high, _, _ in packing.places(found):
            covered[length].append((low, high))
        for length, spans in covered.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == histogram[length]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def _check_packs(got, rows, size, end):
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append(r)
    for found in at.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == np.cumsum([0, *[r.length for r in found[:-1]]]).tolist()
        assert sum(r.length for r in found) <= size
    assert sorted(at) == list(range(len(at)))
    want = Counter()
    for d, t, *_ in rows:
        ids = [*_ids(t), end]
        for i in range(0, len(ids), size):
            want[d, i, len(ids[i:i + size]), _crc(ids[i:i + size]), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_of_a_table(spark, awkward, awkward_docs, size):
    _check_packs(packing.pack(awkward_docs, size=size).collect(), awkward, size, 1)


def test_packing_with_ids_and_without_rows(spark, awkward, awkward_docs, no_docs):
    for r in packing.pack(awkward_docs, size=100, with_ids=True).collect():
        assert len(r.ids) == r.length and _crc(r.ids) == r.ids_crc32
    assert packing.pack(no_docs).count() == 0


def _packed_one_by_one(histogram, size):
    """Free room of the packs after each piece went to the emptiest that fits, longest first."""
    free = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if not free or free[0] > -length:
                heapq.heappush(free, -size)
            heapq.heapreplace(free, free[0] + length)
    return Counter(-f for f in free)


def test_a_hot_short_length_fills_the_packs_it_opens():
    rng = random.Random(11)
    hot = [({1: 10_000}, 2048), ({1024: 50}, 2048), ({700: 7, 100: 5000, 1: 3000}, 2048), ({2048: 3, 9: 1}, 2048)]
    hot += [({rng.randint(1, n): rng.randint(1, 400) for _ in range(6)}, n) for n in (5, 17, 64) for _ in range(20)]
    for histogram, size in hot:
        left = Counter()
        for lengths, n in packing.patterns(histogram, size):
            left[size - sum(lengths)] += n
        assert left == _packed_one_by_one(histogram, size)
    assert sum(n for _, n in packing.patterns({1: 10_000_000}, 2048)) == -(-10_000_000 // 2048)


def test_copies_of_a_short_text_share_sequences(spark):
    docs = spark.createDataFrame([(i, "a short text" if i % 3 else "") for i in range(900)], "doc_id long, text string")
    got = packing.pack(docs, size=64).collect()
    _check_packs(got, [(i, "a short text" if i % 3 else "") for i in range(900)], 64, 1)
    assert sum(r.length for r in got) > 0.95 * 64 * len({r.sequence_id for r in got})


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = packing.pack(docs).selectExpr("sum(length) / (count(distinct sequence_id) * 2048)").first()
    assert r[0] > 0.99


ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "tab\t y", "it's  we'll ' s", "x   y　z  w", "\x1c a\x1d b \x85 c", "日本 語 é à",
       "end <|endoftext|> mid <|endoftext|>", "a ▁ b 🙂 c", "1 22 333 4444", "!!! ??? ... , ,", "​ x ​", "a\r\n b", " lead", "trail ", "ʼ ² ½ Ⅷ"]


@pytest.mark.parametrize("remembered", [40 << 20, 2000])
def test_parts_give_the_library_s_ids(monkeypatch, remembered):
    monkeypatch.setattr("henhouse.llm.tokens.REMEMBERED_BYTES", remembered)
    from henhouse.llm.tokens import Encoder

    rng = random.Random(4)
    pool = ["a", "the", "é", "日", "🙂", "'s", "12", " ", "  ", "\n", "\t", " ", "　", "\x1c", ".", ",,", "%", "​", "ß-x"]
    texts = ODD + ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [t or "" for _, t, *_ in awkward_texts()]
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(file))
        own = Encoder(public_tokenizers.path(file))
        for size in (1, 100):
            for i in range(0, len(texts), size):
                part = texts[i:i + size]
                for t, ids in zip(part, own.encode(part)):
                    assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_are_known_again_beside_other_signs():
    """The library gets a word once, whatever signs, digits, breaks or texts stand around it."""
    from henhouse.llm.tokens import Encoder

    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"{a}{b}{c}" for a in ("straw", "éleve", "крас") for b in ("lin", "dör", "moq") for c in ("at", "eç", "ux")]
    signs = [".", ",", ";", ")", "!?", "\n", ".\n", "\t", "7", "...\n", "'", "-"]
    texts = [" " + w for w in words] + ["\n" + w for w in words] + [f"x{s} (x{s}" for s in signs]
    asked, whole = [], own._whole
    own._whole = lambda texts: asked.extend(texts) or whole(texts)
    own.encode(texts)
    del asked[:]
    again = [f"{w}{s} {v}{s}\n{w}" for w in words for v in words for s in signs]
    got = own.encode(again)
    assert sum(map(len, asked)) < 200
    for t, ids in zip(again, got):
        assert ids.tolist() == _ids(t), repr(t)


def test_parts_of_neighbouring_texts_and_odd_spaces():
    """White space at the end of a text is not cut by what the next one begins with."""
    from henhouse.llm.tokens import Encoder

    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    gaps = ["", " ", "  ", "\n", " \n", "\n\n ", "\u00a0 ", "\u3000\n", "\u1680 ", "\u2028", "\x1c ", "\x85\t", "\x0b\n", "\r\n"]
    sides = ["a", "Z9", "é", "×", "÷x", "ж", "\u02c5b", "٣", "½", "'s", "''ll", ".", "_", "日", "か", "é\u0301", "\u20ac", "\U0001f600", ""]
    texts = [a + g + b for a in sides for g in gaps for b in sides]
    texts += [x for a in sides for g in gaps for x in (a + g, g + a)]
    for batch in (texts, texts[::-1]):
        for t, ids in zip(batch, own.encode(batch)):
            assert ids.tolist() == _ids(t), repr(t)
    assert own.encode([]) == [] and [x.tolist() for x in own.encode(["", ""])] == [[], []]
