import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlight.llm.packing import Packer, encoder, pack_documents
from ledgerlight.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "a \n b", "a\n b", "x\t\n y ", "it's  'a' don't", "ünï 漢字 ½ ٣", "<|endoftext|> x", "a b  c", "\x1c \x1d", "end   ", "a\r\n\r\nb 12 345"])
def test_ids(text, truth):
    assert np.frombuffer(encoder(PATH)(text), "<u4").tolist() == truth(text)[:-1].tolist()


def whole(pieces, ids, limit=1024):
    """Each id in one piece, sequences without gaps and within the limits."""
    for k, want in ids.items():
        mine = sorted((p for p in pieces if p[0] == k), key=lambda p: p[1])
        assert [p[1] for p in mine] == np.cumsum([0] + [p[2] for p in mine]).tolist()[:-1] and sum(p[2] for p in mine) == len(want)
        assert all(zlib.crc32(want[p[1]: p[1] + p[2]].tobytes()) == p[3] for p in mine)
    by = {}
    for p in pieces:
        by.setdefault(p[4], []).append((p[5], p[2]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at == limit or at & (at - 1) == 0


def test_query(spark, truth):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id: truth(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_packing"](spark, sf).collect()
    assert all(r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    whole([(r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in rows], ids)


def test_hard_rows(spark, hard, nothing, truth):
    rows = pack_documents(hard.repartition(2), PATH).collect()
    assert sum(r.length for r in rows) == sum(len(truth(r.text)) for r in hard.collect())
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert pack_documents(nothing, PATH).count() == 0


def test_limits_on_segments_and_loss(spark, truth):
    docs = spark.createDataFrame([(i, f"answer {i} " * (i % 40 + 1), f"question {i} " * (i % 60)) for i in range(400)], "doc_id long, text string, prompt string").coalesce(1)
    rows = pack_documents(docs, PATH, prompt="prompt", max_tokens=256, max_segments=4, max_loss=100, pool=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for found in by.values():
        assert sum(r.length for r in found) <= 256 and len(found) <= 4 and sum(r.loss_tokens for r in found) <= 100
    for i in range(400):
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in mine) == mine[0].doc_tokens
        assert sum(r.loss_tokens for r in mine) == mine[0].doc_tokens - (len(truth(f"question {i} " * (i % 60))) - 1)


def test_packer_has_little_padding():
    packer = Packer(1024, 64, 1024, 128, 0)
    rng = np.random.default_rng(0)
    for i, n in enumerate(rng.integers(1, 3000, 500).tolist()):
        packer.add(i, n, 0)
    packer.finish()
    size = {}
    for _, _, length, _, sequence, _ in packer.out:
        size[sequence] = size.get(sequence, 0) + length
    assert sum(n != 1024 for n in size.values()) <= 11
