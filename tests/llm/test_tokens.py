"""The token file's shortcuts against the plain tokenizer library."""

import gc
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import rans
from millrace.llm.shared import returning
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b\tc", "col1\tcol2  end", "x y\tz ", " lead", "trail ", "a\tb\tc\n \nd", "p\tq\tr\n \nb", "", " ", "\n", "  \n ", "x <|endoftext|>y z", "<|endoftext|>",
       "<|endoftext|> <|endoftext|>", "it's we'll 'quoted'", "1,234.5 (x) -- [y]", "caf\xe9 \xdcber  wide　space\xa0nb\x85nel", "日本語 text", "\x1c\x1d a\x1e b"]
PARTS = ["a", "word", "Word9", "42", "caf\xe9", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\xa0", " ", "　", "'s", "'", ".", "...", "(x)", "<|endoftext|>", "́", "日本",
         "\U0001f600", "\x1c", "_", "1.5", "-"]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_ids_of_odd_texts(special_as_text):
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 12))) for _ in range(20_000)]
    texts += [" ".join(draw.choice(PARTS) for _ in range(draw.randint(1, 9))) for _ in range(10_000)]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = special_as_text
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    got = rans.PieceIds(rans.ByteBpe(PATH, special_as_text)).ids(texts)
    assert [g.tolist() for g in got] == want


def test_forgotten_pieces(monkeypatch):
    """Pieces beyond the remembered ones are encoded again with the same ids."""
    monkeypatch.setattr(rans, "CACHED_PIECES", 3)
    ids = rans.PieceIds(rans.ByteBpe(PATH))
    texts = ["one two three four", "two five six", "five six one seven"]
    assert [x.tolist() for t in texts for x in ids.ids([t])] == [i[:-1] for i in brute.token_ids(texts)]


def test_file_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.encode_documents(docs, PATH).collect()}
    assert got == brute.encoded(list(enumerate([*ODD, None])))


def test_later_stages_hold_no_pieces(spark):
    """Spark gives a worker to the next stage: by then the tokenizer and its pieces are gone."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    assert rans.encode_documents(docs, PATH).count() == 64

    def kept(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ == "PieceIds" for x in gc.get_objects())]})

    assert {r.n for r in docs.select("doc_id").mapInArrow(returning(kept), "n long").collect()} == {0}


def test_pieces_stay_for_a_stage(spark):
    """Tasks of one stage that share a worker load the tokenizer once."""
    def loaded(batches):
        for _ in batches:
            pass
        first = rans.byte_bpe(PATH)
        first["mark"] = 0
        yield pa.RecordBatch.from_pydict({"n": [int(rans.byte_bpe(PATH) is first) + sum(type(x).__name__ == "PieceIds" for x in gc.get_objects())]})

    assert {r.n for r in spark.range(64, numPartitions=32).mapInArrow(returning(loaded), "n long").collect()} == {2}
