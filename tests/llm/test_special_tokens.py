"""Texts that hold a special token have the library's own ids."""

import numpy as np
from tokenizers import Tokenizer

from flowledger.llm import idcodec, packing, tokens

END = "<|endoftext|>"
TEXTS = ["hi <|endoftext|> there", END, f"a  {END}  b", f"x{END}y {END}{END}\n\n {END} z", f"　{END}\x0b{END} ", "<|endoftext |> <|endoftext"]


def library(text):
    return Tokenizer.from_file(tokens.public_path()).encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_librarys_ids():
    assert library(TEXTS[0]) == [5303, 220, 50256, 612]
    for remembered in (1, 50, tokens.REMEMBERED):
        encode = tokens.Encoder(tokens.public_path(), remembered=remembered)
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(TEXTS + TEXTS)] == [library(t) for t in TEXTS + TEXTS]


def test_packed_ids_are_the_librarys(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs, tokens.public_path()), docs.count()).collect()
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows}
    assert got == {i: [*library(t), 0] for i, t in enumerate(TEXTS)}
