"""Texts that hold the string of an added token, against the plain library call."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioforge.llm.fasttok import PreTokenEncoder

TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|ENDOFTEXT|> x", "<|endoftext| > y", "plain <b> text", "it's <|endoftext|>", "é <|startoftext|> z <|endoftext|>\n", ""]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens(name, spaces):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    got = [x.tolist() for x in PreTokenEncoder(path, spaces).encode(TEXTS)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert max(plain.get_added_tokens_decoder()) in got[0]
