"""The encoder of op4 against the tokenizers library as it comes, special tokens included."""

import json
import random
import sys

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from orbweaver.llm import records

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("as_text", [True, False])
@pytest.mark.parametrize("make", [records.load_encoder, lambda p, s: records.WordMemo(p, 50, s)])
def test_encoders_equal_library(make, as_text):
    rng = random.Random(8)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = as_text
    coder = make(PATH, as_text)
    alphabet = ["a", "bc", " ", "  ", "\n", "'re", "12", "é", "日本", "...", "\t", "　", "\xa0", "\x1c", "🙂", "x²", "<|endoftext|>", "<|", "The ", "aaaa", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)] + [None, "", "<|endoftext|>", "word " * 50_000]
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    hello = np.frombuffer(coder.encode(["hello <|endoftext|> world"])[0], coder.dtype).tolist()
    assert (50256 in hello) is not as_text


def test_every_code_point():
    """Letters, digits and white space are the same characters for both libraries."""
    library, coder = Tokenizer.from_file(PATH), records.load_encoder(PATH, False)
    assert isinstance(coder, records.RankBpe)
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c} {c}." for c in points]
    for at in range(0, len(texts), 1 << 16):
        part = texts[at : at + (1 << 16)]
        want = [np.array(x.ids, coder.dtype).tobytes() for x in library.encode_batch_fast(part, add_special_tokens=False)]
        assert coder.encode(part) == want


def test_other_files_use_the_library(tmp_path):
    """A vocabulary that holds a token its merges never reach is not read as ranks."""
    kind = json.load(open(PATH))
    kind["added_tokens"] = []
    letters = records.byte_letters()
    vocab = {letters[b]: b for b in range(256)}
    merges = [("b", "c"), ("a", "b"), ("ab", "c")]  # of a, b, c only bc is ever made
    for i, (a, b) in enumerate(merges):
        vocab[a + b] = 256 + i
    kind["model"] |= {"vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(kind))
    coder = records.load_encoder(str(path), True)
    assert isinstance(coder, records.WordMemo)
    library = Tokenizer.from_file(str(path))
    assert np.frombuffer(coder.encode(["x abc ab"])[0], coder.dtype).tolist() == library.encode("x abc ab", add_special_tokens=False).ids
