"""Ids of texts whose lowering before the tokenizer would change them."""

import os
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sensorgrid.llm.packing import WordTokens

TEXTS = [
    "one <|ENDOFTEXT|> two", "x<|EndOfText|>, y.", "<|endoftext|> Z", "<|STARTOFTEXT|>A",
    "a J\u030cB c", "T\u0308 and T\u0308.", "A\u030a \u212b \u212a \u0130 \u0130\u0323",
    "H\u0331 W\u030a Y\u030a", "\u039f\u0394\u039f\u03a3 end", "\u00c4 \u00d6 Plain, Text.",
    "J\u030c,",
]


@pytest.mark.parametrize("together", [True, False])
def test_ids_are_those_of_the_tokenizer(together):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), WordTokens(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    if together:
        assert [x.tolist() for x in words.encode(TEXTS)] == want
    else:
        assert [next(iter(words.encode([t]))).tolist() for t in TEXTS] == want


def test_tokenizer_starts_no_threads():
    """Threads of its own, one per core of the machine, would each keep memory in a task."""
    code = (
        "import os, public_tokenizers\n"
        "from sensorgrid.llm.packing import WordTokens\n"
        "before = len(os.listdir('/proc/self/task'))\n"
        "words = WordTokens(public_tokenizers.path('word_bpe_49k.json'))\n"
        "list(words.encode([' '.join(f'w{i}' for i in range(5000))]))\n"
        "print(len(os.listdir('/proc/self/task')) - before)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run(
        [sys.executable, "-c", code], env=env, cwd=root, capture_output=True, text=True, check=True
    )
    assert done.stdout.split() == ["0"]
