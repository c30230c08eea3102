import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, sequence_id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with columns that clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], DOCS)
    return make


ODD_TEXTS = ["", None, " ", "\n\n", "a", "a b c d e f", "x " * 3000, "é" * 500, "퟿\U0001f600 ok", "the\x0bcat\x1csat\x85on", "<|endoftext|> it's 4th"]
