import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id string, node string, text_hash string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, equal texts but for white space, near copies, and columns named like inner ones."""
    base = " ".join(f"word{i % 97}x{i}" for i in range(120))
    near = base.replace("word5x5 ", "changed ")
    rows = [(1, base, "en", "a"), (2, base.replace(" ", "  \t"), "en", "a"), (3, near, "de", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \n ", "en", "b"), (7, " ", "en", "b"),
            (8, "THE QUICK brown fox", "en", "c"), (9, "the quick BROWN fox", "en", "c"), (9, "the quick BROWN fox", "en", "c"), (None, "no id here at all", "fr", "c"), (None, base, "fr", "c"),
            (10, "übergrößenträger 漢字 🙂 's  1234\n\n  tab\tend ", "de", "d"), (11, "long " * 30_000, "en", "a"), (12, "x" * 50_000, "en", "a"), (13, "unlike " + " ".join(f"t{i}" for i in range(50)), "en", "a")]
    full = [(i, t, l, s, None if t is None else len(t), 7, "z", "n", "h") for i, t, l, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
